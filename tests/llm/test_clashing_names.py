"""Input columns named like the operators' own working columns."""

from pyspark.sql import functions as F

from climrisk.llm import decontaminate, lines

SAID = "this line stands in two documents of the table"


def test_lines_keep_columns_of_any_name(spark):
    rows = [(1, f"{SAID}\nsome words of the first one", 10, 20, 30, 40), (2, f"{SAID}\nzebra crossing near our harbour", 11, 21, 31, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_places int, _gone int, _id int, GONE_KEY int")
    out = lines.deduplicate(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = sorted(map(tuple, out.collect()))
    assert got == [(*rows[0], 2, 0), (2, "zebra crossing near our harbour", 11, 21, 31, 41, 2, 1)]


def test_documents_keep_a_column_named_own(spark):
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    rows = [(None, "one two three four", 5), (None, "clean words only", 6), (3, "more clean words", 7)]
    kept = decontaminate.remove_documents(spark.createDataFrame(rows, "doc_id long, text string, own int"), bench)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[2]], key=repr)


def test_spans_meet_their_rows_in_any_order(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(i, f"One{i} alpha Beta, gamma two" if i % 2 else f"clean{i} words") for i in range(40)] + [(None, "alpha beta gamma x"), (None, "alpha beta gamma x"), (41, ""), (42, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, F.rand())
    got = sorted(map(tuple, decontaminate.remove_spans(docs, bench).collect()), key=repr)
    want = [(i, f"one{i} two" if i % 2 else f"clean{i} words") for i in range(40)] + [(None, "x"), (None, "x"), (41, ""), (42, "")]
    assert got == sorted(want, key=repr)
