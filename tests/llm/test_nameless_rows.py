"""Rows without doc_id, and rows of one doc_id with different texts."""

from climrisk.llm import decontaminate, lines

DIRTY, CLEAN = "one two three four five six seven", "quite another text that nobody tests"


def test_nameless_rows_are_judged_by_their_own_text(spark, docs):
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    rows = [(None, DIRTY), (None, CLEAN), (None, CLEAN), (None, None), (1, DIRTY), (1, CLEAN), (2, CLEAN)]
    kept = decontaminate.remove_documents(docs(rows), bench)
    assert kept.columns == docs(rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(None, CLEAN), (None, CLEAN), (None, None), (2, CLEAN)], key=repr)


def test_texts_of_one_id_lose_their_own_lines(docs):
    said = "this line stands in two documents of the table"
    rows = [(1, said + "\nsome words of the first one"), (2, said + "\nzebra crossing near our harbour"), (2, "unrelated remarks on weather\nmore of something else again")]
    got = {r["text"]: r["n_removed"] for r in lines.deduplicate(docs(rows)).where("doc_id = 2").collect()}
    assert got == {"zebra crossing near our harbour": 1, rows[2][1]: 0}


def test_of_rows_with_one_id_the_least_text_stays(spark):
    from climrisk.llm import jaccard

    rows = [(1, "b b b b b b", "en"), (1, "a a a a a a", "fr"), (1, "a a a a a a", "de"), (2, "c c c c c c", None), (None, "n", "x"), (None, "n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stays string")
    for n in (1, 3):
        got = sorted(map(tuple, jaccard.keep_one(docs.repartition(n)).collect()), key=repr)
        assert got == sorted([(1, "a a a a a a", "de"), (2, "c c c c c c", None), (None, "n", "x"), (None, "n", "x")], key=repr)
