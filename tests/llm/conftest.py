import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of documents from (doc_id, text), with extra columns whose names the operators use inside."""

    def build(rows):
        full = [(i, t, "en", "s", None, "x", "y") for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def hard_texts():
    """Texts with copies, near copies, shared passages, nulls, empties, repeats and odd characters."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ba", "ko", "mi", "Zu", "né", "ßo", "1") for b in ("r", "tt", "lé", "n,", "s.", "")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(120)
    rows = [(i, text(rng.randint(1, 90))) for i in range(20)]
    rows += [(30, base), (31, base), (29, base), (32, base + " end"), (33, "start " + base), (34, base.replace("ko", "ka", 3))]
    rows += [(40 + i, text(20) + "\n" + passage + "\t" + text(15)) for i in range(4)]
    rows += [(50, passage + " " + passage), (51, None), (52, ""), (53, " \t\n "), (54, "one two"), (55, "one two"), (56, "One Two")]
    rows += [(57, "ab " * 900), (58, "x" * 1500), (60, text(30) + "\n\n" + text(30)), (None, base), (61, base), (61, base), (62, text(3000))]
    return rows


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def rows_of():
    return values


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
