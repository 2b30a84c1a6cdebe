"""Benchmark decontamination: a hash set of test n-grams against the token windows of documents.

Only DataFrame functions run here. The set of window hashes goes to every task as the constants of
an IN test, as long as it has at most `SET_LIMIT` members; beyond that the windows are joined.
Every hash hit is verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climrisk.llm.common import free_name

#: Largest hash set sent to the tasks (8 bytes a member).
SET_LIMIT = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: digits, lower-case letters, and everything outside ASCII.
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    return F.regexp_extract_all(
        F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0)
    )


def _starts(words: Column, width: int) -> Column:
    """1 .. number of windows of that width; empty when there is none."""
    last = F.size(words) - (width - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, width: int = 13) -> DataFrame:
    """Distinct (width, hash, words, item_id) of all windows; a shorter item is one window.

    Items without words or without item_id are passed over. An id given twice is one item.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(
        "item_id IS NOT NULL AND size(words) > 0"
    )
    used = F.least(F.size("words"), F.lit(width))
    return (
        items.withColumn("width", used)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - used + 1)))
        .select("width", F.slice("words", F.col("at"), F.col("width")).alias("words"), "item_id")
        .withColumn("hash", F.xxhash64("words"))
        .distinct()
    )


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """One row per document row and verified window occurrence, or one with null `at` for none.

    Columns: row_id, doc_id, n_words, at (first word, from 1), width, item_ids.
    """
    grams = benchmark_windows(benchmark, width)
    known = (
        grams.groupBy("width", "hash", "words")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .withColumnsRenamed({"words": "window_words"})
    )
    sizes = {r["width"]: r["n"] for r in grams.groupBy("width").agg(F.count_distinct("hash").alias("n")).collect()}
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", words_of(F.col("text")).alias("words")
    )
    fits = sum(sizes.values()) <= SET_LIMIT

    def hits(size: int) -> Column:
        starts = _starts(F.col("words"), size)
        hashed = lambda i: F.xxhash64(F.slice(F.col("words"), i, F.lit(size)))
        if fits:
            members = [r["hash"] for r in grams.where(F.col("width") == size).select("hash").distinct().collect()]
            starts = F.filter(starts, lambda i: hashed(i).isin(members))
        return F.transform(
            starts,
            lambda i: F.struct(
                i.alias("at"),
                F.lit(size).alias("width"),
                hashed(i).alias("hash"),
                F.slice(F.col("words"), i, F.lit(size)).alias("said"),
            ),
        )

    none = F.array().cast("array<struct<at:int,width:int,hash:bigint,said:array<string>>>")
    found = F.concat(*[hits(s) for s in sorted(sizes)]) if sizes else none
    return (
        rows.select("row_id", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(found).alias("hit"))
        .select("row_id", "doc_id", "n_words", "hit.*")
        .join(known, ["width", "hash"], "left")
        .withColumn("sure", F.coalesce(F.col("said") == F.col("window_words"), F.lit(False)))
        .select(
            "row_id",
            "doc_id",
            "n_words",
            F.when(F.col("sure"), F.col("at")).alias("at"),
            F.when(F.col("sure"), F.col("width")).alias("width"),
            F.when(F.col("sure"), F.col("item_ids")).alias("item_ids"),
        )
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, spans, n_items, items_sha256, contaminated.

    spans: runs of hit words (start from 0, end after the last). contaminated: some word is hit and
    share * n_hit >= n_words. A null or empty text has no words and is clean. A null doc_id is
    returned like any other. Repeated rows come back each. Other columns are left out.
    """
    hits = window_hits(docs, benchmark, width)
    reach = (
        hits.groupBy("row_id", "doc_id", "n_words")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "width")))).alias("runs"),
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("items"),
        )
    )
    # Sorted runs melt into spans: one that starts within the last span lengthens it.
    empty = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        "runs",
        empty,
        lambda acc, run: F.when(
            (F.size(acc) > 0) & (run["at"] - 1 <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], run["at"] - 1 + run["width"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(
            F.concat(acc, F.array(F.struct((run["at"] - 1).alias("start"), (run["at"] - 1 + run["width"]).alias("end"))))
        ),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return (
        reach.withColumn("spans", spans)
        .withColumn("n_hit", n_hit)
        .select(
            "row_id",
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(
                F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").cast("binary"), 256
            ).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
            "spans",
        )
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The rows of `docs` without contaminated documents, all columns kept.

    Equal doc_ids share their fate; rows without doc_id stay only if their text is clean, each by
    its own text (equal texts are equally contaminated).
    """
    own, named = free_name(docs, "own"), docs.where("doc_id IS NOT NULL")
    bad = contamination(named, benchmark, width, share).where("contaminated").select("doc_id").distinct()
    nameless = docs.where("doc_id IS NULL").withColumn(own, _digest())
    # The digest takes the place of the id, so that a row's verdict is found by its text.
    judged = contamination(_by_text(nameless, own), benchmark, width, share)
    bad_texts = judged.where("contaminated").select(F.col("doc_id").alias(own))
    kept = nameless.join(bad_texts, own, "left_anti")
    return named.join(bad, "doc_id", "left_anti").select(docs.columns).unionByName(kept.select(docs.columns))


def _digest() -> Column:
    return F.sha2(F.col("text").cast("string").cast("binary"), 256)


def _by_text(rows: DataFrame, digest: str) -> DataFrame:
    """Each text once, with its digest as doc_id; null texts left out."""
    return rows.where(F.col(digest).isNotNull()).select(F.col(digest).alias("doc_id"), "text").distinct()


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """doc_id and the remaining words (lower case, one space between) of each document row.

    Spans are found once for each text and meet the rows by its digest, so the rows may come in any
    order. Repeated rows and a null doc_id come back like any other; a null or empty text is empty.
    Other columns are left out.
    """
    rows = docs.select("doc_id", "text", _digest().alias("digest"))
    marked = contamination(_by_text(rows, "digest"), benchmark, width)
    # Only texts with a span are looked up: clean ones keep all their words.
    cut = marked.where("n_hit > 0").select(F.col("doc_id").alias("digest"), "spans")
    kept = F.filter(
        words_of(F.col("text")),
        lambda w, i: ~F.exists(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), lambda s: (s["start"] <= i) & (i < s["end"])),
    )
    return rows.join(cut, "digest", "left").select("doc_id", F.array_join(kept, " ").alias("text"))
