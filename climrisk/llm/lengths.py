"""Exact token counts: documents by encoded length, and suffix sums that answer any context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climrisk.llm.common import staged
from climrisk.llm.tokens import default_path, encoder, texts_of

#: Lengths of one block of the suffix sums.
_BLOCK = 1024


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length, n_docs: how many rows encode to so many tokens, without special tokens.

    A null text is empty and has length 0; repeated rows and rows without doc_id count each.
    """
    path = path or default_path()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            lengths = np.array([len(encode(text)) // 4 for _, text in texts_of([batch])], np.int64)
            values, counts = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["length", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def with_suffix_sums(lengths: DataFrame) -> DataFrame:
    """Adds to each length: docs_longer_or_equal, tokens_longer_or_equal, docs_total, tokens_total, truncated_total.

    truncated_total: tokens left when every document is cut at that length. Sums run within blocks
    of lengths and then over the blocks, so no task sorts all lengths. The histogram is written
    down first: both need it.
    """
    lengths = staged(lengths)
    tokens = F.col("length") * F.col("n_docs")
    block = F.floor(F.col("length") / _BLOCK)
    rows = lengths.withColumns({"block": block, "tokens": tokens})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("sum"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(everything).alias("docs_total"),
        F.sum("sum").over(everything).alias("tokens_total"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(blocks, "block")
        .withColumns(
            {
                "docs_longer_or_equal": F.sum("n_docs").over(down) + F.col("docs_later"),
                "tokens_longer_or_equal": F.sum("tokens").over(down) + F.col("tokens_later"),
            }
        )
        .withColumn(
            "truncated_total",
            F.col("tokens_total") - F.col("tokens_longer_or_equal") + F.col("docs_longer_or_equal") * F.col("length"),
        )
        .select("length", "n_docs", "docs_longer_or_equal", "tokens_longer_or_equal", "docs_total", "tokens_total", "truncated_total")
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least that share of the documents doesn't exceed."""
    below = F.col("docs_total") - F.col("docs_longer_or_equal") + F.col("n_docs")
    return (
        sums.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .where(below >= F.col("share") * F.col("docs_total"))
        .groupBy("share")
        .agg(F.min("length").alias("length"))
    )


def truncated(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, tokens: all tokens when documents are cut at each limit; none for an empty table.

    The next length at or above a limit tells who is cut; beyond the longest nobody is.
    """
    rows = sums.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    longer = F.col("length") >= F.col("limit")
    nearest = F.min_by(
        F.struct("tokens_longer_or_equal", "docs_longer_or_equal"), F.when(longer, F.col("length"))
    )
    return (
        rows.groupBy("limit")
        .agg(F.max("tokens_total").alias("all"), nearest.alias("at"), F.max(longer).alias("cuts"))
        .select(
            "limit",
            F.when(F.col("cuts"), F.col("all") - F.col("at.tokens_longer_or_equal") + F.col("at.docs_longer_or_equal") * F.col("limit"))
            .otherwise(F.col("all"))
            .alias("tokens"),
        )
    )
