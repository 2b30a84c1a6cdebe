"""Labelled rows that models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0: never learned from. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """doc_id, text, label of at most `limit` labelled rows that are not held out.

    The rows with the smallest hashes of their id: a fixed, even choice. A doc_id labelled twice
    has the larger label; a text met twice is taken once, under its smallest id; null labels and
    null texts are passed over. The limit bounds what is sent to the tasks.
    """
    chosen = (
        labels.where(F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    return (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy(F.xxhash64("text"), F.octet_length("text"))
        .agg(F.min_by(F.struct("doc_id", "text", "label"), "doc_id").alias("row"))
        .select("row.*")
    )
