"""Documents dealt to chunks that one task holds, with what other tasks found out about them.

A chunk's documents cross the network once: the steps of a query meet them by the same exchange,
which Spark reuses. What a step learns about a chunk comes as side rows under its number.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.llm.common import CHUNK_BYTES, pieces, staged, text_bytes

SIDE = "chunk int, kind int, bucket int, first_doc long, home int, payload binary"
#: Kinds of side rows.
COPIES, COUNTS, BITS = 0, 1, 2
NO_ID = 2**63 - 1


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """chunk, doc_id, text (UTF-8 bytes; null: empty) of all rows; the number of chunks; all bytes."""
    total = text_bytes(docs)
    count = pieces(total, chunk_bytes)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", text), F.lit(count)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.cast("binary").alias("text"),
    )
    return rows, count, total


def copies(chunks: DataFrame) -> DataFrame:
    """Side rows for texts that several rows have: digest, smallest doc_id, the chunk it lies in.

    Partial aggregation makes one row of a text per task, so a text that a third of all rows have
    is no hot key; a chunk gets one side row for it.
    """
    keys = chunks.select("chunk", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.sha2("text", 256).alias("digest"))
    local = keys.groupBy("digest", "chunk").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    local = staged(local)
    groups = (
        local.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "chunk")).alias("first"), F.sum("n").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    found = local.select("digest", "chunk").join(groups, "digest")
    return staged(
        found.select(
            "chunk",
            F.lit(COPIES).alias("kind"),
            F.lit(0).alias("bucket"),
            F.col("first.doc_id").alias("first_doc"),
            F.col("first.chunk").alias("home"),
            F.unhex("digest").alias("payload"),
        )
    )


def as_side(replies: DataFrame, kind: int, payload: str) -> DataFrame:
    return replies.select(
        "chunk", F.lit(kind).alias("kind"), "bucket", F.lit(None).cast("long").alias("first_doc"), F.lit(None).cast("int").alias("home"), F.col(payload).alias("payload")
    )


class Chunk:
    """One chunk in a task: its rows in order of doc_id (null last) and text, and its side rows."""

    def __init__(self, docs: pa.Table, side: pa.Table):
        self.number = docs["chunk"][0].as_py() if docs.num_rows else None
        ids, texts = docs["doc_id"].to_pylist(), docs["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
        self.ids = [ids[i] for i in order]
        self.keys = [NO_ID if i is None else i for i in self.ids]
        self.texts = [texts[i] for i in order]
        self.kept: dict[str, list] = {}
        self.copies: dict[bytes, tuple[int, int]] = {}
        self.replies: dict[int, dict[int, bytes]] = {COUNTS: {}, BITS: {}}
        for kind, bucket, first, home, payload in zip(*(side[c].to_pylist() for c in ("kind", "bucket", "first_doc", "home", "payload")), strict=True):
            if kind == COPIES:
                self.copies[payload] = (first, home)
            else:
                self.replies[kind][bucket] = payload
        # (smallest doc_id, its chunk) for a text that several rows have.
        self.copied = [self.copies.get(hashlib.sha256(t).digest()) for t in self.texts] if self.copies else [None] * len(self.texts)


def steps(chunks: DataFrame, side: DataFrame, run, schema: str) -> DataFrame:
    """`run(Chunk)` on every chunk together with its side rows; a chunk without documents is skipped."""

    def meet(docs: pa.Table, told: pa.Table) -> pa.Table:
        return run(Chunk(docs, told))

    return chunks.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(meet, schema)
