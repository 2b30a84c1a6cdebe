"""Helpers shared by the corpus operators: staged tables, chunks of documents, key counting."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one task holds at a time.
CHUNK_BYTES = 8 << 20
#: Keys that one counting task holds at a time; 32-bit remainders then clash about once in a thousand.
BUCKET_KEYS = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="climrisk-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The same rows read back from a table in the shared folder, removed when the session ends.

    All rows that were written are read, or the read fails: a session may tell Spark to pass over lost or unreadable
    files of its inputs, but a table of our own that lost one must not go on as a smaller one.
    `tidy` removes the shuffle files of the write as soon as it is done; for frames that are not run again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    whole = {"ignoreMissingFiles": "false", "ignoreCorruptFiles": "false"}
    return spark.read.options(**whole).schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    return sys.modules.setdefault(f"climrisk_worker_{name}", types.ModuleType(name)).__dict__


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many parts of at most `each` hold `total`; follows the data, without an upper limit."""
    return max(least, -(-int(total) // each))


def running_before(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows of a group that come earlier in `order`, and `<name>_all`,
    its sum over the whole group.

    Rows are dealt by ranges of (group, order, place of the row), so neither a large group nor many equal
    rows fill one task; each range then adds what the earlier ranges of its group hold. `group` must not
    be null; nulls in `order` come first. `df` should be read from a table: its rows are counted by place.
    """
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).withColumn("_value", value.cast("long"))
    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), group, *order, "_tie")
    ranges = staged(dealt.withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        ranges.groupBy(group, "_range")
        .agg(F.sum("_value").alias("_sum"))
        .select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_ahead"), F.sum("_sum").over(whole).alias(f"{name}_all"))
    )
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("_within", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(sums, [group, "_range"])
        .withColumn(name, F.col("_ahead") + F.col("_within"))
        .drop("_tie", "_value", "_range", "_ahead", "_within")
    )


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def grouped_rows(table: pa.Table, column: str) -> dict[int, np.ndarray]:
    """Row numbers by the value of a whole-number column."""
    if not table.num_rows:
        return {}
    keys = table[column].to_numpy()
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return {int(keys[part[0]]): part for part in np.split(order, cuts)}


# ---- which keys occur more than once ------------------------------------------------------

BLOCK_SCHEMA = "bucket int, chunk int, keys binary"
REPLY_SCHEMA = "chunk int, bucket int, counts binary"


def split_keys(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deals distinct 64-bit keys to buckets: their order, the cuts of each bucket, 32-bit remainders.

    The order is by bucket and key, so a chunk that deals the same keys again meets the reply
    in the same places.
    """
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, cuts, keys[order].astype(np.uint32)


def key_blocks(chunk: int, keys: np.ndarray, weights: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket: remainders of the chunk's distinct keys, then their local counts."""
    order, cuts, low = split_keys(keys, buckets)
    counts = np.minimum(weights[order], 255).astype(np.uint8)
    rows = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    return pa.table(
        {
            "bucket": pa.array(rows, pa.int32()),
            "chunk": pa.array([chunk] * len(rows), pa.int32()),
            "keys": pa.array(
                [
                    low[cuts[b] : cuts[b + 1]].tobytes() + _packed(counts[cuts[b] : cuts[b + 1]])
                    for b in rows
                ],
                pa.binary(),
            ),
        }
    )


def _packed(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes()) + len(counts).to_bytes(8, "little")


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(block[-8:], "little")
    low = np.frombuffer(block, np.uint32, n)
    return low, np.frombuffer(zstandard.ZstdDecompressor().decompress(block[4 * n : -8]), np.uint8)


def _count_bucket(table: pa.Table) -> pa.Table:
    import zstandard

    blocks = [_unpacked(b) for b in table["keys"].to_pylist()]
    low = np.concatenate([b[0] for b in blocks])
    counts = np.concatenate([b[1] for b in blocks])
    order = np.argsort(low, kind="stable")
    first = np.flatnonzero(np.diff(low[order], prepend=low[order[:1]] ^ np.uint32(1)))
    sums = np.add.reduceat(counts[order].astype(np.int64), first)
    total = np.empty(len(low), np.uint8)
    total[order] = np.repeat(np.minimum(sums, 255), np.diff(np.append(first, len(low)))).astype(np.uint8)
    ends = np.cumsum([len(b[0]) for b in blocks])
    packer = zstandard.ZstdCompressor(level=1)
    return pa.table(
        {
            "chunk": table["chunk"],
            "bucket": table["bucket"],
            "counts": pa.array(
                [packer.compress(part.tobytes()) for part in np.split(total, ends[:-1])], pa.binary()
            ),
        }
    )


def count_keys(blocks: DataFrame) -> DataFrame:
    """For the keys of every block, in their order, how often they occur in all blocks (255: or more).

    Remainders of 32 bits within buckets whose number follows the data: a count may be too high
    where two keys clash, never too low. Callers take it as a filter and decide exactly later.
    """
    return blocks.groupBy("bucket").applyInArrow(_count_bucket, REPLY_SCHEMA)


def read_counts(keys: np.ndarray, buckets: int, replies: dict[int, bytes]) -> np.ndarray:
    """Counts of a chunk's distinct keys, from the replies to its blocks by bucket."""
    import zstandard

    order, cuts, _ = split_keys(keys, buckets)
    out = np.zeros(len(keys), np.uint8)
    for b, packed in replies.items():
        out[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return out


# ---- hashing of words ----------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of runs of symbols from running sums: of symbols at [start, end), whatever their place."""

    def __init__(self, base: int = _BASE):
        self.base = base
        self.inverse = pow(base, -1, 2**64)
        self.up = powers(base, 1 << 16)
        self.down = powers(self.inverse, 1 << 16)

    def room(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        self.room(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=sums[1:])
        return sums

    def runs(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each [start, end), given in order and apart; long inputs go slice by slice."""
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            base = start[i]
            j = max(i + 1, int(np.searchsorted(end, base + _SLICE, side="right")))
            sums = self._sums(codes[base : end[j - 1]])
            at = start[i:j] - base
            out[i:j] = mixed((sums[end[i:j] - base] - sums[at]) * self.down[at])
            i = j
        return out

    def windows(self, codes: np.ndarray, width: int) -> np.ndarray:
        """Hash of every `width` consecutive symbols; long inputs go slice by slice."""
        n = len(codes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.empty(n, np.uint64)
        for a in range(0, n, _SLICE):
            m = min(_SLICE, n - a)
            sums = self._sums(codes[a : a + m + width - 1])
            out[a : a + m] = mixed((sums[width:] - sums[:m]) * self.down[:m])
        return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes; white space is space and 09 to 0D."""
    gap = np.empty(len(data) + 2, bool)
    gap[0] = gap[-1] = True
    np.take(_SPACE, data, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` consecutive ones, by running minima of blocks from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    left = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).ravel()
    right = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])
