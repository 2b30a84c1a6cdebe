"""Repeated word windows by prefix-partitioned suffix trees.

1. Each window of words has a seed, the least hash of the short word runs in it. Equal windows
   have equal seeds, so a window whose seed no other document has is unique and goes no further.
2. Prefixes of suffixes that hold more than their share are lengthened word by word; every suffix
   left goes to the group of its shortest prefix that isn't too common. A group fits one task.
3. A group sorts its suffixes into a subtree; an internal node as deep as the window is a repeat,
   and it learns the smallest document below it.
4. Each chunk hears of its windows and removes the words they cover.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.llm.chunks import BITS, COUNTS, Chunk, as_side, chunked, copies, steps
from climrisk.llm.common import BLOCK_SCHEMA, BUCKET_KEYS, CHUNK_BYTES, Rolling, byte_codes, count_keys, key_blocks, pieces, read_counts, sliding_least, word_spans, worker_cache

SUFFIXES = "bucket int, chunk int, suffixes binary, first_docs binary"
BIT_ROWS = "chunk int, bucket int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, text string"


class Words:
    """Words of one text: joined by single spaces, with their places and the seeds of its windows."""

    def __init__(self, text: bytes, width: int):
        tools = worker_cache("substrings")
        if "rolling" not in tools:
            tools.update(bytes=Rolling(), rolling=Rolling(0xD6E8FEB86659FD93), codes=byte_codes())
        self.joined = b" ".join(text.split())
        data = np.frombuffer(self.joined, np.uint8)
        self.starts, self.ends = word_spans(data)
        self.count = len(self.starts)
        self.seeds = np.zeros(0, np.uint64)
        if self.count >= width:
            hashes = tools["bytes"].runs(tools["codes"][data], self.starts, self.ends)
            short = width // 2 + 1
            self.seeds = sliding_least(tools["rolling"].windows(hashes, short), width - short + 1)


def _taking_part(chunk: Chunk, width: int) -> list[tuple[int, int, Words]]:
    """Number, id and words of the texts that are compared: of exact copies only those of the smallest id."""
    if "words" not in chunk.kept:
        chunk.kept["words"] = [
            (i, key, words)
            for i, (key, text, copied) in enumerate(zip(chunk.keys, chunk.texts, chunk.copied, strict=True))
            if copied is None or key <= copied[0]
            if len((words := Words(text, width)).seeds)
        ]
    return chunk.kept["words"]


def _seed_counts(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(words.seeds) for _, _, words in _taking_part(chunk, width)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _suspects(chunk: Chunk, width: int, buckets: int) -> list[tuple[int, int, Words, np.ndarray]]:
    """Number, id, words and places of the windows whose seed occurs in more than one text."""
    if "suspects" not in chunk.kept:
        keys, _ = _seed_counts(chunk, width)
        repeated = keys[read_counts(keys, buckets, chunk.replies[COUNTS]) > 1]
        found = chunk.kept["suspects"] = []
        for i, key, words in _taking_part(chunk, width) if len(repeated) else ():
            at = np.minimum(np.searchsorted(repeated, words.seeds), len(repeated) - 1)
            places = np.flatnonzero(repeated[at] == words.seeds)
            if len(places):
                found.append((i, key, words, places))
    return chunk.kept["suspects"]


def prefix_of(joined: bytes, starts: np.ndarray, ends: np.ndarray, at: int, width: int, common: set[bytes]) -> bytes:
    """The shortest prefix of the suffix at a word that isn't too common, of at most `width` words."""
    start = starts[at]
    for depth in range(width):
        prefix = joined[start : ends[at + depth]]
        if prefix not in common:
            break
    return prefix


def _local_suffixes(chunk: Chunk, width: int, buckets: int, common: set[bytes], groups: int):
    """Distinct suffixes of the suspects, cut at `width` words, by group; and who has them first.

    Sorted within a group, so every step that builds them meets them in the same order. Texts come
    in order of doc_id: whoever brings a suffix first has the smallest id in this chunk.
    """
    first: dict[bytes, int] = {}
    by_group: dict[int, list[bytes]] = {}
    for _, key, words, places in _suspects(chunk, width, buckets):
        joined, starts, ends = words.joined, words.starts.tolist(), words.ends.tolist()
        for at in places.tolist():
            suffix = joined[starts[at] : ends[at + width - 1]]
            if suffix not in first:
                first[suffix] = key
                prefix = prefix_of(joined, starts, ends, at, width, common)
                by_group.setdefault(zlib.crc32(prefix) % groups, []).append(suffix)
    return first, {g: sorted(s) for g, s in by_group.items()}


class Subtree:
    """The subtree of one group: its suffixes in order, and nodes where neighbours agree to full depth."""

    def __init__(self, suffixes: list[bytes]):
        self.order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        self.node = np.zeros(len(suffixes), np.int64)
        node, last = -1, None
        for i in self.order:
            if suffixes[i] != last:
                node, last = node + 1, suffixes[i]
            self.node[i] = node
        self.nodes = node + 1

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each suffix, the least value below its deep node."""
        least = np.full(self.nodes, np.iinfo(np.int64).max)
        np.minimum.at(least, self.node, values)
        return least[self.node]


def _grow(table: pa.Table) -> pa.Table:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    blocks = [open_(b).split(b"\n") for b in table["suffixes"].to_pylist()]
    own = [np.frombuffer(b, np.int64) for b in table["first_docs"].to_pylist()]
    tree = Subtree([s for block in blocks for s in block])
    first = np.concatenate(own)
    earlier = tree.least(first) < first
    cuts = np.cumsum([len(o) for o in own])[:-1]
    return pa.table(
        {
            "chunk": table["chunk"],
            "bucket": table["bucket"],
            "bits": pa.array([np.packbits(part).tobytes() for part in np.split(earlier, cuts)], pa.binary()),
        }
    )


def _covered(places: np.ndarray, width: int, count: int) -> np.ndarray:
    """Which of `count` symbols lie in a window that starts at one of the places."""
    edge = np.zeros(count + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + width, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(removed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs, as (start, end after the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def _too_common(docs: DataFrame, width: int, share: float) -> set[bytes]:
    """Prefixes of 1 to `width` words that begin more than a share of all suffixes.

    A prefix with such a share of all has it in some task, so each task names those of its own, at
    most 1 / share per depth. A depth is counted only below prefixes that the last one found.
    """
    common: set[bytes] = set()
    last: set[bytes] | None = None
    for depth in range(1, width + 1):
        shared = docs.sparkSession.sparkContext.broadcast(last)

        def count(batches, depth=depth, shared=shared):
            above, counts, total = shared.value, {}, 0
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    words = (text or b"").split()
                    total += len(words)
                    if above is None:
                        for w in words:
                            counts[w] = counts.get(w, 0) + 1
                        continue
                    heads = zip(*(words[i:] for i in range(depth - 1)), strict=False)
                    for i, head in enumerate(heads):
                        start = b" ".join(head)
                        if start in above and i + depth <= len(words):
                            start = start + b" " + words[i + depth - 1]
                            counts[start] = counts.get(start, 0) + 1
            named = [p for p, n in counts.items() if n > share * total]
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.binary())], ["prefix"])

        rows = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
        last = {bytes(r["prefix"]) for r in rows.mapInArrow(count, "prefix binary").distinct().collect()}
        if not last:
            break
        common |= last
    return common


def deduplicate(docs: DataFrame, width: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Removes words covered by a window that also starts in a document with a smaller doc_id.

    Words are runs without space and 09-0D, compared as they are. One row per input row: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (removed runs of
    words), text (the kept words). Windows are judged on the input. Null text: no words. A null
    doc_id counts as larger than any. Rows with one doc_id never remove each other's words. Other
    columns are left out; an empty table gives no rows.
    """
    chunks, count, total = chunked(docs, chunk_bytes)
    if not total:
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
            F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit("").alias("text"),
        )
    buckets = pieces(total // 20, BUCKET_KEYS)
    groups = pieces(total, chunk_bytes)
    common = docs.sparkSession.sparkContext.broadcast(_too_common(docs, width, 1 / max(16, groups)))
    same = copies(chunks)

    def seeds(chunk: Chunk) -> pa.Table:
        keys, weights = _seed_counts(chunk, width)
        return key_blocks(chunk.number, keys, weights, buckets)

    def suffixes(chunk: Chunk) -> pa.Table:
        import zstandard

        first, by_group = _local_suffixes(chunk, width, buckets, common.value, groups)
        packer = zstandard.ZstdCompressor(level=3)
        return pa.table(
            {
                "bucket": pa.array(list(by_group), pa.int32()),
                "chunk": pa.array([chunk.number] * len(by_group), pa.int32()),
                "suffixes": pa.array([packer.compress(b"\n".join(s)) for s in by_group.values()], pa.binary()),
                "first_docs": pa.array([np.array([first[x] for x in s], np.int64).tobytes() for s in by_group.values()], pa.binary()),
            }
        )

    def remove(chunk: Chunk) -> pa.Table:
        first, by_group = _local_suffixes(chunk, width, buckets, common.value, groups)
        for group, listed in by_group.items():
            bits = np.unpackbits(np.frombuffer(chunk.replies[BITS][group], np.uint8), count=len(listed))
            for suffix, earlier in zip(listed, bits.tolist(), strict=True):
                if earlier:
                    first[suffix] = -(2**63)
        hits: dict[int, np.ndarray] = {}
        for i, key, words, places in _suspects(chunk, width, buckets):
            joined, starts, ends = words.joined, words.starts.tolist(), words.ends.tolist()
            hits[i] = np.array([at for at in places.tolist() if first[joined[starts[at] : ends[at + width - 1]]] < key], np.int64)
        rows = []
        for i, (doc_id, key, text, copied) in enumerate(zip(chunk.ids, chunk.keys, chunk.texts, chunk.copied, strict=True)):
            words = text.split()
            gone = np.zeros(len(words), bool)
            if copied is not None and key > copied[0]:
                gone[:] = len(words) >= width
            elif i in hits:
                gone = _covered(hits[i], width, len(words))
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans_of(gone)], kept.decode()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
        names = ("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text")
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    counts = as_side(count_keys(steps(chunks, same, seeds, BLOCK_SCHEMA)), COUNTS, "counts")
    known = same.unionByName(counts)
    found = steps(chunks, known, suffixes, SUFFIXES).groupBy("bucket").applyInArrow(_grow, BIT_ROWS)
    return steps(chunks, known.unionByName(as_side(found, BITS, "bits")), remove, RESULT)
