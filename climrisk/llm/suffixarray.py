"""Repeated byte strings by blockwise suffix sorting with a difference cover.

1. The anchor of a long window is the leftmost least hash of the short strings in it; it depends on
   the window's bytes alone. Windows whose anchor string occurs nowhere else are unique.
2. The stretch of windows around every other anchor goes to the suffix bucket of its anchor. Equal
   windows meet in one bucket, and a bucket fits one task; equal stretches are sent once a chunk.
3. A bucket is sorted by itself. Positions whose residue lies in a difference cover get ranks by
   doubling. Suffixes that agree in their first and last bytes are told apart by the ranks at the
   nearest pair of cover positions, so long ties cost one comparison and ranks of a sample only.
4. Each chunk hears which of its windows occur elsewhere and removes the bytes they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.llm.chunks import BITS, COUNTS, Chunk, as_side, chunked, copies, steps
from climrisk.llm.common import BLOCK_SCHEMA, BUCKET_KEYS, CHUNK_BYTES, Rolling, byte_codes, count_keys, key_blocks, pieces, read_counts, sliding_least, worker_cache
from climrisk.llm.substrings import BIT_ROWS, spans_of

STRETCHES = "bucket int, chunk int, sizes binary, times binary, stretches binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
#: Period of the difference cover, and bytes of text whose anchors are found at a time.
PERIOD, _STEP = 16, 1 << 20


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo `period` is one between two of them; greedily few."""
    cover, met = [0], {0}
    while len(met) < period:
        gained = {x: {(x - c) % period for c in cover} | {(c - x) % period for c in cover} for x in range(period)}
        best = max(range(period), key=lambda x: (len(met | gained[x]), -x))
        cover.append(best)
        met |= gained[best]
    return sorted(cover)


# ---- anchors -------------------------------------------------------------------------------


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors of all windows, and the first and last window of each.

    One anchor has one stretch of windows, in order; long texts are done step by step.
    """
    tools = worker_cache("suffixarray")
    if "rolling" not in tools:
        tools.update(rolling=Rolling(), codes=byte_codes())
    short = max(1, width // 6)
    reach, n = width - short + 1, len(data) - width + 1
    hashes, first, last, at = [], [], [], []
    place = np.uint64((1 << 24) - 1)
    for a in range(0, max(0, n), _STEP):
        m = min(_STEP, n - a)
        values = tools["rolling"].windows(tools["codes"][data[a : a + m + width - 1]], short)
        marked = (values & ~place) | np.arange(len(values), dtype=np.uint64)
        least = (sliding_least(marked, reach) & place).astype(np.int64)
        new = np.flatnonzero(np.diff(least, prepend=-1))
        hashes.append(values[least[new]])
        at.append(least[new] + a)
        first.append(new + a)
        last.append(np.append(new[1:], m) - 1 + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, at, first, last = (np.concatenate(x) for x in (hashes, at, first, last))
    # A stretch that crosses a step was found in two parts.
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    return hashes[begins], first[begins], last[np.append(begins[1:], len(at)) - 1]


def _taking_part(chunk: Chunk, width: int) -> list[tuple[int, bytes, tuple]]:
    """Number, bytes and anchors of the texts compared; of exact copies one row stands for all."""
    if "anchors" not in chunk.kept:
        seen: set[bytes] = set()
        out = chunk.kept["anchors"] = []
        for i, (text, copied) in enumerate(zip(chunk.texts, chunk.copied, strict=True)):
            if len(text) < width or copied is not None and (copied[1] != chunk.number or text in seen):
                continue
            if copied is not None:
                seen.add(text)
            out.append((i, text, anchors(np.frombuffer(text, np.uint8), width)))
    return chunk.kept["anchors"]


def _anchor_counts(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    found = [hashes for _, _, (hashes, _, _) in _taking_part(chunk, width)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _suspects(chunk: Chunk, width: int, buckets: int, groups: int) -> list[tuple[int, int, int, bytes]]:
    """(row, first window, suffix bucket, stretch) around every anchor that occurs more than once."""
    keys, _ = _anchor_counts(chunk, width)
    repeated = keys[read_counts(keys, buckets, chunk.replies[COUNTS]) > 1]
    out = []
    for i, text, (hashes, first, last) in _taking_part(chunk, width) if len(repeated) else ():
        at = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
        for j in np.flatnonzero(repeated[at] == hashes).tolist():
            a, b = int(first[j]), int(last[j])
            out.append((i, a, int(hashes[j] % np.uint64(groups)), text[a : b + width]))
    return out


def _by_bucket(suspects: list[tuple[int, int, int, bytes]]) -> dict[int, dict[bytes, int]]:
    """Distinct stretches of each bucket in the order they are met, and how often they are."""
    out: dict[int, dict[bytes, int]] = {}
    for _, _, bucket, stretch in suspects:
        times = out.setdefault(bucket, {})
        times[stretch] = times.get(stretch, 0) + 1
    return out


# ---- one suffix bucket ---------------------------------------------------------------------


def _names(values: np.ndarray) -> np.ndarray:
    """Ranks of values, equal for equal ones."""
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _names((left << np.uint64(32)) | right)


def _later(names: np.ndarray, step: int) -> np.ndarray:
    """What stands `step` places later; 0 beyond the end."""
    out = np.zeros_like(names)
    if step < len(names):
        out[: len(names) - step] = names[step:]
    return out


class Bucket:
    """Equality of suffixes of one text to a depth, by names of short strings and cover ranks."""

    def __init__(self, text: bytes, width: int, period: int = PERIOD):
        self.period, self.n = period, len(text)
        padded = text + bytes(8)
        eight = np.ndarray(self.n, "<u8", padded, strides=(1,)).copy()
        name = _names(eight)
        self.short = _paired(name, _later(name, period - 8)) if period > 8 else name
        cover = difference_cover(period)
        # Cover ranks reach over the whole periods that fit before the last bytes are compared.
        self.whole = (width - period) // period
        self.tails = sorted({width - period, width - 2 * period if width % period else width - period})
        sampled = np.isin(np.arange(self.n) % period, cover)
        self.place = np.cumsum(sampled) - 1
        positions = np.flatnonzero(sampled)
        self.rank = self._ranks(self.short[positions], positions, self.whole)
        self.offset = np.array([[next(d for d in range(period) if (i + d) % period in cover and (j + d) % period in cover) for j in range(period)] for i in range(period)])

    def _ranks(self, one: np.ndarray, positions: np.ndarray, periods: int) -> np.ndarray:
        """Ranks of cover positions over so many periods, doubling; a period later is in the cover too."""
        ahead = lambda k: self.place[np.minimum(positions + k * self.period, self.n - 1)]
        inside = lambda k: positions + k * self.period < self.n
        power, length, out, done = one, 1, None, 0
        while True:
            if periods & length:
                out = power if out is None else _paired(out, np.where(inside(done), power[ahead(done)], 0))
                done += length
            if done == periods:
                return out if out is not None else np.zeros(len(one), np.uint64)
            power, length = _paired(power, np.where(inside(length), power[ahead(length)], 0)), 2 * length

    def classes(self, starts: np.ndarray) -> np.ndarray:
        """A number for each suffix, equal where they agree to full depth."""
        ties = self.short[starts]
        for tail in self.tails:
            ties = _paired(ties, self.short[starts + tail])
        ties = ties.astype(np.int64)
        order = np.argsort(ties, kind="stable")
        out, made = np.empty(len(starts), np.int64), 0
        while len(order):
            # The first of each tie is its pivot; who equals the pivot is done, the others go on.
            tie = ties[order]
            head = np.concatenate([[True], tie[1:] != tie[:-1]])
            number = np.cumsum(head) - 1
            pivot = starts[order[np.flatnonzero(head)]][number]
            mine = starts[order]
            d = self.offset[mine % self.period, pivot % self.period]
            same = self.rank[self.place[mine + d]] == self.rank[self.place[pivot + d]]
            out[order[same]] = made + number[same]
            made += int(number[-1]) + 1
            order = order[~same]
        return out


def _sort_bucket(table: pa.Table, width: int) -> pa.Table:
    """For every stretch of every block, which of its windows occur more than once in all."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    distinct: dict[bytes, list[int]] = {}  # stretch: [number, times]
    listed: list[list[int]] = []
    for sizes, times, block in zip(*(table[c].to_pylist() for c in ("sizes", "times", "stretches")), strict=True):
        data, at, own = open_(block), 0, []
        for size, n in zip(np.frombuffer(sizes, np.int32).tolist(), np.frombuffer(times, np.int32).tolist(), strict=True):
            entry = distinct.setdefault(data[at : at + size], [len(distinct), 0])
            entry[1] += n
            own.append(entry[0])
            at += size
        listed.append(own)
    sizes = np.array([len(s) for s in distinct], np.int64)
    base = np.cumsum(sizes) - sizes
    windows = sizes - width + 1
    cut = np.cumsum(windows)
    starts = np.repeat(base - (cut - windows), windows) + np.arange(cut[-1])
    classes = Bucket(b"".join(distinct), width).classes(starts)
    times = np.repeat(np.array([n for _, n in distinct.values()], np.int64), windows)
    repeated = np.bincount(classes, weights=times)[classes] > 1
    parts = np.split(repeated, cut[:-1])
    packer = zstandard.ZstdCompressor(level=1)
    bits = [packer.compress(np.packbits(np.concatenate([parts[i] for i in own])).tobytes()) for own in listed]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


# ---- the operator --------------------------------------------------------------------------


def deduplicate(docs: DataFrame, width: int = 400, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Removes every byte covered by a `width`-byte string that also starts anywhere else.

    Texts are UTF-8 bytes, null is empty; matches stay within a document, the same document counts
    as elsewhere, overlaps count, and strings are judged on the input. One row per input row:
    doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs), kept (remaining bytes;
    a cut may fall within a character). Repeated rows are documents of their own, so both go. A null
    doc_id is no hindrance. Other columns are left out; an empty table gives no rows. `width` is at
    least 32.
    """
    if width < 2 * PERIOD:
        raise ValueError("width must be at least 32 bytes")
    chunks, _, total = chunked(docs, chunk_bytes)
    if not total:
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
            F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit("").cast("binary").alias("kept"),
        )
    buckets = pieces(total // 100, BUCKET_KEYS)
    groups = pieces(total, chunk_bytes // 2)
    same = copies(chunks)

    def keys(chunk: Chunk) -> pa.Table:
        return key_blocks(chunk.number, *_anchor_counts(chunk, width), buckets)

    def stretches(chunk: Chunk) -> pa.Table:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        found = _by_bucket(_suspects(chunk, width, buckets, groups))
        return pa.table(
            {
                "bucket": pa.array(list(found), pa.int32()),
                "chunk": pa.array([chunk.number] * len(found), pa.int32()),
                "sizes": pa.array([np.array([len(s) for s in x], np.int32).tobytes() for x in found.values()], pa.binary()),
                "times": pa.array([np.array(list(x.values()), np.int32).tobytes() for x in found.values()], pa.binary()),
                "stretches": pa.array([packer.compress(b"".join(x)) for x in found.values()], pa.binary()),
            }
        )

    def remove(chunk: Chunk) -> pa.Table:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        suspects = _suspects(chunk, width, buckets, groups)
        told: dict[int, dict[bytes, np.ndarray]] = {}
        for bucket, listed in _by_bucket(suspects).items():
            windows = [len(s) - width + 1 for s in listed]
            bits = np.unpackbits(np.frombuffer(open_(chunk.replies[BITS][bucket]), np.uint8), count=sum(windows))
            told[bucket] = dict(zip(listed, np.split(bits, np.cumsum(windows)[:-1]), strict=True))
        edges: dict[int, np.ndarray] = {}
        for i, first, bucket, stretch in suspects:
            at = np.flatnonzero(told[bucket][stretch]) + first
            if len(at):
                edge = edges.setdefault(i, np.zeros(len(chunk.texts[i]) + 1, np.int32))
                edge[at] += 1
                edge[at + width] -= 1
        rows = []
        for i, (doc_id, text, copied) in enumerate(zip(chunk.ids, chunk.texts, chunk.copied, strict=True)):
            if copied is not None and len(text) >= width:
                spans, kept = [(0, len(text))], b""
            elif i in edges:
                gone = np.cumsum(edges[i][:-1]) > 0
                spans, kept = spans_of(gone), np.frombuffer(text, np.uint8)[~gone].tobytes()
            else:
                spans, kept = [], text
            rows.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    counts = as_side(count_keys(steps(chunks, same, keys, BLOCK_SCHEMA)), COUNTS, "counts")
    known = same.unionByName(counts)
    sorted_ = steps(chunks, known, stretches, STRETCHES).groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, width), BIT_ROWS)
    return steps(chunks, known.unionByName(as_side(sorted_, BITS, "bits")), remove, RESULT)
