"""Similarity join of documents on sets of word shingles, by T-occurrence search with DivideSkip.

1. A set that several rows have stands once, for its smallest doc_id.
2. Tasks count in how many sets a shingle occurs. A set can only have a partner if as many of its
   shingles occur elsewhere as the least overlap; few sets remain.
3. Rarest first, the shingles a partner must share one of are a set's prefix. Sets that share a
   prefix shingle, over any number of steps, form a group; no link leaves it.
4. A group is searched set by set: the short inverted lists are merged, the longest T - 1 or fewer
   are probed by binary search, and sets met often enough are partners. Partners that are already
   connected aren't probed again, so a group of copies gives a tree of links, not all pairs.
5. Links of all groups give the components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.llm.chunks import COPIES, COUNTS, Chunk, as_side, chunked, steps
from climrisk.llm.common import BLOCK_SCHEMA, BUCKET_KEYS, CHUNK_BYTES, Rolling, byte_codes, count_keys, key_blocks, pieces, read_counts, staged, word_spans, worker_cache
from climrisk.llm.components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles of one search block; a larger group is searched block against block.
BLOCK_SHINGLES = 4 << 20
SETS = "chunk int, doc_id long, n_shingles long, digest binary"
LIVE = "doc_id long, size int, prefix int, shingles binary"


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of words; a shorter text is one run, an empty one none."""
    tools = worker_cache("jaccard")
    if "rolling" not in tools:
        tools.update(bytes=Rolling(), rolling=Rolling(0xD6E8FEB86659FD93), codes=byte_codes())
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = tools["bytes"].runs(tools["codes"][data], starts, ends)
    width = min(words_each, len(words))
    return np.unique(tools["rolling"].windows(words, width) + np.uint64(width))


def least_overlap(size: int, percent: int) -> int:
    """Fewest shingles that a set of this size shares with any partner."""
    return -(-percent * size // 100)


def linked(overlap, one, other, percent: int):
    return 100 * overlap >= percent * (one + other - overlap)


def _sets(chunk: Chunk, words_each: int) -> list[tuple[object, np.ndarray, bytes]]:
    """(doc_id, set, digest) of every row of the chunk, in its order; equal texts are hashed once."""
    if "sets" not in chunk.kept:
        out, last, made = [], None, None
        for doc_id, text in zip(chunk.ids, chunk.texts, strict=True):
            if text != last:
                found = shingle_set(text, words_each)
                last, made = text, (found, hashlib.sha256(found.tobytes()).digest())
            out.append((doc_id, *made))
        chunk.kept["sets"] = out
    return chunk.kept["sets"]


def _taking_part(chunk: Chunk, words_each: int):
    """doc_id and set of the rows that stand for their set."""
    done = set()
    for doc_id, found, digest in _sets(chunk, words_each):
        if doc_id is None or not len(found) or digest in done:
            continue
        first = chunk.copies.get(digest)
        if first is None or first == (doc_id, chunk.number):
            done.add(digest)
            yield doc_id, found


def _shingle_counts(chunk: Chunk, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    found = [s for _, s in _taking_part(chunk, words_each)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


# ---- search in one group -------------------------------------------------------------------


class Index:
    """Inverted lists of sets: places of the sets that have a shingle, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.owner = owner[order]
        begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.shingles, self.begin, self.end = flat[begin], begin, np.append(begin[1:], len(flat))

    def lists(self, shingles: np.ndarray, below: int) -> list[np.ndarray]:
        """Lists of the shingles, cut before place `below`, short ones first; empty ones left out."""
        at = np.searchsorted(self.shingles, shingles)
        at = at[at < len(self.shingles)] if len(at) else at
        out = []
        for k in at[np.isin(self.shingles[at], shingles)].tolist():
            one = self.owner[self.begin[k] : self.end[k]]
            one = one[: np.searchsorted(one, below)]
            if len(one):
                out.append(one)
        return sorted(out, key=len)


def divide_skip(lists: list[np.ndarray], least: int, skip) -> tuple[np.ndarray, np.ndarray]:
    """Places that occur in at least `least` lists, and in how many; `lists` come short ones first.

    The long lists, fewer than `least`, are left out of the merge: a place that is in enough lists
    is in `least - long` of the others. `skip(places)` marks places that needn't be probed.
    """
    none = np.zeros(0, np.int64)
    if len(lists) < least:
        return none, none
    # The share of long lists that balances merging against probing.
    long = min(least - 1, int(least / (0.0085 * math.log2(len(lists[-1]) + 1) + 1)))
    cut = len(lists) - long
    merged = np.bincount(np.concatenate(lists[:cut])) if cut else np.zeros(1, np.int64)
    places = np.flatnonzero(merged >= max(1, least - long))
    places = places[~skip(places)]
    times = merged[places]
    for done, one in enumerate(lists[cut:]):
        alive = times + (long - done) >= least
        places, times = places[alive], times[alive]
        if not len(places):
            break
        at = np.minimum(np.searchsorted(one, places), len(one) - 1)
        times = times + (one[at] == places)
    enough = times >= least
    return places[enough], times[enough]


def search_group(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever the group's sets connect, as pairs of ids.

    side: 0 or 1 where two blocks meet, then only links between them count; all 0 for one block.
    """
    order = np.lexsort((ids, sizes))
    ids, sizes, sets, side = ids[order], sizes[order], [sets[i] for i in order], side[order]
    index, root, found = Index(sets), np.arange(len(sets)), []
    across = bool(side.any())
    for x in range(len(sets)):
        size = int(sizes[x])
        least = least_overlap(size, percent)
        # Partners before x are no larger, and at least percent / 100 of its size.
        lists = index.lists(sets[x], x)
        too_small = sizes * 100 < percent * size

        def skip(places, x=x, too_small=too_small):
            out = (root[places] == root[x]) | too_small[places]
            return out | (side[places] == side[x]) if across else out

        places, times = divide_skip(lists, least, skip)
        for y in places[linked(times, size, sizes[places], percent)].tolist():
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                found.append((int(ids[x]), int(ids[y])))
    return found


def _search(table: pa.Table, percent: int) -> pa.Table:
    sets = [np.sort(np.frombuffer(b, np.uint64)) for b in table["shingles"].to_pylist()]
    block = table["block"].to_numpy()
    side = (block != block.min()).astype(np.int8)
    found = search_group(table["doc_id"].to_numpy(), table["size"].to_numpy(), sets, side, percent)
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _links(live: DataFrame, percent: int) -> DataFrame:
    """Edges a, b between the sets of `live`."""

    def heads(batches):
        for batch in batches:
            ids, cut = batch.column("doc_id").to_pylist(), batch.column("prefix").to_pylist()
            packed = batch.column("shingles").to_pylist()
            shingles = np.concatenate([np.frombuffer(b, np.int64, n) for b, n in zip(packed, cut, strict=True)]) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(np.repeat(np.array(ids, np.int64), cut))], ["shingle", "doc_id"])

    prefixes = live.mapInArrow(heads, "shingle long, doc_id long")
    low = prefixes.groupBy("shingle").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    group = components(
        prefixes.join(low, "shingle").where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    )
    rows = live.join(group.withColumnRenamed("node", "doc_id"), "doc_id")
    sizes = rows.groupBy("root").agg(F.sum(F.octet_length("shingles") / 8).cast("long").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    dealt = (
        rows.join(sizes.withColumn("blocks", blocks).drop("total"), "root")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"), "block", "doc_id", "size", "shingles")
    )
    return dealt.groupBy("root", "low", "high").applyInArrow(lambda t: _search(t, percent), "a long, b long")


# ---- the operator --------------------------------------------------------------------------


def similar(docs: DataFrame, words_each: int = 5, percent: int = 80, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents at least `percent` alike are linked.

    A document's set: hashes (64 bits) of its distinct `words_each`-word shingles, A-Z in lower case;
    with fewer words the whole sequence; a null or empty text has none and is linked with nothing.
    Links: 100 * intersection >= percent * union. component_id: smallest doc_id within reach. Rows
    with equal doc_id are one document with several sets. Rows without doc_id come back unlinked,
    without component_id. Other columns are left out; an empty table gives no rows.
    """
    chunks, _, total = chunked(docs, chunk_bytes)
    buckets = pieces(total // 7, BUCKET_KEYS)
    spark = docs.sparkSession

    def sets(chunk: Chunk) -> pa.Table:
        rows = [(chunk.number, d, len(s), h) for d, s, h in _sets(chunk, words_each)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("chunk", "doc_id", "n_shingles", "digest"), columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    def keys(chunk: Chunk) -> pa.Table:
        return key_blocks(chunk.number, *_shingle_counts(chunk, words_each), buckets)

    def alive(chunk: Chunk) -> pa.Table:
        shingles, _ = _shingle_counts(chunk, words_each)
        counts = read_counts(shingles, buckets, chunk.replies[COUNTS])
        rows = []
        for doc_id, found in _taking_part(chunk, words_each):
            seen = counts[np.searchsorted(shingles, found)]
            shared = seen > 1
            size, least = len(found), least_overlap(len(found), percent)
            if shared.sum() >= least:
                # Shingles of this set alone are the rarest, so they head its prefix.
                prefix = size - least + 1 - int(size - shared.sum())
                order = np.lexsort((found[shared], seen[shared]))
                rows.append((doc_id, size, prefix, found[shared][order].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "size", "prefix", "shingles"), columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)})

    nothing = spark.createDataFrame([], "chunk int, kind int, bucket int, first_doc long, home int, payload binary")
    every = staged(steps(chunks, nothing, sets, SETS))
    known = every.where("doc_id IS NOT NULL AND n_shingles > 0")
    local = known.groupBy("digest", "chunk").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    classes = local.groupBy("digest").agg(F.min(F.struct("doc_id", "chunk")).alias("first"), F.sum("n").alias("n"))
    same = staged(
        local.select("digest", "chunk")
        .join(classes.where("n > 1"), "digest")
        .select("chunk", F.lit(COPIES).alias("kind"), F.lit(0).alias("bucket"), F.col("first.doc_id").alias("first_doc"), F.col("first.chunk").alias("home"), F.col("digest").alias("payload"))
    )
    counts = as_side(count_keys(steps(chunks, same, keys, BLOCK_SCHEMA)), COUNTS, "counts")
    live = staged(steps(chunks, same.unionByName(counts), alive, LIVE))
    links = _links(live, percent)
    # A row is linked to the first row of its set, so rows of one document join its sets.
    members = known.join(classes.select("digest", F.col("first.doc_id").alias("b")), "digest").select(F.col("doc_id").alias("a"), "b")
    reach = components(links.unionByName(members.where("a <> b").distinct()))
    return (
        every.join(reach.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component; all columns kept.

    Rows without doc_id stay. A repeated row is one document: of rows with equal doc_id the one with the
    least text stays, then the one whose other columns come first as JSON.
    """
    stays = (
        similar(docs.select("doc_id", "text"), words_each, percent)
        .where("doc_id = component_id")
        .select(F.col("doc_id").alias("_stays"))
        .distinct()
    )
    named = docs.join(stays, docs["doc_id"] == stays["_stays"], "left_semi")
    first = F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns))))
    named = named.groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return named.unionByName(docs.where("doc_id IS NULL"))
