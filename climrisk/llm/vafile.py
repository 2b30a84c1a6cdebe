"""Exact top-k search by a vector-approximation file.

Every component is put into a cell of its dimension; one byte a component is the approximation.
A block of vectors is searched in two steps: the cells give each inner product an upper and a
lower bound, and exact vectors are then read in the order of their bounds until no unread one
can reach the k-th best result. Blocks give at most k rows a query, which merge to the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climrisk.llm.common import pieces

#: Vectors of one block, and queries met with it at a time.
BLOCK, QUERY_BLOCK = 16_384, 2_048
RESULT = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, values (whole numbers floor(scale * x)), size; rows that can take part.

    Left out: a null vec_id or vector, a null, infinite or NaN component.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & x.isNotNull())
        .where(sound)
        .select("vec_id", F.transform(x, lambda v: F.floor(F.greatest(F.lit(-float(2**63)), F.least(F.lit(float(2**63 - 1024)), v * scale))).cast("long")).alias("values"))
        .withColumn("size", F.size("values"))
    )


class Cells:
    """Cells of one block: `count` equal parts of each dimension's range."""

    def __init__(self, vectors: np.ndarray, count: int):
        self.least = vectors.min(axis=0)
        self.step = np.maximum(1, -(-(vectors.max(axis=0) - self.least + 1) // count))
        self.codes = ((vectors - self.least) // self.step).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with each cell.

        The product with the cell's lowest corner, plus what the rest of the cell can add or take.
        """
        q = queries.astype(np.float64)
        low = (q * self.step) @ self.codes.astype(np.float64).T + (q @ self.least.astype(np.float64))[:, None]
        room = (self.step - 1).astype(np.float64)
        return low + (np.minimum(q, 0) @ room)[:, None], low + (np.maximum(q, 0) @ room)[:, None]


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, cells: int = 64
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of one block for each query, its own id left out."""
    if not queries.shape[1]:
        vectors, queries = np.zeros((len(ids), 1), np.int64), np.zeros((len(queries), 1), np.int64)
    file = Cells(vectors, cells)
    low, high = file.bounds(queries)
    own = query_ids[:, None] == ids[None, :]
    low[own] = high[own] = -np.inf
    found_q, found_v, found_s = [], [], []
    for i, q in enumerate(queries):
        # A vector whose upper bound misses the k-th best lower bound is never read.
        floor = np.partition(low[i], -k)[-k] if len(ids) > k else -np.inf
        near = np.flatnonzero((high[i] >= floor) & (high[i] > -np.inf))
        near = near[np.argsort(-high[i, near], kind="stable")]
        read, best = 0, np.zeros(0, np.int64)
        scores = np.zeros(len(near), np.int64)
        while read < len(near):
            if len(best) >= k and high[i, near[read]] < best[k - 1]:
                break
            upto = min(len(near), max(2 * read, 2 * k))
            scores[read:upto] = vectors[near[read:upto]] @ q
            best = np.sort(scores[:upto])[::-1][:k]
            read = upto
        order = np.lexsort((ids[near[:read]], -scores[:read]))[:k]
        found_q.append(np.full(len(order), query_ids[i]))
        found_v.append(ids[near[order]])
        found_s.append(scores[order])
    return np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["vec_id"].to_numpy()
    flat = table["values"].combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return ids, flat.flatten().to_numpy().reshape(len(ids), -1)


def _exact(vectors: np.ndarray, queries: np.ndarray) -> bool:
    """Whether floats hold every inner product and bound exactly."""
    top = [max(1.0, float(np.abs(v.astype(np.float64)).max(initial=0.0))) for v in (vectors, queries)]
    return max(top) * max(top) * max(1, vectors.shape[1]) < 2**52


def read_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as `search_block` for components too large for exact bounds: every vector is read.

    Scores are whole numbers of any length; one outside of long counts as the nearest long.
    """
    found_q, found_v, found_s = [], [], []
    for own, q in zip(query_ids.tolist(), queries, strict=True):
        at = np.flatnonzero(ids != own)
        total = sum((int(v) * vectors[at, d].astype(object) for d, v in enumerate(q)), np.zeros(len(at), object))
        scores = np.array([min(2**63 - 1, max(-(2**63), int(s))) for s in total], np.int64)
        order = np.lexsort((ids[at], ~scores))[:k]
        found_q.append(np.full(len(order), own))
        found_v.append(ids[at[order]])
        found_s.append(scores[order])
    return np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query.

    Both inputs: vec_id, embedding. A query meets every vector of its own length but those under its
    own vec_id; ties go to the smaller vec_id. Repeated rows stay candidates each; a vec_id that is
    asked repeatedly is asked once, with its smallest vector. No vectors, or none to ask: no rows.
    Blocks with components whose products could leave exact floats are read whole, with whole numbers
    of any length; a component or score outside of long counts as the nearest long.
    """
    rows, asked = usable(vectors, scale), usable(queries, scale)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("values", "size")).alias("q")).select("vec_id", "q.*")
    n, m = rows.count(), asked.count()
    blocks, parts = pieces(n, BLOCK), pieces(m, QUERY_BLOCK)
    # Every pair of a block of vectors and a block of queries is one task-sized group.
    left = rows.select(
        "size", F.pmod(F.xxhash64("vec_id", "values"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "values"
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.select(
        "size", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), "vec_id", "values"
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids, base = _matrix(mine)
        query_ids, ask = _matrix(theirs)
        search_in = search_block if _exact(base, ask) else read_block
        out = [search_in(query_ids[a : a + 256], ask[a : a + 256], ids, base, k) for a in range(0, len(ask), 256)]
        return pa.table({c: pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    keys = ("size", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
