"""Best-fit packing of token sequences by sums of squares.

A piece goes where the sum of squared counts of open bins per gap becomes smallest. Groups of
pieces pack apart, each in one task; their number follows the number of pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.llm.common import pieces, staged
from climrisk.llm.tokens import default_path, encoder, texts_of

#: Pieces that pack in one task.
GROUP = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, limit: int = 4096, end: int = 1, path: str | None = None, ids: bool = False) -> DataFrame:
    """Pieces of at most `limit` tokens of every document, its end token included.

    Only documents over the limit are cut. A null text is empty: one piece with the end token.
    Rows with equal or null doc_id are cut each. ids=True adds the ids themselves (array<int>).
    """
    path = path or default_path()
    last = np.array([end], "<u4").tobytes()
    step = 4 * limit
    schema = PIECES + (", ids array<int>" if ids else "")

    def run(batches):
        encode = encoder(path)
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*[r[:5] for r in rows], strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            if ids:
                arrays.append(pa.array([np.frombuffer(r[5], "<i4") for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for doc_id, text in texts_of(batches):
            data = encode(text) + last
            for piece, at in enumerate(range(0, len(data), step)):
                block = data[at : at + step]
                rows.append((doc_id, piece, at // 4, len(block) // 4, zlib.crc32(block), block))
                if not ids:
                    rows[-1] = rows[-1][:5]
            if len(rows) >= (256 if ids else 8192):
                yield flush()
                rows.clear()
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and place of each length, in the given order, and the number of bins.

    Moving a bin from gap g to g - s changes the sum of squared counts N by 2 (N[g-s] - N[g] + 1),
    and by 1 - 2 N[g] where it fills the bin, as full bins aren't counted. The gap that lowers the
    sum most is taken, of equals the smallest. A new bin is opened only where no gap fits: with
    pieces from long to short that needs fewer bins than weighing a new bin like any other gap.
    """
    count = np.zeros(limit + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, places, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        fits = count[s:]
        gain = 2 * (fits - count[: limit + 1 - s])
        gain[0] += 1
        gain[fits == 0] = -(1 << 60)
        gain[limit - s] = -(1 << 59)
        g = s + int(np.argmax(gain))
        if g == limit:
            b, made = made, made + 1
        else:
            b = stacks[g].pop()
            count[g] -= 1
        bins[i], places[i] = b, limit - g
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return bins, places, made


def _pack_group(table: pa.Table, limit: int, groups: int) -> pa.Table:
    length = table["length"].to_numpy()
    # Longest first; the rest of the order only makes the result repeatable.
    order = np.lexsort((table["ids_crc32"].to_numpy(), table["start"].to_numpy(), table["doc_id"].to_numpy(zero_copy_only=False), -length))
    bins, places, _ = sum_of_squares(length[order], limit)
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    sequence[order], offset[order] = bins, places
    group = table["group"].to_numpy().astype(np.int64)
    return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence * groups + group)).append_column("offset", pa.array(offset))


def pack(cuts: DataFrame, limit: int = 4096, each: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `limit` tokens; offsets are gapless from 0.

    Pieces are dealt to groups by a hash of all they are, so copies of a row spread as well.
    """
    groups = pieces(cuts.count(), each)
    dealt = cuts.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"{n} {t}" for n, t in cuts.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(lambda t: _pack_group(t, limit, groups), schema)


def pack_documents(docs: DataFrame, limit: int = 4096, end: int = 1, path: str | None = None, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places. Empty input gives no rows."""
    return pack(staged(cut(docs, limit, end, path, ids)), limit)
