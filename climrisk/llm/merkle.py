"""Merkle manifest of a dataset, kept as postorder append logs.

A tree has runs of eight: while a level has several nodes, every eight consecutive ones become their
parent. Rows are leaves of the tree of their language; the roots of those trees are the leaves of the
last tree. Builders work on aligned blocks of 512 nodes: each writes its nodes in the order in which
they are completed, a parent right after its last child. Where a node lies in such a log follows from
the sizes of the subtrees that are complete before it, so a proof addresses siblings without a search
or an index. The tops of the blocks are the nodes of the next tier, which is built in the same way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climrisk.llm.common import running_before, staged

#: Children of a node, and levels that one builder adds.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

SEGMENT = "tree string, block long, nodes long, inputs int, levels int, top string, log array<string>, doc_id array<long>, changed array<string>"
PATH = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder log of a tree with so many leaves.

    All that is complete before a node: the leaves up to its last one and, of each level, the
    parents whose last leaf lies before; then its own descendants that end with that leaf.
    """
    last, place = min((index + 1) * FAN**level, leaves) - 1, level
    while last:
        place, last = place + last, last // FAN
    return place


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def append_log(nodes: list[str], levels: int) -> list[str]:
    """The nodes and their parents up to `levels`, in the order of completion."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def append(node: str, level: int) -> None:
        log.append(node)
        if level < levels:
            runs[level].append(node)
            if len(runs[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        parent, runs[level] = digest("".join(runs[level])), []
        append(parent, level + 1)

    for node in nodes:
        append(node, 0)
    for level in range(levels):
        if runs[level]:
            close(level)
    return log


def _build(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["number"])
    nodes = rows[0]["nodes"]
    levels = LEVELS if nodes > BLOCK else height(nodes)
    log = append_log([r["digest"] for r in rows], levels)
    leaves = [r for r in rows if r["leaf"]]
    return pa.table(
        {
            "tree": [rows[0]["tree"]],
            "block": pa.array([rows[0]["block"]], pa.int64()),
            "nodes": pa.array([nodes], pa.int64()),
            "inputs": pa.array([len(rows)], pa.int32()),
            "levels": pa.array([levels], pa.int32()),
            "top": [log[-1]],
            "log": pa.array([log], pa.list_(pa.string())),
            "doc_id": pa.array([[r["doc_id"] for r in leaves]], pa.list_(pa.int64())),
            "changed": pa.array([[r["changed"] for r in leaves]], pa.list_(pa.string())),
        }
    )


def build(nodes: DataFrame) -> list[DataFrame]:
    """Segments of the logs of all trees, tier by tier.

    `nodes`: tree, number (from 0), nodes (how many the tree has), digest, leaf (whether doc_id and
    changed go along), doc_id, changed. A tier is one table; a tree ends in the tier where it fits one block.
    """
    tiers: list[DataFrame] = []
    while True:
        dealt = nodes.withColumn("block", F.floor(F.col("number") / BLOCK))
        tier = staged(dealt.groupBy("tree", "block").applyInArrow(_build, SEGMENT))
        tiers.append(tier)
        above = tier.where(F.col("nodes") > BLOCK)
        if above.isEmpty():
            return tiers
        nodes = above.select(
            "tree",
            F.col("block").alias("number"),
            F.ceil(F.col("nodes") / BLOCK).alias("nodes"),
            F.col("top").alias("digest"),
            F.lit(False).alias("leaf"),
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("string").alias("changed"),
        )


class Siblings:
    """Reads the siblings of a block's inputs out of its log, by position."""

    def __init__(self, log: list[str], inputs: int, levels: int):
        self.log, self.levels = log, levels
        self.places, width = [], inputs
        for level in range(levels):
            self.places.append([position(level, j, inputs) for j in range(width)])
            width = -(-width // FAN)

    def of(self, index: int) -> tuple[list[str], list[str]]:
        """Left and right siblings of an input and of the nodes above it within the block."""
        lefts, rights = [], []
        for places in self.places:
            first = index - index % FAN
            run = [self.log[p] for p in places[first : first + FAN]]
            lefts.append("".join(run[: index - first]))
            rights.append("".join(run[index - first + 1 :]))
            index //= FAN
        return lefts, rights


def _paths(table: pa.Table) -> pa.Table:
    """For every input of the blocks: siblings from it to the root of all."""
    out = []
    for r in table.to_pylist():
        siblings = Siblings(r["log"], r["inputs"], r["levels"])
        for i in range(r["inputs"]):
            lefts, rights = siblings.of(i)
            out.append((r["tree"], r["block"] * BLOCK + i, lefts + r["lefts"], rights + r["rights"], r["subroot"], r["root"]))
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string())
    names = ("tree", "block", "lefts", "rights", "subroot", "root")
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _proofs(table: pa.Table) -> pa.Table:
    """Proof of every leaf of the blocks, and what its changed or own digest folds to."""
    out = []
    for r in table.to_pylist():
        siblings = Siblings(r["log"], r["inputs"], r["levels"])
        above = "".join(a + b for a, b in zip(r["lefts"], r["rights"], strict=True))
        known: dict[tuple[int, int, str], str] = {}
        for i, (doc_id, changed) in enumerate(zip(r["doc_id"], r["changed"], strict=True)):
            own = r["log"][position(0, i, r["inputs"])]
            lefts, rights = siblings.of(i)
            proof = digest("".join(a + b for a, b in zip(lefts, rights, strict=True)) + above)
            node, index = changed or own, i
            for level, (a, b) in enumerate(zip(lefts + r["lefts"], rights + r["rights"], strict=True)):
                # Nodes that several leaves of the block fold through are computed once.
                key = (level, index, node)
                if key not in known:
                    known[key] = digest(a + node + b)
                node, index = known[key], index // FAN
            out.append((doc_id, own, r["subroot"], r["root"], proof, node, node == r["root"]))
    kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def resolve(tiers: list[DataFrame], ends: DataFrame, leaves, schema: str) -> DataFrame:
    """Walks the tiers from the top down; `ends`: tree, lefts, rights, subroot, root of each tree's root.

    Each block gets the siblings above its top, which all its inputs share; `leaves` makes the rows of
    the lowest tier. One block is one group, so a task holds one block at a time.
    """
    above = None
    for tier in reversed(tiers):
        tops = tier.where(F.col("nodes") <= BLOCK).select("tree", "block").join(ends, "tree")
        paths = tops if above is None else tops.unionByName(above)
        met = tier.join(paths, ["tree", "block"]).groupBy("tree", "block")
        lowest = tier is tiers[0]
        above = met.applyInArrow(leaves if lowest else _paths, schema if lowest else PATH)
        if not lowest:
            above = staged(above)
    return above


def _part(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, lang, doc_id, digest, changed: the leaf of each row and, where its text was tampered with, the other one."""
    parts = {c: _part(F.col(c)) for c in COLUMNS}
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.concat(*(parts | {"text": _part(lowered)}).values())
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        parts["lang"].alias("tree"),
        F.col("lang").cast("string").alias("lang"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.concat(*parts.values()), 256).alias("digest"),
        F.when(hit, F.sha2(tampered, 256)).alias("changed"),
    )


class Manifest:
    """The logs of a dataset: `forest` has the trees of the languages, `crown` the one over their roots."""

    def __init__(self, docs: DataFrame):
        rows = staged(leaves(docs))
        ranked = running_before(rows, "tree", ["doc_id", "digest"], F.lit(1), "number")
        ranked = ranked.withColumnRenamed("number_all", "nodes").withColumn("leaf", F.lit(True))
        self.forest = build(ranked)
        self.langs = staged(rows.groupBy("tree").agg(F.min("lang").alias("lang"), F.count("*").alias("leaves")))
        roots = self._tops(self.forest).join(self.langs.select(F.col("tree").alias("member"), "lang"), "member")
        ordered = running_before(staged(roots.withColumn("tree", F.lit(""))), "tree", ["lang"], F.lit(1), "number")
        self.members = staged(ordered.withColumnRenamed("number_all", "nodes"))
        inner = self.members.withColumns({"leaf": F.lit(False), "doc_id": F.lit(None).cast("long"), "changed": F.lit(None).cast("string")})
        self.crown = build(inner)

    @staticmethod
    def _tops(tiers: list[DataFrame]) -> DataFrame:
        """member, digest: the root of every tree."""
        found = [t.where(F.col("nodes") <= BLOCK).select(F.col("tree").alias("member"), F.col("top").alias("digest")) for t in tiers]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def log(self) -> DataFrame:
        """lang, position, level, number, digest: the postorder log of every language's tree, without gaps from 0."""
        out = None
        for t, tier in enumerate(self.forest):
            rows = tier.join(self.langs, "tree").groupBy("tree", "block").applyInArrow(_log_rows(t), "lang string, position long, level int, number long, digest string")
            out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
        empty = F.array().cast("array<string>")
        root = self._tops(self.crown).select(F.lit("").alias("tree"), empty.alias("lefts"), empty.alias("rights"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
        paths = resolve(self.crown, root, _paths, PATH)
        ends = self.members.select(F.col("member").alias("tree"), F.col("number").alias("block"), F.col("digest").alias("subroot"))
        ends = staged(paths.drop("tree", "subroot").join(ends, "block").select("tree", "lefts", "rights", "subroot", "root"))
        return resolve(self.forest, ends, _proofs, PROOF)


def _log_rows(tier: int):
    """Rows of the whole log that a block of a tier adds; the inputs of upper tiers are tops of the tier below."""

    def rows(table: pa.Table) -> pa.Table:
        out = []
        for r in table.to_pylist():
            width = r["inputs"]
            for level in range(r["levels"] + 1):
                first, whole = r["block"] * BLOCK // FAN**level, tier * LEVELS + level
                for j in range(width) if level or not tier else ():
                    out.append((r["lang"], position(whole, first + j, r["leaves"]), whole, first + j, r["log"][position(level, j, r["inputs"])]))
                width = -(-width // FAN)
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        names = ("lang", "position", "level", "number", "digest")
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return rows


def prove(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of `docs`.

    `docs` needs doc_id, source, lang, n_chars and text; other columns are not looked at. Any of the five
    may be null: its part of the leaf is `-`, a null lang is a tree of its own and the first one, a null
    doc_id comes first in its tree and is never tampered with. Rows with an equal doc_id are ordered by
    their leaves, equal rows have a leaf each. Empty texts are `0:`. No rows: no rows.
    """
    return Manifest(docs).proofs()
