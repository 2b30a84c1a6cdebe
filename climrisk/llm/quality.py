"""Quality by the votes of the nearest labelled documents in a latent semantic space.

A text becomes weighted counts of hashed byte trigrams and steps of how much it repeats itself;
singular vectors of a bounded labelled sample project it. The labelled vectors go to every task,
which computes all cosines of its documents with them, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.llm.common import Rolling, byte_codes, word_spans, worker_cache
from climrisk.llm.labels import held_out, training_rows

#: Hashed trigrams, latent dimensions, labelled rows at most, neighbours, weight of the repetition steps.
TERMS, LATENT, SAMPLE, NEIGHBOURS, STEP_WEIGHT = 4096, 32, 6000, 16, 0.3
#: Shares of repeated neighbours and of repeated word 4-grams at which a step is passed.
STEPS = np.array([0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
WIDTH = TERMS + 2 * len(STEPS)
_SLICE = 1 << 20


def features(text: str) -> np.ndarray:
    """Logarithms of trigram counts, then the steps passed; zeros for an empty text."""
    tools = worker_cache("quality")
    if not tools.get("rolling"):
        tools.update(rolling=Rolling(), codes=byte_codes())
    out = np.zeros(WIDTH, np.float32)
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(TERMS, np.int64)
    shift = np.uint32(32 - (TERMS - 1).bit_length())
    for a in range(0, max(0, len(data) - 2), _SLICE):
        c = data[a : a + _SLICE + 2].astype(np.uint32)
        k = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
        counts += np.bincount((k * np.uint32(0x27D4EB2F)) >> shift, minlength=TERMS)
    out[:TERMS] = np.log1p(counts)
    starts, ends = word_spans(data)
    if len(starts) > 1:
        words = tools["rolling"].runs(tools["codes"][data], starts, ends)
        beside = (words[1:] == words[:-1]).mean()
        grams = tools["rolling"].windows(words, 4)
        again = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
        out[TERMS:] = np.concatenate([beside > STEPS, again > STEPS])
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    terms = _unit(rows[:, :TERMS] * idf)
    return _unit(np.concatenate([terms, rows[:, TERMS:] * np.float32(STEP_WEIGHT)], axis=1))


def _fit(table: pa.Table) -> pa.Table:
    """Inverse document frequencies, projection and labelled vectors of the sample."""
    rows = np.stack([np.frombuffer(b, np.float16) for b in table["features"].to_pylist()]).astype(np.float32)
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    rows, ids, label = rows[order], table["doc_id"].to_numpy()[order], table["label"].to_numpy()[order]
    idf = (np.log((1 + len(rows)) / (1 + (rows[:, :TERMS] > 0).sum(axis=0))) + 1).astype(np.float32)
    base = weighted(rows, idf)
    del rows
    # Subspace iteration from a fixed start finds the leading right singular vectors.
    wide = min(LATENT + 16, *base.shape)
    span = np.random.default_rng(0).standard_normal((base.shape[1], wide)).astype(np.float32)
    for _ in range(5):
        span, _ = np.linalg.qr(base.T @ (base @ span))
    _, _, turn = np.linalg.svd(base @ span, full_matrices=False)
    project = (span @ turn.T)[:, :LATENT].astype(np.float32)
    vectors = _unit(base @ project).astype(np.float32)
    return pa.table(
        {
            name: pa.array([value.tobytes()], pa.binary())
            for name, value in (("idf", idf), ("project", project), ("vectors", vectors), ("ids", ids.astype(np.int64)), ("label", label.astype(np.float32)))
        }
    )


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = SAMPLE) -> dict[str, np.ndarray]:
    """The model of at most `limit` labelled rows; a few MB whatever the corpus."""
    sample = training_rows(docs, labels, column, limit)

    def encode(batches):
        for batch in batches:
            packed = [features(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array(packed, pa.binary())],
                ["doc_id", "label", "features"],
            )

    coded = sample.mapInArrow(encode, "doc_id long, label int, features binary")
    row = coded.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit, "idf binary, project binary, vectors binary, ids binary, label binary").first()
    if row is None:
        return {}
    model = {c: np.frombuffer(row[c], np.int64 if c == "ids" else np.float32) for c in ("idf", "project", "vectors", "ids", "label")}
    depth = len(model["project"]) // WIDTH
    model["project"], model["vectors"] = model["project"].reshape(WIDTH, depth), model["vectors"].reshape(-1, depth)
    return model


def votes(rows: np.ndarray, ids: np.ndarray, model: dict[str, np.ndarray], k: int = NEIGHBOURS) -> np.ndarray:
    """Score of each row: labels of its k nearest labelled vectors weighted by cosine to the 8th power.

    A labelled document has no vote on itself. Where no cosine is positive the share of label 1 counts.
    """
    near = _unit(weighted(rows, model["idf"]) @ model["project"]) @ model["vectors"].T
    near[ids[:, None] == model["ids"][None, :]] = 0
    k = min(k, near.shape[1])
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** 8
    total = weight.sum(axis=1)
    share = (weight * model["label"][best]).sum(axis=1) / np.maximum(total, 1e-30)
    return np.clip(np.where(total > 1e-12, share, model["label"].mean()), 0, 1)


def score(docs: DataFrame, model: dict[str, np.ndarray], k: int = NEIGHBOURS) -> DataFrame:
    """doc_id and score of every row, in [0, 1]; a null text is empty. Without labelled rows: 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned = shared.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            out = np.full(len(texts), 0.5)
            key = np.array([-1 if i is None else i for i in ids.to_pylist()], np.int64)
            for a in range(0, len(texts) if learned else 0, 512):
                block = np.stack([features(t or "") for t in texts[a : a + 512]])
                out[a : a + 512] = votes(block, key[a : a + 512], learned, k)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good) of every row, fitted on `labels`."""
    scored = score(docs, fit(docs, labels, limit=limit))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that are not rejected, all columns kept. Equal doc_ids are kept together."""
    rejected = (
        classify(docs, labels, threshold).groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0").select("doc_id")
    )
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")
