"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word. It is compressed with either dictionary; how many bytes the toxic one saves
is its difference. A document's evidence is the sum of the differences over a calibrated
threshold, relative to the root of the number of windows, and a logistic curve makes it a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.llm.common import Rolling, byte_codes, staged, word_spans, worker_cache
from climrisk.llm.labels import held_out, training_rows

#: Labelled rows at most, words in each training text at most, dictionary bytes, compression level.
SAMPLE, VOCABULARY, DICTIONARY, LEVEL = 20_000, 4000, 4096, 6
#: The compressor begins no match in the last bytes of its input and stores what doesn't shrink;
#: this run behind a window lets matches start anywhere in it and makes every window shrink.
_PAD = b"#" * 40
#: Windows whose difference one worker remembers; beyond that the memory starts anew.
REMEMBERED = 500_000


def window(word: str) -> bytes:
    return f" {word} ".encode() + _PAD


class Distance:
    """Bytes that the toxic dictionary saves on a window, against the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as zstd

        def compressor(data: bytes):
            made = zstd.ZstdCompressionDict(data)
            made.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.toxic, self.ordinary, self.known = compressor(toxic), compressor(ordinary), {}

    def of(self, text: str) -> np.ndarray:
        """Differences of all windows of the whole text."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        words = text.lower().split()
        try:
            return np.array([known[w] for w in words], np.int64)
        except KeyError:
            for w in words:
                if w not in known:
                    data = window(w)
                    known[w] = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
            return np.array([known[w] for w in words], np.int64)


def evidence(differences: np.ndarray, threshold: int) -> float:
    if not len(differences):
        return 0.0
    return float(np.maximum(differences - threshold + 1, 0).sum() / np.sqrt(len(differences)))


def _dictionary(words: list[tuple[str, int]]) -> bytes:
    """A dictionary trained on windows of four words, each as often as documents have the word."""
    import zstandard as zstd

    said = [w for w, n in words for _ in range(min(n, 400))]
    said = [said[i] for i in np.random.default_rng(0).permutation(len(said))]
    samples = [b"".join(f" {w} ".encode() for w in said[i : i + 4]) + _PAD for i in range(0, len(said), 4)]
    try:
        return zstd.train_dictionary(DICTIONARY, samples, k=32, d=6, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: their words themselves
        return ("".join(f" {w} " for w, _ in words)[: DICTIONARY]).encode() or b"        "


def _family(text: str) -> int:
    """Least hash of the text's 4-word runs: near copies mostly share it, other texts don't."""
    tools = worker_cache("toxicity")
    if "rolling" not in tools:
        tools.update(rolling=Rolling(), codes=byte_codes())
    data = np.frombuffer(text.encode(), np.uint8)
    words = tools["rolling"].runs(tools["codes"][data], *word_spans(data))
    runs = tools["rolling"].windows(words, min(4, max(1, len(words))))
    return int(runs.min().astype(np.int64)) if len(runs) else 0


def _words(sample: DataFrame) -> DataFrame:
    """word, family, toxic (1 or 0) of the distinct words of sampled documents, near copies as one."""

    def run(batches):
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words, family = sorted(set(text.lower().split())), _family(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array([family] * len(words), pa.int64()), pa.array([label] * len(words), pa.int32())],
                    ["word", "family", "toxic"],
                )

    return sample.mapInArrow(run, "word string, family long, toxic int").groupBy("word", "family").agg(F.max("toxic").alias("toxic"))


def _training_words(sample: DataFrame, toxic_docs: int, ordinary_docs: int) -> tuple[list, list]:
    """(word, documents) of toxic and of ordinary text, commonest first, at most VOCABULARY each.

    Toxic are words that, whole or by their first 5 or 7 letters, at least 2 % of toxic documents
    have, and 8 times the share of ordinary ones.
    """
    words = staged(_words(sample))
    grams = F.array_distinct(F.array("word", F.substring("word", 1, 5), F.substring("word", 1, 7)))
    spelled = words.withColumn("gram", F.explode(grams))
    share = F.col("toxic") / toxic_docs
    marked = (
        spelled.groupBy("gram", "family")
        .agg(F.max("toxic").alias("toxic"))
        .groupBy("gram")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary"))
        .where((share >= 0.02) & (F.col("toxic") >= 3) & (share >= 8 * (F.col("ordinary") + 1) / ordinary_docs))
        .select("gram")
    )

    def commonest(rows: DataFrame) -> list:
        counted = rows.groupBy("word").agg(F.count_distinct("family").alias("n"))
        return [(r["word"], r["n"]) for r in counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]

    return commonest(spelled.where("toxic = 1").join(marked, "gram")), commonest(words.where("toxic = 0"))


def _differences(docs: DataFrame, model: dict, columns: list[str], make) -> DataFrame:
    """Runs `make` on each text's differences; `columns` pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned = shared.value
        cache = worker_cache("toxicity")
        if cache.get("model") != learned["key"]:
            cache.update(model=learned["key"], distance=Distance(learned["toxic"], learned["ordinary"]))
        distance = cache["distance"]
        for batch in batches:
            values = [make(distance.of(t or ""), learned) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(values, made)], [*columns, "value"])

    made = pa.list_(pa.float64()) if make is _all_thresholds else pa.float64()
    kind = "array<double>" if make is _all_thresholds else "double"
    types = dict(docs.dtypes)
    return docs.select(*columns, "text").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns) + f", value {kind}")


THRESHOLDS = range(2, 9)


def _all_thresholds(differences: np.ndarray, _: dict) -> list[float]:
    return [evidence(differences, t) for t in THRESHOLDS]


def _score(differences: np.ndarray, model: dict) -> float:
    z = model["slope"] * np.log1p(evidence(differences, model["threshold"])) + model["shift"]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift with the least loss, both classes weighing alike; a small penalty keeps them finite."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 1e-4 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _ranked(x: np.ndarray, y: np.ndarray) -> float:
    """Chance that a toxic document has more evidence than an ordinary one; half for equals."""
    order = np.sort(x[y == 0])
    toxic = x[y == 1]
    below = np.searchsorted(order, toxic, "left") + np.searchsorted(order, toxic, "right")
    return below.sum() / (2 * max(1, len(order)) * max(1, len(toxic)))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", limit: int = SAMPLE) -> dict:
    """Dictionaries from three quarters of at most `limit` labelled rows, threshold and curve from the rest.

    The toxic dictionary is trained on words that toxic documents have far more often, the ordinary
    one on the commonest words of the others. {} if a part lacks a class.
    """
    sample = staged(training_rows(docs, labels, column, limit))
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0, 1).otherwise(0)
    learn, tune = sample.where(part == 0), sample.where(part == 1)
    sizes = {(r["part"], r["label"]): r["n"] for r in sample.groupBy(part.alias("part"), "label").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get((p, c), 0) for p in (0, 1) for c in (0, 1)) == 0:
        return {}
    toxic, ordinary = _training_words(learn, sizes[0, 1], sizes[0, 0])
    model = {"toxic": _dictionary(toxic), "ordinary": _dictionary(ordinary)}
    model["key"] = hash((model["toxic"], model["ordinary"]))
    rows = _differences(tune, model, ["doc_id", "label"], _all_thresholds).collect()
    y = np.array([r["label"] for r in rows])
    x = np.array([r["value"] for r in rows])
    best = max(range(len(THRESHOLDS)), key=lambda i: (_ranked(x[:, i], y), -i))
    model["threshold"] = THRESHOLDS[best]
    model["slope"], model["shift"] = _logistic(np.log1p(x[:, best]), y)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1: toxic) of every row, fitted on `labels`.

    A null text is empty and has no evidence. If the labels lack a class every score is 0.
    """
    model = fit(docs, labels, limit=limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model:
        scored = _differences(rows, model, ["doc_id"], _score).withColumnRenamed("value", "score")
    else:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
