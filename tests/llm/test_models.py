"""Classifiers: held-out accuracy, rules of learning, and odd inputs."""

import zlib

import numpy as np
import pytest

from climrisk.llm import labels, quality, toxicity

SF = "/root/testdata/sf0.1"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def judged(out, marks, column):
    rows = out.join(marks, "doc_id").where("held_out").collect()
    return np.array([r["score"] for r in rows]), np.array([r["predicted"] for r in rows]), np.array([r[column] for r in rows])


def ranked(score, truth):
    good, bad = score[truth == 1], score[truth == 0]
    return ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()


def test_quality_held_out(spark):
    score, said, truth = judged(quality.classify(read(spark, "documents"), read(spark, "labels")), read(spark, "labels"), "quality")
    assert ranked(score, truth) > 0.99 and (said == truth).mean() > 0.98


def test_toxicity_held_out(spark):
    score, said, truth = judged(toxicity.classify(read(spark, "documents"), read(spark, "labels")), read(spark, "labels"), "toxic")
    assert ranked(score, truth) > 0.9 and (said == truth).mean() > 0.92


def test_held_out_rows_teach_nothing(spark, docs):
    rows = [(i, f"text number {i}") for i in range(60)]
    marks = spark.createDataFrame([(i, 1) for i in range(60)] + [(7, 0), (None, 1), (1000, 1)], "doc_id long, quality int")
    used = {r["doc_id"] for r in labels.training_rows(docs(rows), marks, "quality", 1000).collect()}
    assert used == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert labels.training_rows(docs(rows), marks, "quality", 10).count() == 10


def test_equal_texts_teach_once(spark, docs):
    rows = [(i, "the same text") for i in range(1, 30)]
    marks = spark.createDataFrame([(i, 0) for i in range(1, 30)], "doc_id long, quality int")
    assert labels.training_rows(docs(rows), marks, "quality", 100).count() == 1


def test_votes_by_hand():
    rng = np.random.default_rng(0)
    rows = (rng.random((40, quality.WIDTH)) * (rng.random((40, quality.WIDTH)) < 0.01)).astype(np.float32)
    model = {"idf": np.ones(quality.TERMS, np.float32), "project": rng.standard_normal((quality.WIDTH, 5)).astype(np.float32)}
    place = quality._unit(quality.weighted(rows, model["idf"]) @ model["project"])
    model |= {"vectors": place[:30], "ids": np.arange(30), "label": (np.arange(30) % 3 == 0).astype(np.float32)}
    got = quality.votes(rows[30:], np.arange(30, 40), model, k=4)
    for row, score in zip(place[30:], got, strict=True):
        near = sorted(((float(row @ v), y) for v, y in zip(model["vectors"], model["label"], strict=True)), reverse=True)[:4]
        weight = [max(c, 0) ** 8 for c, _ in near]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight), abs=1e-4)


@pytest.mark.parametrize("classify,column", [(quality.classify, "quality"), (toxicity.classify, "toxic")])
def test_odd_inputs(spark, docs, hard_texts, empty, classify, column):
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 60)], f"doc_id long, {column} int")
    none = marks.where("false")
    for taught in (marks, none, marks.where(f"{column} = 1")):
        rows = classify(docs(hard_texts), taught).collect()
        assert len(rows) == len(hard_texts)
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
        assert {(r["doc_id"], r["held_out"]) for r in rows if r["doc_id"]} == {(i, zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in hard_texts if i}
    assert classify(empty, marks).count() == 0


def test_keep_good_keeps_columns(spark, docs, hard_texts):
    marks = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    kept = quality.keep_good(docs(hard_texts), marks)
    assert kept.columns == docs(hard_texts).columns and kept.count() == len(hard_texts)


def test_toxic_dictionary_saves_on_its_words():
    toxic = toxicity._dictionary([(w, 50) for w in ("vermin", "dimwit", "nuisance", "blockhead")])
    plain = toxicity._dictionary([(w, 50) for w in ("weather", "valley", "the", "harvest", "morning")])
    distance = toxicity.Distance(toxic, plain)
    assert distance.of("vermin blockhead nuisance").min() >= 2
    assert distance.of("valley weather harvest").max() <= 0
    assert toxicity.evidence(np.zeros(0, int), 3) == 0.0
