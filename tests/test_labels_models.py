"""Levels, labels, baselines, folds, scores and classifiers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from climrisk.functions import levels
from climrisk.operators import evaluation, labels, models
from climrisk.operators.baselines import ClimatologicalBaseline, NotTrained, Persistence
from tests.conftest import EPOCH

D = datetime.date
L, M, H = "bajo", "medio", "alto"


def leveled(spark, values, series="a", start=EPOCH):
    rows = [(series, start + datetime.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, date date, level string")


def one(spark, column, *args):
    return spark.range(1).select(column(*args).alias("v")).first().v


def test_level_limits(spark):
    f = lambda v: F.lit(v).cast("double")
    rain = lambda t, a=10, b=20: one(spark, levels.rain_level, f(t), f(a), f(b))
    assert [rain(10), rain(10.1), rain(20), rain(20.1)] == [L, M, M, H]
    assert rain(None) is None and rain(5, None) is None
    dry = lambda v: one(spark, levels.drought_level, f(v))
    assert [dry(-0.99), dry(-1.0), dry(-1.49), dry(-1.5), dry(None)] == [L, M, M, H, None]
    fire = lambda n: one(spark, levels.fire_level, f(n), f(4))
    assert [fire(0), fire(1), fire(4), fire(5), fire(None)] == [L, M, M, H, None]
    p = lambda v: one(spark, levels.level_from_probability, f(v))
    assert [p(0), p(0.33), p(1 / 3), p(0.66), p(2 / 3), p(1), p(None)] == [L, L, M, M, H, H, None]


@pytest.mark.parametrize("block", [4, 2048])
def test_forward_label_golden(spark, column, block):
    v = [L] * 12 + [H] + [L] * 20
    got = column(labels.forward_label(leveled(spark, v), block_days=block), "label")["a"]
    t = 9
    assert got[t] == H and got[t + 1] == H and got[t - 9] == L
    assert got[12] == L, "the row's own day never counts"
    assert got[-7:] == [None] * 7


def test_label_with_a_gap_is_null(spark, column):
    v = [L] * 10 + [None] + [L] * 10
    got = column(labels.forward_label(leveled(spark, v)), "label")["a"]
    assert got[2] == L and got[3:10] == [None] * 7 and got[10] == L


def test_trailing_counts_are_additive(spark, daily, column):
    r = random.Random(2)
    n = [r.randint(0, 3) for _ in range(30)]
    df = daily(a=n).withColumn("detections", F.col("value").cast("long"))
    got = column(labels.trailing_counts(df, block_days=5), "n")["a"]
    assert got == [sum(n[max(0, i - 6) : i + 1]) for i in range(30)]
    two_weeks = column(labels.trailing_counts(df, 14), "n")["a"]
    assert two_weeks[20] == got[20] + got[13]


def rows_for(spark, spec):
    rows = [(s, D(2000 + y, m, 1 + i), "sequia", label) for i, (s, y, m, label) in enumerate(spec)]
    return spark.createDataFrame(rows, "series string, date date, event string, label string")


def test_climatology_ties_go_to_the_more_severe(spark):
    train = rows_for(
        spark,
        [("a", 0, 1, L), ("a", 1, 1, H), ("a", 0, 2, L), ("a", 1, 2, L), ("a", 2, 2, M), ("b", 0, 5, None)],
    )
    base = ClimatologicalBaseline()
    with pytest.raises(NotTrained):
        base.predict(train)
    base.train(train)
    ask = rows_for(spark, [("a", 9, 1, None), ("a", 9, 2, None), ("a", 9, 7, None), ("zz", 9, 1, None)])
    got = {(r.series, r.date.month): r for r in base.predict(ask).collect()}
    assert got["a", 1].prediction == H and got["a", 1].probability == 0.5
    assert got["a", 2].prediction == L and got["a", 2].probability == 0.0
    assert got["a", 7].prediction == L and got["zz", 1].prediction == L
    assert got["a", 7].probability == pytest.approx(0.2)
    assert base.explain(ask) is None


def test_persistence(spark):
    out = Persistence().train(None).predict(leveled(spark, [L, None, H]))
    assert [r.prediction for r in out.orderBy("date").collect()] == [L, None, H]


def fold_rows(spark, per_date, start=EPOCH):
    rows = []
    for i, c in enumerate(per_date):
        rows += [(f"s{j}", start + datetime.timedelta(days=i)) for j in range(c)]
    return spark.createDataFrame(rows, "series string, date date")


def test_folds_on_unique_dates_equal_the_plain_cuts(spark):
    n, k = 103, 4
    df = fold_rows(spark, [1] * n, D(1999, 12, 1))
    step = n // (k + 1)
    for snap in (True, False):
        got = evaluation.expanding_folds(df, k, snap_to_date=snap).orderBy("date").collect()
        want = [min(i // step, k) for i in range(n)]
        assert [r.fold for r in got] == want


@pytest.mark.parametrize("k", [1, 3])
def test_exact_cuts_split_a_hot_date(spark, k):
    df = fold_rows(spark, [2, 50, 3, 1, 40, 4])
    out = evaluation.expanding_folds(df, k, snap_to_date=False)
    step = 100 // (k + 1)
    sizes = {r.fold: r.n for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {f: step if f < k else 100 - k * step for f in range(k + 1)}
    ends = out.groupBy("fold").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).orderBy("fold").collect()
    assert all(a.hi <= b.lo for a, b in zip(ends, ends[1:]))


def test_snapped_folds_never_split_a_date(spark):
    df = fold_rows(spark, [2, 50, 3, 1, 40, 4])
    out = evaluation.expanding_folds(df, 3)
    assert out.groupBy("date").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    summary = evaluation.fold_summary(out, 3).orderBy("number").collect()
    assert [r.number for r in summary] == [1, 2, 3]
    assert all(r.train_end is None or r.test_start is None or r.train_end < r.test_start for r in summary)


def test_fold_errors(spark):
    df = fold_rows(spark, [1, 1])
    with pytest.raises(ValueError):
        evaluation.expanding_folds(df, 0)
    with pytest.raises(Exception, match="need at least 4 rows"):
        evaluation.expanding_folds(df, 3).collect()


def scored(spark, pairs):
    rows = [(a, p, b) for a, p, b in pairs]
    return spark.createDataFrame(rows, "label string, prediction string, baseline string")


def test_confusion_and_macro_scores(spark):
    pairs = [(L, L, L)] * 5 + [(L, M, L)] + [(M, M, L)] * 2 + [(H, L, H)] + [(None, L, L), (L, None, L)]
    cells = evaluation.confusion(scored(spark, pairs))
    got = {(r.actual, r.predicted): r.n for r in cells.collect()}
    assert len(got) == 9 and sum(got.values()) == 9
    assert got[L, L] == 5 and got[L, M] == 1 and got[M, M] == 2 and got[H, L] == 1 and got[H, H] == 0
    s = evaluation.macro_scores(cells).first()
    assert s.macro_precision == pytest.approx((5 / 6 + 2 / 3 + 0) / 3)
    assert s.macro_recall == pytest.approx((5 / 6 + 1 + 0) / 3)
    assert s.macro_f1 == pytest.approx((10 / 12 + 4 / 5 + 0) / 3)
    assert s.accuracy == pytest.approx(7 / 9)
    assert evaluation.confusion_matrix(cells).first().confusion == [[5, 1, 0], [0, 2, 0], [1, 0, 0]]
    empty = evaluation.macro_scores(evaluation.confusion(scored(spark, [(None, L, L)]))).first()
    assert empty.macro_f1 is None and empty.evaluated == 0


def test_paired_test(spark):
    pairs = [(L, L, M)] * 12 + [(L, M, L)] * 3 + [(L, L, L)] * 5 + [(L, M, M)]
    row = evaluation.mcnemar_counts(scored(spark, pairs)).first()
    assert (row.both, row.only_model, row.only_baseline, row.neither) == (5, 12, 3, 1)
    assert row.statistic == pytest.approx(64 / 15)
    better, p = evaluation.beats_baseline(0.55, 0.2, 12, 3)
    assert better and p == pytest.approx(0.0388, abs=1e-3)
    worse, p = evaluation.beats_baseline(0.2, 0.55, 3, 12)
    assert not worse and 0 < p <= 1
    assert evaluation.beats_baseline(0.3, 0.3, 0, 0) == (False, 1.0)
    with pytest.raises(ValueError):
        evaluation.beats_baseline(None, 0.5, 1, 1)


def test_label_distribution_counts_missing_labels(spark):
    df = rows_for(spark, [("a", 0, 1, L), ("a", 0, 1, None), ("a", 1, 1, H), ("b", 0, 1, M)])
    got = {(r.series, r.year): r for r in labels.label_distribution(df).collect()}
    assert got["a", 2000].bajo == 1 and got["a", 2000].without_label == 1
    assert got["a", 2001].alto == 1 and got["b", 2000].medio == 1
    total = labels.label_distribution(df, subtotals=True).where("event IS NULL").first()
    assert total.days == 4


@pytest.fixture(scope="module")
def separable(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        x, noise = r.uniform(0, 3), r.uniform(0, 1)
        rows.append((EPOCH + datetime.timedelta(days=i), x, noise, (L, M, H)[int(x)]))
    return spark.createDataFrame(rows, "date date, x double, noise double, label string").cache()


@pytest.mark.parametrize("name", ["regresion_logistica", "random_forest", "xgboost"])
def test_classifiers_learn_and_refuse(separable, name):
    params = {"xgboost": {"maxIter": 3, "maxDepth": 3}, "regresion_logistica": {"regParam": 0.0}}
    model = models.BUILDERS[name](["x", "noise"], **params.get(name, {}))
    with pytest.raises(NotTrained):
        model.predict(separable)
    model.train(separable)
    out = model.predict(separable).cache()
    assert out.where("prediction = label").count() > 330
    bounds = out.agg(F.min("probability").alias("lo"), F.max("probability").alias("hi")).first()
    assert 0 <= bounds.lo and bounds.hi <= 1
    high = out.groupBy("label").agg(F.avg("probability").alias("p")).collect()
    p = {r.label: r.p for r in high}
    assert p[H] > p[M] > p[L] or p[H] > max(p[L], p[M])
    assert not any(c.startswith("_") for c in out.columns)
    if name == "regresion_logistica":
        told = model.explain(out).first().explanation
        assert told[0].variable == "x"
        assert abs(told[0].contribution) >= abs(told[1].contribution)
        assert model.importance() is None
    else:
        assert model.importance()[0][0] == "x"


def test_expanding_evaluation_and_tuning(separable):
    folded = evaluation.expanding_folds(separable, 2, series=None).cache()
    make = lambda **p: models.logistic_regression(["x"], **p)
    out = evaluation.evaluate_expanding(make, folded, 2)
    assert {r.fold for r in out.select("fold").distinct().collect()} == {1, 2}
    row = models.metrics_row(out, "regresion_logistica", "sequia", "v1").first()
    assert row.macro_f1 > 0.5 and len(row.confusion) == 3 and row.beats_baseline is None
    best = models.tune(make, [{"regParam": 10.0}, {"regParam": 0.0}], folded, 2).first()
    assert best.setting == 1
    model = models.random_forest(["x", "noise"]).train(folded)
    ranked = models.permutation_importance(model, folded).collect()
    assert ranked[0].variable == "x" and ranked[0].loss > 0.2


def test_thresholds_are_given_not_refitted(spark, daily):
    """Cutting the data shorter leaves every level that remains unchanged."""
    r = random.Random(3)
    df = daily(a=[float(r.randint(0, 30)) for _ in range(200)])
    fixed = spark.createDataFrame([("a", 40.0, 70.0)], "series string, p95_accumulated double, p99_accumulated double")
    whole = labels.rain_levels(df, fixed)
    half = labels.rain_levels(df.where(F.col("date") < F.lit(D(1995, 4, 1))), fixed)
    both = half.select("date", F.col("level").alias("h")).join(whole, "date")
    assert both.where(~F.col("h").eqNullSafe(F.col("level"))).count() == 0


def test_rows_with_absent_features_come_back_without_forecast(spark, separable):
    model = models.logistic_regression(["x", "noise"]).train(separable)
    holes = separable.limit(20).withColumn("x", F.when(F.dayofmonth("date") % 2 == 0, F.col("x")))
    out = model.predict(holes).collect()
    assert len(out) == 20
    assert all((r.prediction is None) == (r.x is None) == (r.probability is None) for r in out)
    assert all((r.explanation is None) == (r.x is None) for r in model.explain(holes).collect())


def test_contributions_and_base_make_the_margin(separable):
    import numpy as np

    model = models.logistic_regression(["x", "noise"]).train(separable)
    weights, shift = model.model.coefficientMatrix.toArray()[2], model.model.interceptVector[2]
    for r in model.explain(separable.limit(30)).collect():
        margin = shift + float(np.dot(weights, [r.x, r.noise]))
        assert r.base + sum(e.contribution for e in r.explanation) == pytest.approx(margin, abs=1e-9)


def test_a_level_never_seen_has_no_say(separable):
    model = models.logistic_regression(["x", "noise"]).train(separable.where(F.col("label") != H))
    row = model.explain(model.predict(separable)).first()
    assert row.probability == 0.0 and all(e.contribution == 0 for e in row.explanation)


def test_a_permutation_uses_every_value_once(separable):
    for bucket_rows in (10_000, 50):
        moved = models.permuted(separable, "x", ["date"], bucket_rows=bucket_rows)
        before = [r.x for r in separable.orderBy("date").collect()]
        after = [r.x for r in moved.orderBy("date").collect()]
        assert sorted(before) == sorted(after) and before != after
        again = models.permuted(separable.repartition(7), "x", ["date"], bucket_rows=bucket_rows)
        assert after == [r.x for r in again.orderBy("date").collect()]


def test_labels_reach_never_crosses_a_cut(spark):
    class Spy:
        seen = []

        def train(self, rows):
            self.last = rows.agg(F.max("date")).first()[0]
            return self

        def predict(self, rows):
            Spy.seen.append((self.last, rows.agg(F.min("date")).first()[0]))
            return rows

    days = [(EPOCH + datetime.timedelta(days=i), "a") for i in range(60)]
    folded = evaluation.expanding_folds(spark.createDataFrame(days, "date date, series string"), 3)
    evaluation.evaluate_expanding(Spy, folded, 3, gap_days=7)
    assert [(first - last).days for last, first in Spy.seen] == [8, 8, 8]


def test_a_better_score_must_also_be_significant(spark):
    rows = [("base", "e", 0.5, 0, 0, None), ("sure", "e", 0.6, 40, 5, 25.7), ("maybe", "e", 0.6, 4, 3, 0.0), ("worse", "e", 0.2, 5, 40, 25.7)]
    table = spark.createDataFrame(rows, "algorithm string, event string, macro_f1 double, only_model long, only_baseline long, statistic double")
    got = {r.algorithm: r for r in evaluation.model_table(table, "base").collect()}
    assert [got[a].beats_baseline for a in ("sure", "maybe", "worse", "base")] == [True, False, False, False]
    assert got["sure"].p_value < 1e-5 and got["maybe"].p_value == pytest.approx(1.0)


def test_folds_without_trainable_rows_have_null_forecasts(spark):
    """Labels only after the first cut: the first fold's rows come back without a forecast."""
    days = [EPOCH + datetime.timedelta(days=k) for k in range(40)]
    rows = [("a", d, 0 if k < 10 else 1 if k < 25 else 2, float(k % 3), None if k < 10 else ("bajo", "alto")[k % 2]) for k, d in enumerate(days)]
    folded = spark.createDataFrame(rows, "series string, date date, fold int, x double, label string")
    for build in (models.logistic_regression, models.gradient_boosting):
        out = evaluation.evaluate_expanding(lambda b=build: b(["x"]), folded, 2, gap_days=2)
        got = {r["fold"]: (r["n"], r["said"]) for r in out.groupBy("fold").agg(F.count("*").alias("n"), F.count("prediction").alias("said")).collect()}
        assert got == {1: (15, 0), 2: (15, 15)}
    with pytest.raises(NotTrained):
        model = models.logistic_regression(["x"]).train(folded.where("label IS NULL"))
        model.predict(folded)
