"""Spark ML classifiers on leak-free features, evaluated over expanding folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from climrisk.operators import evaluation, forecasts, models, risk, windows
from climrisk.operators.calendar import densify_counts
from climrisk.plans import adapters as a
from climrisk.plans import hazard_queries as h
from climrisk.plans.registry import query, rounded
from climrisk.schemas import EVENTS
from climrisk.sources.tables import materialise

FEATURES = ["lag_1", "sum_3", "sum_7", "mean_7", "month"]
FOLDS, GAP_DAYS = 4, 7


def training_rows(spark, sf):
    """Features up to day t, label over the next week, fold of the evaluation."""
    leveled = h.labeled(spark, sf).select("series", "date", "level", "label")
    made = windows.lagged_features(a.rain(spark, sf)).withColumn(
        "month", F.month("date").cast("double")
    )
    rows = made.join(leveled, ["series", "date"]).where("label IS NOT NULL")
    return evaluation.expanding_folds(rows, FOLDS)


def _scores(spark, sf, build):
    folded = materialise(training_rows(spark, sf))
    scored = evaluation.evaluate_expanding(lambda: build(FEATURES), folded, FOLDS, gap_days=GAP_DAYS)
    cells = evaluation.confusion(scored, ["fold"])
    out = evaluation.macro_scores(cells, ["fold"])
    return rounded(out, 6, "macro_precision", "macro_recall", "macro_f1", "accuracy")


@query("model_lr")
def model_lr(spark, sf):
    return _scores(spark, sf, models.logistic_regression)


@query("model_rf")
def model_rf(spark, sf):
    return _scores(spark, sf, models.random_forest)


@query("model_gbt")
def model_gbt(spark, sf):
    return _scores(spark, sf, models.gradient_boosting)


@query("model_tune")
def model_tune(spark, sf):
    folded = materialise(training_rows(spark, sf))
    grid = [{"regParam": r, "elasticNetParam": e} for r in (0.001, 0.01, 0.1) for e in (0.0, 0.5)]
    out = models.tune(lambda **p: models.logistic_regression(FEATURES, **p), grid, folded, FOLDS, gap_days=GAP_DAYS)
    return rounded(out, 6, "macro_precision", "macro_recall", "macro_f1", "accuracy")


@query("importance")
def importance(spark, sf):
    rows = materialise(training_rows(spark, sf))
    model = models.random_forest(FEATURES).train(evaluation.before_fold(rows, FOLDS, gap_days=GAP_DAYS))
    return models.permutation_importance(model, rows.where(F.col("fold") == FOLDS))


@query("explain_linear")
def explain_linear(spark, sf):
    rows = materialise(training_rows(spark, sf))
    model = models.logistic_regression(FEATURES).train(evaluation.before_fold(rows, FOLDS, gap_days=GAP_DAYS))
    told = model.explain(model.predict(rows.where(F.col("fold") == FOLDS)))
    return told.select(
        "series",
        "date",
        "prediction",
        "probability",
        "base",
        F.posexplode_outer("explanation").alias("place", "_e"),
    ).select("series", "date", "prediction", "probability", "base", "place", "_e.*")


@query(
    "forecast_rows",
    f"""WITH {h.LABELED}, {h.MODES}, made AS (
      SELECT series, date, lag(value, 1) OVER s AS lag_1, count(value) OVER w3 AS n3,
        count(value) OVER w7 AS n7 FROM labeled WINDOW s AS (PARTITION BY series ORDER BY date),
        w3 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        w7 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    , judged_features AS (SELECT fold, date, lag_1 IS NOT NULL AND n3 = 3 AND n7 = 7 AS whole
      FROM judged_rows JOIN made USING (series, date)),
    cuts AS (SELECT fold, min(date) AS cut FROM judged_features WHERE fold > 0 GROUP BY 1),
    trained AS (SELECT DISTINCT c.fold FROM cuts c JOIN judged_features p ON p.fold < c.fold
      WHERE p.whole AND CAST(p.date + INTERVAL 7 DAY AS DATE) < c.cut)
    SELECT f.fold, count(*) AS rows, count(*) FILTER (WHERE whole AND t.fold IS NOT NULL) AS forecasts,
      min(date) AS first_day, max(date) AS last_day, CAST(0 AS BIGINT) AS outside
    FROM judged_features f LEFT JOIN trained t ON t.fold = f.fold WHERE f.fold > 0 GROUP BY f.fold""",
)
def forecast_rows(spark, sf):
    """Every row of a test fold is forecast once; only one with a NULL feature has no level."""
    folded = materialise(training_rows(spark, sf))
    build = lambda: models.logistic_regression(FEATURES)
    scored = evaluation.evaluate_expanding(build, folded, FOLDS, gap_days=GAP_DAYS)
    return scored.groupBy("fold").agg(
        F.count("*").alias("rows"),
        F.count("prediction").alias("forecasts"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count_if(~F.col("probability").between(0, 1)).alias("outside"),
    )


# --- forecasts as risk rows -----------------------------------------------------------------


def hazard_rows(spark, sf):
    """Features up to day t and the week's label of every hazard: rain for two of them, detections for fire."""
    rain = windows.lagged_features(a.rain(spark, sf)).withColumn("series", F.col("series").cast("string"))
    counts = densify_counts(a.fire_counts(spark, sf), "detections")
    fire = windows.lagged_features(counts.withColumn("value", F.col("detections").cast("double")))
    columns = ["series", "date", *(f for f in FEATURES if f != "month")]
    by_rain = rain.select(*columns, F.explode(F.array(F.lit("lluvia_intensa"), F.lit("sequia"))).alias("event"))
    by_fire = fire.withColumn("series", F.col("series").cast("string")).select(*columns, F.lit("incendio").alias("event"))
    made = by_rain.unionByName(by_fire).withColumn("month", F.month("date").cast("double"))
    return made.join(h.labeled_hazards(spark, sf), ["event", "series", "date"])


def hazard_forecasts(spark, sf):
    """Risk rows of the last fold's days and the registry row of every hazard's model."""
    whole = materialise(hazard_rows(spark, sf))
    risks = metrics = None
    for event in EVENTS:
        rows = materialise(evaluation.expanding_folds(whole.where((F.col("event") == event) & F.col("label").isNotNull()), FOLDS))
        training = evaluation.before_fold(rows, FOLDS, gap_days=GAP_DAYS)
        test = rows.where(F.col("fold") == FOLDS)
        model = models.logistic_regression(FEATURES).train(training)
        version = forecasts.model_version(model.algorithm, event, training)
        made = forecasts.risk_rows(model, test, event, version)
        risks = made if risks is None else risks.unionByName(made)
        if model.model is not None:
            judged = forecasts.judge(model, test, training, event, version)
            metrics = judged if metrics is None else metrics.unionByName(judged)
    return risks, metrics


@query("risk_forecasts")
def risk_forecasts(spark, sf):
    """One row per contribution of each forecast; a row without a forecast has one row of NULLs."""
    risks, _ = hazard_forecasts(spark, sf)
    return rounded(
        risks.select("*", F.posexplode_outer("explanation").alias("place", "_e"))
        .select("district", "date", "event", "level", "probability", "algorithm", "model_version", "place", "_e.*"),
        6, "probability", "contribution",
    )


@query("forecast_legend")
def forecast_legend(spark, sf):
    """Districts per level on the last day of each hazard's forecasts, those without one counted too."""
    risks = materialise(hazard_forecasts(spark, sf)[0])
    codes = materialise(risks.select(F.col("district").alias("code")).distinct())
    table = None
    for r in risks.groupBy("event").agg(F.max("date").alias("day")).collect():
        one = risk.legend_counts(risk.complete_risks(codes, risks, r["day"], r["event"]), ["event", "date"])
        table = one if table is None else table.unionByName(one)
    return table


@query("forecast_registry")
def forecast_registry(spark, sf):
    _, metrics = hazard_forecasts(spark, sf)
    return rounded(metrics.drop("trained_at"), 6, "macro_f1", "macro_precision", "macro_recall")
