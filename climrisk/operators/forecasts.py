"""From a trained model to published risk rows: one version id ties rows, metrics and training together."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climrisk.operators import evaluation, models
from climrisk.operators.baselines import ClimatologicalBaseline, NotTrained
from climrisk.schemas import EVENTS, EXPLANATION, KEYS, LEVELS, MODEL_METRICS, RISK
from climrisk.sources import versions
from climrisk.sources.tables import materialise, read_whole, table_digest, upsert_whole

#: A model beats the baseline by a higher macro F1 and a p-value of the paired test under this.
SIGNIFICANCE = 0.05


def model_version(algorithm: str, event: str, training: DataFrame, settings: str = "") -> str:
    """Name of a model: the same rows, settings and algorithm give the same one on any cluster."""
    facts = table_digest(training).first()
    text = "\n".join((algorithm, event, settings, str(facts["rows"]), facts["digest"]))
    return f"{algorithm}-{event}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def risk_rows(
    model, rows: DataFrame, event: str, version: str, *, series: str = "series", date: str = "date"
) -> DataFrame:
    """One risk row per district and day: level, P(high), contributions, algorithm and version.

    A row that can't be forecast (a feature is NULL, or the model found nothing to train on) names
    no level, no algorithm and no version: nothing is estimated without a model behind it.
    """
    none = F.lit(None)
    try:
        told = model.explain(rows)
        out = model.predict(rows if told is None else told)
        why = none.cast(EXPLANATION) if told is None else F.col("explanation").cast(EXPLANATION)
    except NotTrained:
        out = rows.withColumns({"prediction": none.cast("string"), "probability": none.cast("double")})
        why = none.cast(EXPLANATION)
    made = F.col("prediction").isNotNull()
    values = {
        "district": F.col(series).cast("string"),
        "date": F.col(date),
        "event": F.lit(event),
        "level": F.col("prediction"),
        "probability": F.when(made, F.col("probability")),
        "algorithm": F.when(made, F.lit(model.algorithm)),
        "model_version": F.when(made, F.lit(version)),
        "explanation": F.when(made, why),
    }
    return out.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in RISK))


def judge(model, test: DataFrame, training: DataFrame, event: str, version: str) -> DataFrame:
    """The registry row of a model: its scores on rows after its training, and whether it beats climatology.

    Model and baseline learn from the same rows and are compared on the same ones, those that both
    forecast. Where there are none, nothing is known to beat the baseline.
    """
    baseline = ClimatologicalBaseline().train(training.withColumn("event", F.lit(event)))
    both = baseline.predict(test.withColumn("event", F.lit(event))).withColumnRenamed("prediction", "baseline")
    scored = materialise(model.predict(both.drop("probability")))
    known = scored.where("label IS NOT NULL AND prediction IS NOT NULL AND baseline IS NOT NULL")
    one = known.withColumn("_k", F.lit(1))
    f1 = {}
    for name in ("prediction", "baseline"):
        score = evaluation.macro_scores(evaluation.confusion(one, ["_k"], predicted=name), ["_k"]).first()
        f1[name] = score["macro_f1"] if score else None
    pairs = evaluation.mcnemar_counts(known).first()
    wins = None
    if None not in f1.values():
        better, p = evaluation.beats_baseline(f1["prediction"], f1["baseline"], pairs["only_model"], pairs["only_baseline"])
        wins = better and p < SIGNIFICANCE
    row = models.metrics_row(scored, model.algorithm, event, version, beats_baseline=wins)
    return row.select(*(F.col(f.name).cast(f.dataType) for f in MODEL_METRICS))


def check_risks(risks: DataFrame) -> None:
    """One aggregate; raises when a row leaves the vocabularies or has a probability outside 0 to 1."""
    c = F.col
    kept = (
        c("event").isin(*EVENTS)
        & (c("level").isNull() | c("level").isin(*LEVELS))
        & (c("probability").isNull() | c("probability").between(0, 1))
        & (c("level").isNotNull() == c("model_version").isNotNull())
    )
    wrong = risks.agg(F.count_if(~F.coalesce(kept, F.lit(False))).alias("n")).first()["n"]
    if wrong:
        raise ValueError(f"{wrong} risk rows with an unknown event or level, an odd probability, or a level without a version")


def publish(spark: SparkSession, root: str, risks: DataFrame, metrics: DataFrame) -> int:
    """Stores the metrics, then the risk rows that name them; returns the risk rows delivered.

    Risk rows become visible together; a version that neither the delivery nor the registry knows is
    an error, and so are rows that `check_risks` refuses. Publishing twice changes nothing.
    """
    risks = materialise(risks)
    check_risks(risks)
    upsert_whole(spark, f"{root}/model_metrics", metrics, KEYS["model_metrics"], "trained_at")
    known = registry(spark, root).select(F.col("version").alias("model_version"), "event", "algorithm")
    named = risks.where("model_version IS NOT NULL").select("model_version", "event", "algorithm").distinct()
    unknown = named.join(known, ["model_version", "event", "algorithm"], "left_anti").take(3)
    if unknown:
        raise ValueError(f"risk rows name models without metrics: {[r['model_version'] for r in unknown]}")
    return versions.upsert_by_year(spark, f"{root}/risk", risks, KEYS["risk"], order="date")


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The metrics of all published models."""
    return read_whole(spark, f"{root}/model_metrics")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The risk rows in force, as `risk.complete_risks`, packets and legends read them."""
    return versions.read_years(spark, f"{root}/risk").select(*(f.name for f in RISK))
