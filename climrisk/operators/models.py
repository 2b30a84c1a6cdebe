"""Spark ML classifiers behind one protocol: train, predict, explain.

`probability` is P(level = high), whatever level is returned. A forecast without a trained model
is an error, never a default.
"""

from __future__ import annotations

import operator
from datetime import datetime, timezone
from functools import reduce

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climrisk.functions import levels
from climrisk.operators import evaluation
from climrisk.operators.baselines import NotTrained
from climrisk.schemas import LEVELS
from climrisk.sources.tables import materialise

SEED = 7


class LevelClassifier:
    """Wraps a Spark ML classifier over numeric feature columns and the three levels."""

    def __init__(self, algorithm: str, classifier, features: list[str], label: str = "label"):
        self.algorithm, self.classifier = algorithm, classifier
        self.features, self.label = list(features), label
        self._assembler = VectorAssembler(
            inputCols=[f"_in_{f}" for f in self.features], outputCol="_features"
        )
        self.model = None
        self.means: dict[str, float] | None = None

    def _assembled(self, rows: DataFrame) -> DataFrame:
        """Adds the feature vector, and `_whole`: no feature is NULL or NaN (else 0 stands there)."""
        known = {f: F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in self.features}
        filled = {
            f"_in_{f}": F.when(known[f], F.col(f).cast("double")).otherwise(0.0) for f in self.features
        }
        whole = reduce(operator.and_, known.values())
        return self._assembler.transform(rows.withColumns(filled | {"_whole": whole}))

    def train(self, rows: DataFrame) -> LevelClassifier:
        """Fits labelled rows with all features; where there are none, the model stays untrained."""
        known = rows.where(F.col(self.label).isNotNull()).withColumn(
            "_target", levels.severity(F.col(self.label)).cast("double")
        )
        ready = self._assembled(known).where("_whole")
        facts = ready.agg(F.count("*").alias("_rows"), *(F.avg(f).alias(f) for f in self.features)).first().asDict()
        if facts.pop("_rows"):
            self.means, self.model = facts, self.classifier.fit(ready)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """Every row comes back; one with a NULL feature has a NULL forecast."""
        if self.model is None:
            raise NotTrained(f"train {self.algorithm} before predicting")
        out = self.model.transform(self._assembled(rows)).withColumn(
            "_scores", vector_to_array("_probability")
        )
        return _finished(out, levels.level_name(F.col("_predicted").cast("int")))

    def explain(self, rows: DataFrame) -> DataFrame | None:
        """Exact linear contributions to the high level, largest first; None when not linear.

        With `base` they add up to the margin of the high level. Rows with a NULL feature have none.
        """
        if self.model is None:
            raise NotTrained(f"train {self.algorithm} before explaining")
        if not hasattr(self.model, "coefficientMatrix"):
            return None
        # Row 2 belongs to the high level; a level never seen in training has no row and no say.
        weights = self.model.coefficientMatrix.toArray()
        high = weights[2] if weights.shape[0] > 2 else [0.0] * len(self.features)
        parts = F.array(
            *(
                F.struct(
                    F.lit(f).alias("variable"),
                    (F.lit(float(w)) * (F.col(f) - F.lit(self.means[f]))).alias("contribution"),
                )
                for f, w in zip(self.features, high)
            )
        )
        size = lambda c: F.abs(c["contribution"])
        ranked = F.array_sort(
            parts,
            lambda a, b: F.when(size(a) > size(b), -1).when(size(a) < size(b), 1).otherwise(0),
        )
        whole = reduce(operator.and_, (F.col(f).isNotNull() for f in self.features))
        shift = float(self.model.interceptVector[2]) if weights.shape[0] > 2 else 0.0
        base = shift + sum(float(w) * (self.means[f] or 0.0) for f, w in zip(self.features, high))
        return rows.withColumn("explanation", F.when(whole, ranked)).withColumn("base", F.when(whole, F.lit(base)))

    def importance(self) -> list[tuple[str, float]] | None:
        """Global importance of tree models, largest first."""
        if self.model is None or not hasattr(self.model, "featureImportances"):
            return None
        scores = self.model.featureImportances.toArray()
        return sorted(zip(self.features, map(float, scores)), key=lambda p: (-p[1], p[0]))


def _finished(out: DataFrame, level) -> DataFrame:
    """Forecast level and P(high); working columns removed. A level never seen scores zero."""
    high = F.when(F.size("_scores") > 2, F.element_at("_scores", 3)).otherwise(0.0)
    return (
        out.withColumn("prediction", F.when(F.col("_whole"), level))
        .withColumn("probability", F.when(F.col("_whole"), high))
        .drop(*(c for c in out.columns if c.startswith("_")))
    )


class BoostedLevels(LevelClassifier):
    """Boosted trees are binary in Spark: one against the rest for each level seen in training.

    Scores of the three are scaled to sum to one; the highest one names the level.
    """

    def train(self, rows: DataFrame) -> BoostedLevels:
        known = rows.where(F.col(self.label).isNotNull()).withColumn(
            "_target", levels.severity(F.col(self.label))
        )
        ready = materialise(self._assembled(known).where("_whole").select("_features", "_target"))
        seen = {r["_target"] for r in ready.select("_target").distinct().collect()}
        self.model = {
            i: self.classifier.copy(
                {
                    self.classifier.labelCol: f"_is{i}",
                    self.classifier.probabilityCol: f"_p{i}",
                    self.classifier.rawPredictionCol: f"_raw{i}",
                    self.classifier.predictionCol: f"_said{i}",
                }
            ).fit(ready.withColumn(f"_is{i}", (F.col("_target") == i).cast("double")))
            for i in sorted(seen)
        } or None
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise NotTrained(f"train {self.algorithm} before predicting")
        out = self._assembled(rows)
        for one in self.model.values():
            out = one.transform(out)
        each = [
            F.element_at(vector_to_array(f"_p{i}"), 2) if i in self.model else F.lit(0.0)
            for i in range(len(LEVELS))
        ]
        whole = sum(each, F.lit(0.0))
        best = F.array_max(F.col("_scores"))
        out = out.withColumn("_scores", F.array(*(s / whole for s in each)))
        return _finished(
            out, levels.level_name((F.array_position("_scores", best) - 1).cast("int"))
        )

    def importance(self) -> list[tuple[str, float]] | None:
        if self.model is None:
            return None
        total = sum(m.featureImportances.toArray() for m in self.model.values())
        scores = total / len(self.model)
        return sorted(zip(self.features, map(float, scores)), key=lambda p: (-p[1], p[0]))


_COLUMNS = {"featuresCol": "_features", "labelCol": "_target", "predictionCol": "_predicted"}


def logistic_regression(features: list[str], label: str = "label", **params) -> LevelClassifier:
    settings = {"family": "multinomial", "maxIter": 50, "regParam": 0.01} | params
    lr = LogisticRegression(
        rawPredictionCol="_raw", probabilityCol="_probability", **_COLUMNS, **settings
    )
    return LevelClassifier("regresion_logistica", lr, features, label)


def random_forest(features: list[str], label: str = "label", **params) -> LevelClassifier:
    settings = {"numTrees": 30, "maxDepth": 6, "seed": SEED} | params
    rf = RandomForestClassifier(
        rawPredictionCol="_raw", probabilityCol="_probability", **_COLUMNS, **settings
    )
    return LevelClassifier("random_forest", rf, features, label)


def gradient_boosting(features: list[str], label: str = "label", **params) -> BoostedLevels:
    settings = {"maxIter": 10, "maxDepth": 4, "seed": SEED} | params
    gbt = GBTClassifier(featuresCol="_features", **settings)
    return BoostedLevels("xgboost", gbt, features, label)


BUILDERS = {
    "regresion_logistica": logistic_regression,
    "random_forest": random_forest,
    "xgboost": gradient_boosting,
}


def metrics_row(
    scored: DataFrame,
    algorithm: str,
    event: str,
    version: str,
    label: str = "label",
    beats_baseline: bool | None = None,
) -> DataFrame:
    """One registry row: macro scores and the confusion matrix of the given forecasts.

    `beats_baseline` is the verdict of `evaluation.beats_baseline`; NULL where none was reached.
    """
    cells = evaluation.confusion(
        scored.withColumn("_one", F.lit(1)), ["_one"], actual=label, predicted="prediction"
    )
    scores = evaluation.macro_scores(cells, ["_one"])
    return (
        scores.join(evaluation.confusion_matrix(cells, ["_one"]), "_one")
        .select(
            F.lit(algorithm).alias("algorithm"),
            F.lit(event).alias("event"),
            F.lit(version).alias("version"),
            F.lit(datetime.now(timezone.utc)).alias("trained_at"),
            "macro_f1",
            "macro_precision",
            "macro_recall",
            "confusion",
            F.lit(beats_baseline).cast("boolean").alias("beats_baseline"),
        )
    )


def tune(make, grid: list[dict], folded: DataFrame, folds: int, *, gap_days: int = 0) -> DataFrame:
    """Macro F1 of every setting over the expanding folds; the earliest setting wins a tie."""
    table = None
    for i, params in enumerate(grid):
        scored = evaluation.evaluate_expanding(lambda p=params: make(**p), folded, folds, gap_days=gap_days)
        cells = evaluation.confusion(scored.withColumn("setting", F.lit(i)), ["setting"])
        row = evaluation.macro_scores(cells, ["setting"]).withColumn(
            "params", F.lit(", ".join(f"{k}={v}" for k, v in sorted(params.items())))
        )
        table = row if table is None else table.unionByName(row)
    return table.orderBy(F.desc("macro_f1"), F.asc("setting"))


def permuted(rows: DataFrame, feature: str, keys: list[str], seed: int = SEED, bucket_rows: int = 10_000) -> DataFrame:
    """The rows with one feature's values exchanged at random; every value is used exactly once.

    Rows are dealt to buckets by a hash of their keys; in a bucket the value of the row that is
    n-th by one hash goes to the row that is n-th by another. Keys tell rows apart.
    """
    buckets = max(1, -(-rows.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64(*keys, F.lit(f"{feature} {seed}")), F.lit(buckets))

    def place(salt: str):
        by = Window.partitionBy("_b").orderBy(F.xxhash64(*keys, F.lit(f"{feature} {seed} {salt}")), *keys)
        return F.row_number().over(by)

    dealt = rows.withColumn("_b", bucket)
    givers = dealt.select("_b", place("give").alias("_n"), F.col(feature).alias("_given"))
    takers = dealt.withColumn("_n", place("take"))
    return takers.join(givers, ["_b", "_n"]).withColumn(feature, F.col("_given")).drop("_b", "_n", "_given")


def permutation_importance(
    model: LevelClassifier, rows: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Accuracy lost when one feature's values are exchanged among the rows, largest loss first."""
    keys = keys or [c for c in ("series", "date") if c in rows.columns]
    known = rows.where(F.col(model.label).isNotNull())
    hit = F.avg((F.col("prediction") == F.col(model.label)).cast("double"))
    base = model.predict(known).agg(hit.alias("base")).first()["base"]
    table = None
    for f in model.features:
        moved = model.predict(permuted(known, f, keys))
        row = moved.agg((F.lit(base) - hit).alias("loss")).select(F.lit(f).alias("variable"), "loss")
        table = row if table is None else table.unionByName(row)
    return table.orderBy(F.desc("loss"), "variable")
