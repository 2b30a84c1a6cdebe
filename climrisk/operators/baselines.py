"""Reference forecasts a model has to beat: climatology and persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.functions import levels


class NotTrained(RuntimeError):
    """Raised instead of returning a made-up prediction."""


class ClimatologicalBaseline:
    """Most frequent level of each (series, month, event), ties to the more severe.

    Groups never seen fall back to the overall mode of the event. The probability is the share
    of high levels in the group. There is no explanation: `explain` returns None.
    """

    algorithm = "linea_base_climatologica"

    def __init__(
        self,
        *,
        series: str = "series",
        date: str = "date",
        event: str = "event",
        label: str = "label",
    ):
        self.series, self.date, self.event, self.label = series, date, event, label
        self.modes: DataFrame | None = None
        self.overall: DataFrame | None = None

    def _mode(self, labelled: DataFrame, keys: list[str]) -> DataFrame:
        counts = labelled.groupBy(*keys, "_rank").agg(F.count("*").alias("_n"))
        return counts.groupBy(*keys).agg(
            F.max_by("_rank", F.struct("_n", "_rank")).alias("_rank"),
            (F.sum(F.when(F.col("_rank") == 2, F.col("_n")).otherwise(0)) / F.sum("_n")).alias(
                "probability"
            ),
        )

    def train(self, rows: DataFrame) -> ClimatologicalBaseline:
        labelled = rows.where(F.col(self.label).isNotNull()).select(
            self.series,
            self.event,
            F.month(self.date).alias("month"),
            levels.severity(F.col(self.label)).alias("_rank"),
        )
        self.modes = self._mode(labelled, [self.series, "month", self.event])
        self.overall = self._mode(labelled, [self.event])
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.modes is None:
            raise NotTrained("train the climatological baseline before predicting")
        own = self.modes.select(
            self.series,
            F.col("month").alias("_month"),
            self.event,
            F.col("_rank").alias("_own"),
            F.col("probability").alias("_own_p"),
        )
        # One entry per event of a closed vocabulary.
        entry = F.struct(self.event, F.struct("_rank", "probability").alias("v"))
        rest = self.overall.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
        other = F.try_element_at(rest, F.col(self.event))
        return (
            rows.withColumn("_month", F.month(self.date))
            .join(own, [self.series, "_month", self.event], "left")
            .withColumn("prediction", levels.level_name(F.coalesce("_own", other["_rank"])))
            .withColumn("probability", F.coalesce("_own_p", other["probability"]))
            .drop("_month", "_own", "_own_p")
        )

    def explain(self, rows: DataFrame) -> None:
        return None


class Persistence:
    """Today's level is the forecast; a day without a level gets none."""

    algorithm = "persistencia"

    def __init__(self, *, level: str = "level"):
        self.level = level

    def train(self, rows: DataFrame) -> Persistence:
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.col(self.level)).withColumn(
            "probability", F.lit(None).cast("double")
        )

    def explain(self, rows: DataFrame) -> None:
        return None
