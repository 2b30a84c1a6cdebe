"""Streaming forms of the keyed load and the seven-day detection windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climrisk.sources.versions import upsert_by_year


def upsert_stream(
    rows: DataFrame,
    path: str,
    keys=("district", "date"),
    *,
    date: str = "date",
    order: str = "downloaded_at",
    checkpoint: str,
):
    """Writer that merges every micro-batch with the batch rule.

    The number of a batch is committed together with its rows, under the name of the checkpoint, so a
    batch that is replayed after a failure is taken in once: either it was not committed, and its
    rows are written now, or it was, and the replay changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        upsert_by_year(batch.sparkSession, path, batch, keys, date=date, order=order, batch=(checkpoint, number))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def distinct_detections(
    detections: DataFrame,
    keys=("detection_id",),
    *,
    ts: str = "ts",
    lateness: str = "1 day",
) -> DataFrame:
    """Drops repeated deliveries that arrive within the allowed lateness."""
    return detections.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def sliding_counts(
    detections: DataFrame,
    *,
    ts: str = "ts",
    series: str = "district",
    window: str = "7 days",
    slide: str = "1 day",
    lateness: str = "1 day",
) -> DataFrame:
    """Detections per district in sliding windows; `date` is the window's last day.

    On closed windows it equals the trailing batch count. Days without any detection in the
    window do not appear; the batch calendar supplies their zeros. Windows turn at midnight of
    the session's time zone, as days do in the batch tables.
    """
    wall = F.from_utc_timestamp(ts, F.current_timezone())
    local = detections.withColumn(ts, wall)
    marked = local.withWatermark(ts, lateness)
    counts = marked.groupBy(F.window(ts, window, slide).alias("w"), series).agg(
        F.count("*").alias("n")
    )
    last = F.floor(F.unix_seconds("w.end") / 86400).cast("int") - 1
    return counts.select(series, F.date_from_unix_date(last).alias("date"), "n")


def read_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """New parquet files of a landing folder, a bounded number per trigger."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )
