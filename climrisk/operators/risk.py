"""Reading risk tables: completion, lookups, legends and exports."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.schemas import LEVELS


def complete_risks(
    districts: DataFrame, risks: DataFrame, day: Date, event: str, *, code: str = "code"
) -> DataFrame:
    """Every known district, with an explicit NULL risk where nothing was estimated."""
    chosen = risks.where((F.col("date") == F.lit(day)) & (F.col("event") == event)).select(
        F.col("district").alias(code), "level", "probability"
    )
    return districts.select(code).join(chosen, code, "left").select(
        code,
        F.lit(day).alias("date"),
        F.lit(event).alias("event"),
        "level",
        "probability",
    )


def risk_lookup(risks: DataFrame, district: str, day: Date, event: str) -> DataFrame:
    """One estimate, or no row."""
    return risks.where(
        (F.col("district") == district) & (F.col("date") == F.lit(day)) & (F.col("event") == event)
    )


def legend_counts(completed: DataFrame, keys=()) -> DataFrame:
    """Districts per level, and those without an estimate as their own count."""
    return completed.groupBy(*keys).agg(
        *(F.count_if(F.col("level") == name).alias(name) for name in LEVELS),
        F.count_if(F.col("level").isNull()).alias("without_estimate"),
    )


def geojson_features(
    polygons: DataFrame,
    properties,
    *,
    code: str = "code",
    geometry: str = "geometry",
) -> DataFrame:
    """One GeoJSON feature text per row; NULL properties stay as explicit nulls."""
    coordinates = F.transform(
        F.col(geometry),
        lambda part: F.transform(
            part, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
        ),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias(
            "geometry"
        ),
        F.struct(*properties).alias("properties"),
    )
    return polygons.select(code, F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def risk_packets(completed: DataFrame) -> DataFrame:
    """One JSON line per district and event, ready to be written as text partitioned by event."""
    body = F.to_json(F.struct("code", "date", "level", "probability"), {"ignoreNullFields": "false"})
    return completed.select("event", "code", body.alias("packet"))


def series_export(
    dense: DataFrame, variable: str, unit: str, *, series: str = "series", date: str = "date"
) -> DataFrame:
    """Nested series with gaps kept as NULL points, split by year to bound each array."""
    point = F.struct(F.col(date).alias("date"), F.col(variable).cast("double").alias("value"))
    return dense.groupBy(F.col(series).alias("district"), F.year(date).alias("year")).agg(
        F.lit(variable).alias("variable"),
        F.lit(unit).alias("unit"),
        F.sort_array(F.collect_list(point)).alias("points"),
    )


def export_coverage(features: DataFrame, known: DataFrame, *, code: str = "code") -> DataFrame:
    """Codes a packet lacks or should not hold, and features without coordinates."""
    from climrisk.operators.audits import code_difference

    empty = features.where(
        F.get_json_object("feature", "$.geometry.coordinates[0][0][0]").isNull()
    ).select(code, F.lit("no coordinates").alias("side"))
    return code_difference(features, known, code).unionByName(empty)
