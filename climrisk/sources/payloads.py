"""Raw payloads as tables: climate and rain JSON, GeoJSON, event and measurement CSV, detections.

Every parser takes a DataFrame with one payload per row and comes with a reader for files.
"""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climrisk.schemas import DEFAULT_FILL, REANALYSIS_COLUMNS, REANALYSIS_UNITS

REANALYSIS_JSON = (
    "header struct<fill_value: double>, "
    "geometry struct<coordinates: array<double>>, "
    "parameters map<string, struct<units: string>>, "
    "properties struct<parameter: map<string, map<string, double>>>"
)
RAIN_JSON = (
    "data array<struct<year: int, month: int, day: int, value: string, raw_value: double>>"
)
FEATURE_JSON = (
    "geometry struct<type: string, coordinates: string>, properties map<string, string>"
)
FEATURES_JSON = (
    "features array<struct<geometry: struct<type: string, coordinates: string>, "
    "properties: map<string, string>>>"
)
EVENT_CSV = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "district",
            "event",
            "start_date",
            "end_date",
            "severity",
            "source",
            "description",
        )
    ]
)


def read_texts(spark: SparkSession, path: str, payload: str = "payload") -> DataFrame:
    """One row per file, with its path."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias(payload)
    )


def parse_reanalysis(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload columns as a struct `doc`, other columns kept."""
    return df.withColumn("doc", F.from_json(payload, REANALYSIS_JSON)).drop(payload)


def unit_mismatches(parsed: DataFrame, keys=(), units: dict[str, str] = REANALYSIS_UNITS):
    """Parameters whose declared unit is absent or not the expected one."""
    checks = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(p).alias("parameter"),
                    F.lit(u).alias("expected"),
                    F.try_element_at("doc.parameters", F.lit(p))["units"].alias("declared"),
                )
                for p, u in units.items()
            )
        )
    )
    return (
        parsed.select(*keys, checks.alias("c"))
        .select(*keys, "c.*")
        .where(~F.col("declared").eqNullSafe(F.col("expected")))
    )


def require_units(parsed: DataFrame) -> None:
    """Stops the load on the first wrong unit instead of converting blindly."""
    wrong = unit_mismatches(parsed).limit(1).collect()
    if wrong:
        raise ValueError(f"unexpected unit: {wrong[0].asDict()}")


def reanalysis_daily(
    parsed: DataFrame, keys=(), columns: dict[str, str] = REANALYSIS_COLUMNS
) -> DataFrame:
    """Daily rows with one column per parameter, the header's fill value turned into NULL.

    A payload without one of the parameters fails the job.
    """
    fill = F.coalesce("doc.header.fill_value", F.lit(DEFAULT_FILL))
    series = F.col("doc.properties.parameter")
    needed = F.array(*(F.lit(p) for p in columns))
    whole = F.size(F.array_except(needed, F.map_keys(series))) == 0
    checked = F.when(whole, series).otherwise(
        F.raise_error(F.lit("a reanalysis payload lacks a parameter")).cast(
            "map<string, map<string, double>>"
        )
    )
    # A day's values of all parameters meet by one aggregation, so the work is linear in days.
    def days_of(p):
        named = lambda e: F.struct(F.lit(p).alias("p"), e["key"].alias("day"), e["value"].alias("v"))
        return F.transform(F.map_entries(F.col("_s")[p]), named)

    entries = F.flatten(F.array(*map(days_of, columns)))
    opened = parsed.select(
        F.monotonically_increasing_id().alias("_payload"), *keys, fill.alias("_fill"), checked.alias("_s")
    )
    value = lambda p: F.max(F.when(F.col("_e.p") == p, F.col("_e.v")))
    return (
        opened.select("_payload", *keys, "_fill", F.explode(entries).alias("_e"))
        .groupBy("_payload", *keys, "_fill", F.col("_e.day").alias("_day"))
        .agg(*(fill_to_null(value(p), F.col("_fill")).alias(name) for p, name in columns.items()))
        .select(*keys, F.to_date("_day", "yyyyMMdd").alias("date"), *columns.values())
    )


def fill_to_null(value, fill):
    return F.when(value != fill, value)


def read_reanalysis(spark: SparkSession, path: str) -> DataFrame:
    """Files of climate JSON to daily rows, units checked first."""
    parsed = parse_reanalysis(read_texts(spark, path))
    require_units(parsed)
    at = F.col("doc.geometry.coordinates")
    placed = parsed.withColumns({"lon": at[0], "lat": at[1]})
    return reanalysis_daily(placed, ("lon", "lat"))


def rain_rows(df: DataFrame, keys=(), payload: str = "payload") -> DataFrame:
    """Rain JSON to (keys, date, value). The value object's mean counts, else the raw value.

    A missing or negative value is NULL. A row without a usable date fails the job.
    """
    doc = F.from_json(payload, RAIN_JSON)
    rows = df.select(*keys, F.explode(doc["data"]).alias("r"))
    made = F.try_make_date if hasattr(F, "try_make_date") else None
    day = (
        made("r.year", "r.month", "r.day")
        if made
        else F.try_to_date(F.format_string("%d-%d-%d", "r.year", "r.month", "r.day"), "y-M-d")
    )
    dated = F.coalesce(
        day, F.raise_error(F.lit("a rain row has no usable date")).cast("date")
    )
    is_object = F.col("r.value").startswith("{")
    mean = F.get_json_object("r.value", "$.avg").cast("double")
    raw = F.when(F.col("r.value").isNull() | is_object, mean).otherwise(F.col("r.raw_value"))
    return rows.select(*keys, dated.alias("date"), F.when(raw >= 0, raw).alias("value"))


def read_rain(spark: SparkSession, path: str) -> DataFrame:
    return rain_rows(read_texts(spark, path), ("file",))


def geojson_rows(
    df: DataFrame,
    keys=(),
    payload: str = "payload",
    *,
    code: str = "CÓDIGO_DTA",
    name: str = "DISTRITO",
    per_line: bool = False,
) -> DataFrame:
    """Feature collections to (code, name, geometry), polygons wrapped as one-part multipolygons.

    Other geometry types are left out; the code comes from the given attribute only. With
    `per_line` every payload is one feature, the form for files too large to be one row.
    """
    if per_line:
        feature = df.select(*keys, F.from_json(payload, FEATURE_JSON).alias("f"))
    else:
        f = F.from_json(payload, FEATURES_JSON)
        feature = df.select(*keys, F.explode(f["features"]).alias("f"))
    kind = F.col("f.geometry.type")
    text = F.col("f.geometry.coordinates")
    multi = F.when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    nested = F.from_json(multi, "array<array<array<array<double>>>>")
    points = F.transform(
        nested,
        lambda part: F.transform(
            part,
            lambda ring: F.transform(
                ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
            ),
        ),
    )
    attribute = lambda a: F.nullif(
        F.trim(F.try_element_at("f.properties", F.lit(a))), F.lit("")
    )
    return feature.where(kind.isin("Polygon", "MultiPolygon")).select(
        *keys,
        attribute(code).alias("code"),
        attribute(name).alias("name"),
        points.alias("geometry"),
    )


def read_geojson(
    spark: SparkSession, path: str, *, per_line: bool = False, **attributes
) -> DataFrame:
    """Collections as whole files, or newline-delimited features read in splits."""
    if per_line:
        lines = spark.read.text(path).select(F.col("value").alias("payload"))
        return geojson_rows(lines, per_line=True, **attributes)
    return geojson_rows(read_texts(spark, path), **attributes)


def clean_event_rows(df: DataFrame) -> DataFrame:
    """Trimmed text, blank to NULL, ISO dates.

    An unreadable date is NULL, and its text stays in start_unreadable or end_unreadable: a rule
    break, not an absent date.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = {f.name: blank(f.name) for f in EVENT_CSV}
    for c in ("start_date", "end_date"):
        out[c] = F.try_to_date(blank(c), "yyyy-MM-dd")
        out[f"{c.removesuffix('_date')}_unreadable"] = F.when(out[c].isNull(), blank(c))
    return df.withColumns(out)


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Event catalogue with a header row."""
    raw = spark.read.csv(path, header=True, schema=EVENT_CSV, multiLine=True, escape='"')
    return clean_event_rows(raw)


def read_measurements_csv(spark: SparkSession, path: str) -> DataFrame:
    """Measurement dump: series, date, value; a blank value is NULL."""
    raw = spark.read.csv(path, header=True, schema="series string, date string, value string")
    return raw.select(
        F.trim("series").alias("series"),
        F.to_date(F.trim("date")).alias("date"),
        F.nullif(F.trim("value"), F.lit("")).cast("double").alias("value"),
    )


def detections_in(
    detections: DataFrame,
    start: Date,
    end: Date,
    west: float,
    east: float,
    south: float,
    north: float,
) -> DataFrame:
    """Detections of a date range inside a study area; no district is assigned here."""
    return detections.where(
        F.col("date").between(F.lit(start), F.lit(end))
        & F.col("lon").between(west, east)
        & F.col("lat").between(south, north)
    )
