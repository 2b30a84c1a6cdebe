"""The table of derived indices: one row per district and day, put together from what each day could know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climrisk.functions import checks
from climrisk.operators import spi
from climrisk.operators.windows import dry_streak
from climrisk.schemas import DERIVED_INDEX, KEYS
from climrisk.sources import versions

#: Index column and the months that it accumulates.
WINDOWS = {"spi_1m": 1, "spi_3m": 3}


def monthly_indices(rain: DataFrame, windows: dict[str, int] | None = None, **where) -> DataFrame:
    """All indices of a series and month, from one table of monthly totals.

    `known_in` is the month whose days may see them: the one after, as a month is known at its end.
    """
    series = where.get("series", "series")
    months = spi.monthly_totals(rain, **where)
    table = months.select(series, "month_start")
    for name, window in (windows or WINDOWS).items():
        one = spi.spi(months, window, name, series=series).select(series, "month_start", name)
        table = table.join(one, [series, "month_start"])
    return table.withColumn("known_in", F.add_months("month_start", 1))


def derived_indices(
    rain: DataFrame,
    temperature: DataFrame,
    *,
    windows: dict[str, int] | None = None,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Precipitation indices, temperature anomaly and dry days of each district and day.

    Both inputs are dense daily series. A day carries the indices of the last complete month, its
    own distance from the month's normal of the base period, and the days without rain up to it.
    Days that only one input has are there with NULL for the other; what can't be computed is NULL.
    """
    names = list(windows or WINDOWS)
    checks.window_at_least(min((windows or WINDOWS).values()))
    where = {"value": value, "series": series, "date": date}
    dry = dry_streak(rain, "dry_days", **where).select(series, date, "dry_days")
    warm = spi.anomaly(temperature, spi.climatology(temperature, **where), **where).select(
        series, date, F.col("anomaly").alias("temp_anomaly")
    )
    monthly = monthly_indices(rain, windows, **where).select(series, F.col("known_in").alias("_m"), *names)
    return (
        dry.join(warm, [series, date], "full")
        .withColumn("_m", F.trunc(date, "month"))
        .join(monthly, [series, "_m"], "left")
        .select(F.col(series).cast("string").alias("district"), F.col(date).alias("date"), *names, "temp_anomaly", "dry_days")
    )


def save_indices(spark: SparkSession, path: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Upsert by district and day; all years of the delivery become visible together."""
    fitted = rows.select(*(F.col(f.name).cast(f.dataType) for f in DERIVED_INDEX))
    return versions.upsert_by_year(spark, path, fitted, KEYS["derived_index"], order="date", batch=batch)


def read_indices(spark: SparkSession, path: str, first, last, district: str | None = None) -> DataFrame:
    """Stored rows from `first` to `last`, both included; only the years between are opened."""
    rows = versions.read_years(spark, path).where(
        F.col("year").between(first.year, last.year) & F.col("date").between(F.lit(first), F.lit(last))
    )
    rows = rows.select(*(f.name for f in DERIVED_INDEX))
    return rows if district is None else rows.where(F.col("district") == district)
