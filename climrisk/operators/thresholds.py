"""Extreme-rain and fire thresholds, each from the series' own history.

An exact percentile keeps one counter per distinct value of a group. The groups here are daily
series with unique (series, date) inside a base period, so a group never holds more values than
the period has days (10,958 for the default one).
"""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climrisk.functions import checks
from climrisk.operators.calendar import BASE_END, BASE_START, in_base_period
from climrisk.operators.windows import WET_DAY_MM, rolling_sum

# Fixed value: fewest values for a tail percentile.
MIN_SAMPLE = 20


def _tail(value, percent: float):
    checks.open_percentile(percent)
    return F.when(F.count(value) >= MIN_SAMPLE, F.percentile(value, percent / 100))


def wet_day_percentiles(
    daily: DataFrame,
    percents=(95, 99),
    start: Date = BASE_START,
    end: Date = BASE_END,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Percentiles of daily rain over wet days of the base period; thin samples give NULL."""
    wet = daily.where((F.col(value) >= WET_DAY_MM) & in_base_period(F.col(date), start, end))
    return wet.groupBy(series).agg(
        F.count(value).alias("wet_days"),
        *(_tail(F.col(value), p).alias(f"p{p:g}_daily") for p in percents),
    )


def accumulated_percentiles(
    daily: DataFrame,
    percents=(95, 99),
    window: int = 3,
    start: Date = BASE_START,
    end: Date = BASE_END,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Percentiles of rolling sums, dry ones included, windows with gaps left out."""
    sums = rolling_sum(daily, window, "_sum", value=value, series=series, date=date)
    return percentiles_of_sums(
        sums, percents, start, end, total="_sum", series=series, date=date
    )


def percentiles_of_sums(
    sums: DataFrame,
    percents=(95, 99),
    start: Date = BASE_START,
    end: Date = BASE_END,
    *,
    total: str = "total",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """The same from sums already rolled. The base period applies to a window's last day."""
    known = sums.where(F.col(total).isNotNull() & in_base_period(F.col(date), start, end))
    return known.groupBy(series).agg(
        F.count(total).alias("windows"),
        *(_tail(F.col(total), p).alias(f"p{p:g}_accumulated") for p in percents),
    )


def district_thresholds(
    daily: DataFrame,
    members: DataFrame | None = None,
    window: int = 3,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Both definitions for every series, in one aggregation over the rolled table.

    A series without enough data keeps NULLs.
    """
    sums = rolling_sum(daily, window, "_sum", value=value, series=series, date=date)
    base = in_base_period(F.col(date))
    kinds = {
        "daily": F.when(base & (F.col(value) >= WET_DAY_MM), F.col(value)),
        "accumulated": F.when(base, F.col("_sum")),
    }
    limits = sums.groupBy(series).agg(
        *(_tail(v, p).alias(f"p{p}_{kind}") for kind, v in kinds.items() for p in (95, 99))
    )
    return limits if members is None else members.select(series).join(limits, series, "left")


def count_threshold(
    windows: DataFrame,
    percent: float = 90,
    *,
    count: str = "n",
    series: str = "series",
    only_active: bool = False,
) -> DataFrame:
    """Percentile of historical window counts, over all windows or only those with any."""
    checks.open_percentile(percent)
    seen = windows.where(F.col(count) >= 1) if only_active else windows
    return seen.groupBy(series).agg(
        F.percentile(F.col(count).cast("double"), percent / 100).alias(f"p{percent:g}")
    )


def threshold_audit(
    daily: DataFrame,
    window: int = 3,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """What goes wrong with the other definition's threshold, and with dry days kept.

    The truncated percentile takes the value at position floor(0.95 (n - 1)) of all days.
    """
    limits = district_thresholds(daily, window=window, value=value, series=series, date=date)
    sums = rolling_sum(daily, window, "_sum", value=value, series=series, date=date)
    exceed = (
        sums.where(F.col("_sum").isNotNull())
        .join(limits, series)
        .groupBy(series)
        .agg(
            F.count("*").alias("windows"),
            F.count_if(F.col("_sum") > F.col("p99_accumulated")).alias("high_right"),
            F.count_if(F.col("_sum") > F.col("p99_daily")).alias("high_wrong"),
        )
    )
    counted = (
        daily.where(F.col(value).isNotNull())
        .groupBy(series, value)
        .agg(F.count("*").alias("_c"))
        .withColumn("_upto", F.sum("_c").over(Window.partitionBy(series).orderBy(value)))
        .withColumn("_n", F.sum("_c").over(Window.partitionBy(series)))
    )
    truncated = counted.where(F.col("_upto") > F.floor(0.95 * (F.col("_n") - 1))).groupBy(
        series
    ).agg(F.min(value).alias("p95_all_days"))
    return (
        limits.join(exceed, series, "left")
        .join(truncated, series, "left")
        .select(
            series, "windows", "high_right", "high_wrong", "p95_daily", "p95_all_days"
        )
    )
