"""Hazard levels per series and day, and the forward label built from them.

Thresholds are a definition: they are computed once on the base period and passed in, never
refitted inside an evaluation fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.functions import checks, levels
from climrisk.operators.blocks import framed
from climrisk.operators.thresholds import percentiles_of_sums
from climrisk.operators.windows import rolling_sum
from climrisk.schemas import LEVELS

HORIZON_DAYS = 7
FIRE_WINDOW_DAYS = 7


def rain_levels(
    daily: DataFrame,
    thresholds: DataFrame | None = None,
    window: int = 3,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Level of the 72-hour sum against the series' own accumulated thresholds.

    Without given thresholds they come from the base period of the same sums.
    """
    sums = rolling_sum(daily, window, "total", value=value, series=series, date=date)
    if thresholds is None:
        thresholds = percentiles_of_sums(sums, series=series, date=date)
    limits = thresholds.select(series, "p95_accumulated", "p99_accumulated")
    return sums.join(limits, series, "left").withColumn(
        "level",
        levels.rain_level(F.col("total"), F.col("p95_accumulated"), F.col("p99_accumulated")),
    )


def drought_levels(index: DataFrame, spi: str = "spi") -> DataFrame:
    return index.withColumn("level", levels.drought_level(F.col(spi)))


def levels_by_day(
    monthly_levels: DataFrame,
    days: DataFrame,
    *,
    level: str = "level",
    series: str = "series",
    date: str = "date",
    month: str = "month_start",
) -> DataFrame:
    """Each day with the level of the last complete month, so a day never sees its own month."""
    known = monthly_levels.select(series, F.add_months(month, 1).alias("_m"), level)
    return (
        days.select(series, date)
        .withColumn("_m", F.trunc(date, "month"))
        .join(known, [series, "_m"], "left")
        .drop("_m")
    )


def trailing_counts(
    daily_counts: DataFrame,
    window: int = FIRE_WINDOW_DAYS,
    out: str = "n",
    *,
    count: str = "detections",
    **where,
) -> DataFrame:
    """Detections of the last `window` days on a zero-filled calendar."""
    checks.window_at_least(window)
    return framed(
        daily_counts,
        window - 1,
        0,
        lambda f: {out: F.coalesce(F.sum(count).over(f.days(-(window - 1), 0)), F.lit(0))},
        **where,
    )


def fire_levels(
    windows: DataFrame, thresholds: DataFrame, *, count: str = "n", series: str = "series"
) -> DataFrame:
    """Level of the 7-day count against the series' own 90th percentile."""
    return windows.join(thresholds.select(series, "p90"), series, "left").withColumn(
        "level", levels.fire_level(F.col(count), F.col("p90"))
    )


def forward_label(
    leveled: DataFrame,
    horizon: int = HORIZON_DAYS,
    out: str = "label",
    *,
    level: str = "level",
    **where,
) -> DataFrame:
    """Highest level of the next `horizon` days, the row's own day excluded.

    Any day of the horizon without a level makes the label NULL.
    """
    checks.window_at_least(horizon)
    rank = levels.severity(F.col(level))

    def build(f):
        ahead = f.days(1, horizon)
        whole = F.count(rank).over(ahead) == horizon
        return {out: F.when(whole, levels.level_name(F.max(rank).over(ahead)))}

    return framed(leveled, 0, horizon, build, **where)


def label_distribution(
    labels: DataFrame,
    *,
    label: str = "label",
    event: str = "event",
    series: str = "series",
    date: str = "date",
    subtotals: bool = False,
) -> DataFrame:
    """Days of each level and days without a label, per event, series and year."""
    keys = [F.col(event), F.col(series), F.year(date).alias("year")]
    grouped = labels.rollup(*keys) if subtotals else labels.groupBy(*keys)
    return grouped.agg(
        *(F.count_if(F.col(label) == name).alias(name) for name in LEVELS),
        F.count_if(F.col(label).isNull()).alias("without_label"),
        F.count("*").alias("days"),
    )
