"""Standardised precipitation index on monthly totals.

The index is undefined for the first `window` months of a series, for windows with a gap and
for calendar months with too few totals; all of these stay NULL. Monthly tables hold at most
twelve rows per series and year, so windows by series are small here.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climrisk.functions import checks, special
from climrisk.operators.calendar import BASE_END, BASE_START, dry_season, in_base_period
from climrisk.operators.windows import strict_sum

log = logging.getLogger(__name__)

# Fewest values for a two-parameter fit, and the flat-sample limit.
MIN_FIT = 4
FLAT_SPREAD = 1e-9


def monthly_totals(
    daily: DataFrame, *, value: str = "value", series: str = "series", date: str = "date"
) -> DataFrame:
    """Total of each calendar month; a month with any unmeasured day is NULL.

    Months without any row between the series' first and last one appear as NULL rows, so
    positions in the result are months of the calendar.
    """
    month = F.trunc(date, "month")
    totals = daily.groupBy(series, month.alias("month_start")).agg(
        F.when(
            F.count(value) == F.day(F.last_day(F.min(date))),
            F.sum(value),
        ).alias("total"),
        F.count(value).cast("int").alias("days_present"),
    )
    along = Window.partitionBy(series).orderBy("month_start")
    last = F.coalesce(F.add_months(F.lead("month_start").over(along), -1), F.col("month_start"))
    own = F.col("_m") == F.col("month_start")
    return (
        totals.withColumn("_last", last)
        .withColumn("_m", F.explode(F.sequence("month_start", "_last", F.expr("interval 1 month"))))
        .select(
            series,
            F.col("_m").alias("month_start"),
            F.when(own, F.col("total")).alias("total"),
            F.when(own, F.col("days_present")).otherwise(0).alias("days_present"),
        )
    )


def accumulate(
    monthly: DataFrame,
    window: int,
    out: str = "accumulated",
    *,
    value: str = "total",
    series: str = "series",
    order: str = "month_start",
) -> DataFrame:
    """Gap-strict sum of `window` months; the first `window` positions are NULL by definition."""
    checks.window_at_least(window)
    along = Window.partitionBy(series).orderBy(order)
    frame = along.rowsBetween(-(window - 1), 0)
    total = strict_sum(frame, F.col(value), window)
    return monthly.withColumn(out, F.when(F.row_number().over(along) > window, total))


def gamma_parameters(
    sample: DataFrame, keys=("series", "month"), *, value: str = "accumulated"
) -> DataFrame:
    """Maximum-likelihood gamma of the positive values with the origin at zero, per group.

    Each group is reduced to sufficient statistics, and the likelihood equation is solved on those.
    Too few or flat positives, or an equation without a solution, leave shape and scale NULL;
    zero_share is always known.
    """
    x = F.col(value)
    wet = F.when(x > 0, x)
    stats = (
        sample.where(x.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(x).alias("n"),
            F.count(wet).alias("n_positive"),
            F.avg(wet).alias("_mean"),
            F.avg(F.ln(wet)).alias("_mean_log"),
            ((F.max(wet) - F.min(wet)) / F.avg(wet)).alias("_spread"),
        )
    )
    usable = (F.col("n_positive") >= MIN_FIT) & (F.col("_spread") >= FLAT_SPREAD)
    solved = stats.withColumn(
        "shape", F.when(usable, F.expr(special.gamma_shape("_mean", "_mean_log")))
    )
    return solved.select(
        *keys,
        "n",
        "n_positive",
        ((F.col("n") - F.col("n_positive")) / F.col("n")).alias("zero_share"),
        "shape",
        (F.col("_mean") / F.col("shape")).alias("scale"),
    )


def negative_rain(df: DataFrame, value: str = "value") -> DataFrame:
    """How many values are impossible, and the lowest: zero rows of harm in a sound table."""
    return df.agg(
        F.count_if(F.col(value) < 0).alias("negatives"), F.min(value).alias("lowest")
    )


def require_no_negative_rain(df: DataFrame, value: str = "value") -> None:
    """One aggregate action; raises when a value is negative."""
    found = negative_rain(df, value).first()
    if found["negatives"]:
        raise ValueError(
            f"precipitation cannot be negative: {found['negatives']} values, lowest "
            f"{found['lowest']:.2f}; a smoothed series would explain it"
        )


def spi(
    monthly: DataFrame,
    window: int = 3,
    out: str = "spi",
    *,
    by_month: bool = True,
    value: str = "total",
    series: str = "series",
    order: str = "month_start",
    guard: bool = False,
) -> DataFrame:
    """The index, fitted per series and calendar month.

    `by_month=False` fits one distribution per series. That follows the seasons and is no
    anomaly index; it exists for comparison only and says so in the log.
    """
    if guard:
        require_no_negative_rain(monthly, value)
    sums = accumulate(monthly, window, "accumulated", value=value, series=series, order=order)
    sums = sums.withColumn("month", F.month(order))
    keys = [series, "month"] if by_month else [series]
    if not by_month:
        log.warning("index with one fit per series follows the seasons: not an anomaly index")
    fit = gamma_parameters(sums, keys).where(F.col("n") >= MIN_FIT)
    index = F.expr(special.standard_index("accumulated", "shape", "scale", "zero_share"))
    return (
        sums.join(fit.select(*keys, "shape", "scale", "zero_share"), keys, "left")
        .withColumn(out, index)
        .drop("shape", "scale", "zero_share")
    )


def climatology(
    df: DataFrame,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
    start=BASE_START,
    end=BASE_END,
) -> DataFrame:
    """Monthly normals of the base period."""
    base = df.where(in_base_period(F.col(date), start, end))
    return base.groupBy(series, F.month(date).alias("month")).agg(F.avg(value).alias("normal"))


def anomaly(
    df: DataFrame,
    normals: DataFrame,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Value minus the normal of its own month; no normal, no anomaly."""
    return (
        df.withColumn("month", F.month(date))
        .join(normals, [series, "month"], "left")
        .withColumn("anomaly", F.col(value) - F.col("normal"))
    )


def spi_audit(monthly: DataFrame, window: int = 3, *, series: str = "series") -> DataFrame:
    """Per-month against single fit: season means, drought months, overlap, correlation."""
    keys = [series, "month_start"]
    a = spi(monthly, window, "by_month", series=series).select(*keys, "by_month")
    b = spi(monthly, window, "pooled", by_month=False, series=series).select(*keys, "pooled")
    both = a.join(b, keys).where(F.col("by_month").isNotNull() & F.col("pooled").isNotNull())
    dry = dry_season(F.col("month_start"))
    drought_a, drought_b = F.col("by_month") <= -1.0, F.col("pooled") <= -1.0
    return both.groupBy(series).agg(
        F.count("*").alias("months"),
        F.avg(F.when(dry, F.col("by_month"))).alias("dry_mean_by_month"),
        F.avg(F.when(dry, F.col("pooled"))).alias("dry_mean_pooled"),
        F.avg(F.when(~dry, F.col("by_month"))).alias("wet_mean_by_month"),
        F.avg(F.when(~dry, F.col("pooled"))).alias("wet_mean_pooled"),
        F.count_if(drought_a).alias("drought_by_month"),
        F.count_if(drought_b).alias("drought_pooled"),
        F.count_if(drought_a & drought_b).alias("drought_both"),
        F.corr("by_month", "pooled").alias("correlation"),
    )
