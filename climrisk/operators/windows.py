"""Ordered operators on daily series: sums, smoothing, runs, streaks, filling, resampling.

Input is long form (series, date, value) with unique (series, date). A NULL value and an
absent row mean the same: not measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climrisk.functions import checks
from climrisk.functions.kernels import smoothing_matrix
from climrisk.operators.blocks import BLOCK_DAYS, carried, framed
from climrisk.schemas import IMPUTATION_METHODS

# Wet-day limit in mm, smoothing window and order.
WET_DAY_MM = 1.0
SMOOTHING_WINDOW, SMOOTHING_ORDER = 7, 2


def strict_sum(frame, value: Column, window: int) -> Column:
    """Sum over a frame, NULL unless all `window` days are measured."""
    return F.when(F.count(value).over(frame) == window, F.sum(value).over(frame))


def rolling_sum(
    df: DataFrame, window: int, out: str = "total", *, value: str = "value", **where
) -> DataFrame:
    """Sum of the last `window` days ending on the row's day; any gap gives NULL."""
    checks.window_at_least(window)
    return framed(
        df,
        window - 1,
        0,
        lambda f: {out: strict_sum(f.days(-(window - 1), 0), F.col(value), window)},
        **where,
    )


def moving_average(
    df: DataFrame, window: int, out: str = "smooth", *, value: str = "value", **where
) -> DataFrame:
    """Centred mean of the measured days; an unmeasured day stays NULL."""
    checks.window_at_least(window)
    r = window // 2
    return framed(
        df,
        r,
        r,
        lambda f: {out: F.when(F.col(value).isNotNull(), F.avg(value).over(f.days(-r, r)))},
        **where,
    )


def smooth(
    df: DataFrame,
    window: int = SMOOTHING_WINDOW,
    order: int = SMOOTHING_ORDER,
    out: str = "smooth",
    *,
    value: str = "value",
    variable: str | None = None,
    **where,
) -> DataFrame:
    """Local polynomial smoothing of every gap-free run; a day without a row is a gap too.

    Inside a run each value is a fixed weighting of its neighbours. The first and last
    half-window take the polynomial of the run's first or last `window` values. Runs shorter
    than the window pass unchanged and gaps stay gaps. Rain must never be smoothed.
    """
    checks.odd_window_over_order(window, order)
    if variable == "precip_mm":
        raise ValueError("precipitation is never smoothed: it would create negative rain")
    weights = smoothing_matrix(window, order)
    half, reach = window // 2, window - 1

    def build(f):
        at = {0: F.col(value)}
        for k in range(1, reach + 1):
            at[-k] = F.max(value).over(f.days(-k, -k))
            at[k] = F.max(value).over(f.days(k, k))
        return {f"_at{i + reach}": at[i] for i in range(-reach, reach + 1)}

    near = framed(df, reach, reach, build, **where)
    at = {i: F.col(f"_at{i + reach}") for i in range(-reach, reach + 1)}

    def measured(sign: int) -> Column:
        """Measured days directly before (-1) or after (+1), counted up to the reach."""
        found = F.lit(reach)
        for k in range(reach, 0, -1):
            found = F.when(at[sign * k].isNull(), F.lit(k - 1)).otherwise(found)
        return found

    def weighted(row: int, offset: int) -> Column:
        total = F.lit(0.0)
        for j in range(window):
            total = total + at[j + offset] * F.lit(float(weights[row][j]))
        return total

    before, after = F.col("_before"), F.col("_after")
    smoothed = F.when(before + after + 1 < window, at[0])
    for i in range(half):
        smoothed = smoothed.when(before == i, weighted(i, -i))
        smoothed = smoothed.when(after == i, weighted(window - 1 - i, -(window - 1 - i)))
    smoothed = smoothed.otherwise(weighted(half, -half))
    return (
        near.withColumns({"_before": measured(-1), "_after": measured(1)})
        .withColumn(out, F.when(at[0].isNotNull(), smoothed))
        .drop("_before", "_after", *(f"_at{i}" for i in range(2 * reach + 1)))
    )


def runs(
    df: DataFrame,
    *,
    value: str = "value",
    series="series",
    date: str = "date",
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Gap-free runs as [run_start, run_end) with their length.

    Runs are found inside each block; only pieces touching a block edge are joined up.
    """
    keys = [series] if isinstance(series, str) else list(series)
    day = F.unix_date(date)
    present = df.where(F.col(value).isNotNull()).select(
        *keys, day.alias("_day"), F.floor(day / block_days).alias("_block")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_day")
    pieces = (
        present.withColumn("_island", F.col("_day") - F.row_number().over(inside))
        .groupBy(*keys, "_block", "_island")
        .agg(F.min("_day").alias("_a"), (F.max("_day") + 1).alias("_b"))
    )
    first_day = F.col("_block") * block_days
    edge = (F.col("_a") == first_day) | (F.col("_b") == first_day + block_days)
    along = Window.partitionBy(*keys).orderBy("_a")
    joined = (
        pieces.where(edge)
        .withColumn("_new", (F.lag("_b").over(along).eqNullSafe(F.col("_a"))).cast("int"))
        .withColumn("_run", F.sum(1 - F.col("_new")).over(along))
        .groupBy(*keys, "_run")
        .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
        .drop("_run")
    )
    whole = pieces.where(~edge).select(*keys, "_a", "_b").unionByName(joined)
    return whole.select(
        *keys,
        F.date_from_unix_date(F.col("_a").cast("int")).alias("run_start"),
        F.date_from_unix_date(F.col("_b").cast("int")).alias("run_end"),
        (F.col("_b") - F.col("_a")).cast("int").alias("days"),
    )


def dry_streak(
    df: DataFrame,
    out: str = "dry_days",
    *,
    value: str = "value",
    limit: float = WET_DAY_MM,
    date: str = "date",
    **where,
) -> DataFrame:
    """Days without rain up to and including the row, on a dense calendar.

    A wet day gives 0 and an unmeasured day NULL. An unmeasured day ends the streak, and the
    start of the series does too: days before it are unknown.
    """
    v, day = F.col(value), F.unix_date(date)
    marked = carried(
        df, {"_break": F.when(v.isNull() | (v >= limit), day)}, date=date, **where
    )
    keys = where.get("series", "series")
    keys = [keys] if isinstance(keys, str) else list(keys)
    starts = df.groupBy(*keys).agg(F.min(day).alias("_start"))
    since = F.coalesce(F.col("_break"), F.col("_start") - 1)
    return (
        marked.join(starts, keys)
        .withColumn(out, F.when(v.isNotNull(), (day - since).cast("int")))
        .drop("_break", "_start")
    )


def resample(
    df: DataFrame,
    factor: int,
    how: str,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Groups each dense series by `factor` days from its first day.

    A group with more than half its days unmeasured gives NULL; exactly half is kept. The last
    group may be short.
    """
    checks.window_at_least(factor)
    aggregates = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
    checks.one_of("aggregation", how, aggregates)
    starts = df.groupBy(series).agg(F.min(date).alias("_start"), F.max(date).alias("_end"))
    block = F.floor(F.datediff(date, "_start") / factor).cast("int")
    # Absent days count as unmeasured ones: a block's length comes from the calendar.
    length = F.least(F.lit(factor), F.datediff("_end", F.date_add("_start", F.col("block") * factor)) + 1)
    return (
        df.join(starts, series)
        .groupBy(series, "_start", "_end", block.alias("block"))
        .agg(aggregates[how](value).alias("value"), F.count(value).alias("present"))
        .withColumn("value", F.when(F.col("present") * 2 >= length, F.col("value")))
        .withColumn("block_start", F.date_add("_start", F.col("block") * factor))
        .select(series, "block", "block_start", "present", "value")
    )


def lagged_features(
    df: DataFrame,
    lags=(1, 3, 7),
    sums=(3, 7),
    means=(7,),
    *,
    value: str = "value",
    date: str = "date",
    audit: bool = False,
    **where,
) -> DataFrame:
    """Lags, strict sums and means of days up to the row's own.

    `touched` is the latest day that any feature read. With audit=True, touched_<feature> tells it
    for each, from the very frame that the feature is made of. A negative lag reads a later day.
    """
    before = max([0, *lags, *(w - 1 for w in (*sums, *means))])
    after = max([0, *(-k for k in lags)])

    def build(f):
        v = F.col(value)
        frames = {_lag_name(k): f.days(-k, -k) for k in lags}
        frames |= {f"sum_{w}": f.days(-(w - 1), 0) for w in sums}
        frames |= {f"mean_{w}": f.days(-(w - 1), 0) for w in means}
        made = {_lag_name(k): F.max(v).over(frames[_lag_name(k)]) for k in lags}
        made |= {f"sum_{w}": strict_sum(frames[f"sum_{w}"], v, w) for w in sums}
        made |= {f"mean_{w}": F.avg(v).over(frames[f"mean_{w}"]) for w in means}
        return made | {f"touched_{n}": F.max(date).over(frame) for n, frame in frames.items()}

    out = framed(df, before, after, build, date=date, **where)
    each = [c for c in out.columns if c.startswith("touched_")]
    latest = F.greatest(*each) if len(each) > 1 else F.col(each[0])
    out = out.withColumn("touched", latest)
    return out if audit else out.drop(*each)


def _lag_name(k: int) -> str:
    return f"lag_{k}" if k >= 0 else f"ahead_{-k}"


def leak_audit(features: DataFrame, *, date: str = "date") -> DataFrame:
    """Per feature: rows, rows that read a day after their own, and how far; a sound one has none.

    Reads the touched_<feature> columns, or `touched` alone where there are no others.
    """
    each = [c for c in features.columns if c.startswith("touched_")] or ["touched"]
    read = F.explode(
        F.array(*(F.struct(F.lit(c.removeprefix("touched_")).alias("feature"), F.col(c).alias("day")) for c in each))
    )
    return (
        features.select(date, read.alias("r"))
        .groupBy(F.col("r.feature").alias("feature"))
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("r.day") > F.col(date)).alias("violations"),
            F.max(F.datediff("r.day", date)).alias("latest_offset_days"),
        )
    )


def impute_linear(
    df: DataFrame,
    longest_gap: int = 7,
    *,
    value: str = "value",
    date: str = "date",
    **where,
) -> DataFrame:
    """Fills interior gaps up to `longest_gap` days on the line between their two ends.

    `rows=`, about the number of rows of `df`, bounds what a task holds (see `carried`).
    """
    checks.window_at_least(longest_gap)
    day = F.unix_date(date)
    known = F.when(F.col(value).isNotNull(), F.struct(day.alias("d"), F.col(value).alias("v")))
    both = carried(df, {"_prev": known}, {"_next": known}, date=date, **where)
    p, n = F.col("_prev"), F.col("_next")
    gap = n["d"] - p["d"] - 1
    line = p["v"] + (n["v"] - p["v"]) * (day - p["d"]) / (n["d"] - p["d"])
    fill = F.col(value).isNull() & (gap <= longest_gap)
    return _flagged(both, value, F.when(fill, line), IMPUTATION_METHODS[1]).drop("_prev", "_next")


def impute_moving_mean(
    df: DataFrame, window: int = 7, *, value: str = "value", **where
) -> DataFrame:
    """Fills a gap with the mean of the measured days around it."""
    checks.window_at_least(window)
    r = window // 2
    near = framed(df, r, r, lambda f: {"_fill": F.avg(value).over(f.days(-r, r))}, **where)
    return _flagged(near, value, F.col("_fill"), IMPUTATION_METHODS[2]).drop("_fill")


def impute_climatology(
    df: DataFrame,
    normals: DataFrame,
    *,
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Fills a gap with the series' own monthly normal (columns series, month, normal)."""
    keyed = df.withColumn("month", F.month(date)).join(normals, [series, "month"], "left")
    return _flagged(keyed, value, F.col("normal"), IMPUTATION_METHODS[3]).drop("month", "normal")


def _flagged(df: DataFrame, value: str, fill: Column, method: str) -> DataFrame:
    filled = F.col(value).isNull() & fill.isNotNull()
    return df.withColumns(
        {
            "filled": F.coalesce(F.col(value), fill),
            "imputed": filled,
            "imputation_method": F.when(filled, method).otherwise(IMPUTATION_METHODS[0]),
        }
    )


def outlier_flags(
    df: DataFrame,
    *,
    value: str = "value",
    series: str = "series",
    factor: float = 1.5,
    lowest: float | None = None,
    highest: float | None = None,
) -> DataFrame:
    """Marks values outside the quartile fences or the physical range; drops none."""
    fences = df.groupBy(series).agg(
        F.percentile(value, 0.25).alias("_q1"), F.percentile(value, 0.75).alias("_q3")
    )
    spread = F.col("_q3") - F.col("_q1")
    v = F.col(value)
    outside = (v < F.col("_q1") - factor * spread) | (v > F.col("_q3") + factor * spread)
    impossible = F.lit(False)
    if lowest is not None:
        impossible = impossible | (v < lowest)
    if highest is not None:
        impossible = impossible | (v > highest)
    return (
        df.join(fences, series, "left")
        .withColumn("outlier", F.coalesce(outside, F.lit(False)))
        .withColumn("impossible", F.coalesce(impossible, F.lit(False)))
        .drop("_q1", "_q3")
    )
