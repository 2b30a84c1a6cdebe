"""Calendars: dense daily tables, range reads and range tiles."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climrisk.functions import checks
from climrisk.operators.blocks import BLOCK_DAYS, keyed

# Months of the dry season; the climate normal period.
DRY_SEASON = (12, 1, 2, 3, 4)
BASE_START, BASE_END = Date(1991, 1, 1), Date(2020, 12, 31)


def _as_column(day) -> Column:
    return day if isinstance(day, Column) else F.lit(day).cast("date")


def span(daily: DataFrame, date: str = "date") -> tuple[Column, Column]:
    """First and last day of a table as scalar subqueries: no action, no join."""
    ends = daily.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return ends.select("lo").scalar(), ends.select("hi").scalar()


def calendar(members: DataFrame, start, end, date: str = "date") -> DataFrame:
    """One row per member and day, both ends included."""
    if isinstance(start, Date) and isinstance(end, Date):
        checks.ordered_range(start, end)
    days = F.sequence(_as_column(start), _as_column(end), F.expr("interval 1 day"))
    return members.withColumn(date, F.explode(days))


def densify(
    daily: DataFrame,
    start=None,
    end=None,
    *,
    members: DataFrame | None = None,
    series: str = "series",
    date: str = "date",
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Every day of every series; days without a row come out with NULL values.

    Only the rows that exist are shuffled. Each (series, block of days) holds them in order
    behind one marker for the block's first day, and every row also writes the empty days up to
    the next one. So the calendar is produced in place, a series is never one task, and blocks
    without any row are filled by their marker.
    """
    if isinstance(start, Date) and isinstance(end, Date):
        checks.ordered_range(start, end)
    daily = keyed(daily, [series, date])
    known, given = members, start is not None or end is not None
    if members is None or start is None or end is None:
        # Series and range come from one summary, kept whole so both uses share its shuffle.
        spans = daily.groupBy(series).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
        ends = spans.where("_lo <= _hi").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
        start = ends.select("lo").scalar() if start is None else start
        end = ends.select("hi").scalar() if end is None else end
        known = spans.where("_lo <= _hi") if members is None else members
    known = keyed(known, [series])
    lo, hi = F.unix_date(_as_column(start)), F.unix_date(_as_column(end))
    rest = [c for c in daily.columns if c not in (series, date)]
    markers = known.select(
        series,
        F.explode(F.sequence(F.floor(lo / block_days), F.floor(hi / block_days))).alias("_block"),
    ).select(
        series,
        "_block",
        F.greatest(F.col("_block") * block_days, lo).alias("_day"),
        F.lit(False).alias("_real"),
    )
    inside = F.col(date).between(_as_column(start), _as_column(end))
    real = (daily.where(inside) if given else daily).select(
        series,
        F.floor(F.unix_date(date) / block_days).alias("_block"),
        F.unix_date(date).cast("bigint").alias("_day"),
        F.lit(True).alias("_real"),
        *rest,
    )
    along = Window.partitionBy(series, "_block").orderBy("_day", "_real")
    last = F.least((F.col("_block") + 1) * block_days - 1, hi)
    until = F.coalesce(F.lead("_day").over(along) - 1, last)
    rows = markers.unionByName(real, allowMissingColumns=True).withColumn(
        "_to", F.when(F.col("_real"), F.greatest("_day", until)).otherwise(until)
    )
    if members is not None:
        # Rows of series outside the member list have no marker.
        marked = F.min("_real").over(Window.partitionBy(series, "_block"))
        rows = rows.withColumn("_member", ~marked).where("_member")
    own = F.col("_real") & (F.col("_d") == F.col("_day"))
    return (
        rows.where("_to >= _day")
        .withColumn("_d", F.explode(F.sequence("_day", "_to")))
        .select(
            series,
            F.date_from_unix_date(F.col("_d").cast("int")).alias(date),
            *(F.when(own, F.col(c)).alias(c) for c in rest),
        )
    )


def densify_counts(counts: DataFrame, column: str, *args, **kwargs) -> DataFrame:
    """Same calendar for detections, where no row is a true zero."""
    dense = densify(counts, *args, **kwargs)
    return dense.withColumn(column, F.coalesce(F.col(column), F.lit(0)))


def series_range(
    df: DataFrame,
    code: str,
    start: Date,
    end: Date,
    *,
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Inclusive range read of one series; an unknown code gives no rows."""
    checks.ordered_range(start, end)
    return df.where((F.col(series) == code) & F.col(date).between(F.lit(start), F.lit(end)))


def range_tiles(
    ranges: DataFrame, years: int = 19, *, start: str = "start_date", end: str = "end_date"
) -> DataFrame:
    """Cuts [start, end] into contiguous tiles of `years`; each begins the day after the last.

    A tile starting on 29 February ends on the 28th when the target year has no 29th.
    """
    checks.window_at_least(years)
    lo, hi = F.col(start), F.col(end)
    most = F.floor(F.months_between(hi, lo) / (12 * years)).cast("int") + 2
    tile = lambda a, b: F.struct(a.alias("tile_start"), b.alias("tile_end"))
    last = lambda a: F.least(F.add_months(a, 12 * years), hi)
    first = F.array(tile(lo, last(lo)))

    def extend(tiles, _):
        nxt = F.date_add(F.element_at(tiles, -1)["tile_end"], 1)
        return F.when(nxt > hi, tiles).otherwise(F.concat(tiles, F.array(tile(nxt, last(nxt)))))

    tiles = F.aggregate(F.sequence(F.lit(1), most), first, extend)
    return (
        ranges.where(hi >= lo)
        .withColumn("_tiles", tiles)
        .select(*ranges.columns, F.posexplode("_tiles").alias("tile", "_tile"))
        .select(*ranges.columns, "tile", "_tile.tile_start", "_tile.tile_end")
    )


def overlapping_tiles(rows: DataFrame, keys=("series", "date")) -> DataFrame:
    """Keys delivered by more than one tile; any row means the tiling is wrong."""
    return rows.groupBy(*keys).agg(F.count("*").alias("tiles")).where("tiles > 1")


def union_tiles(tiles: list[DataFrame], keys=("series", "date")) -> DataFrame:
    """Union of tiles that must not overlap. The guard is one action before the union."""
    whole = tiles[0]
    for tile in tiles[1:]:
        whole = whole.unionByName(tile)
    clash = overlapping_tiles(whole, keys).limit(1).collect()
    if clash:
        raise ValueError(f"tiles overlap, for instance at {clash[0].asDict()}")
    return whole


def dry_season(date: Column) -> Column:
    return F.month(date).isin(*DRY_SEASON)


def in_base_period(date: Column, start: Date = BASE_START, end: Date = BASE_END) -> Column:
    return date.between(F.lit(start), F.lit(end))
