"""Ordered computation over a daily series, cut into bounded stretches of time.

A window partitioned by series alone puts a whole series into one task. Everything here
partitions by (series, block) instead, where a block is a fixed number of days:

* fixed frames copy the few rows a neighbouring block needs (the halo) and drop them after;
* running values are computed inside each block and completed with what the earlier blocks
  of the same series hand over, one small row per block.

The results equal those of a window over the whole series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DAYS = 2048
# Rows that one task sorts where their number is known.
TASK_ROWS = 1 << 18

_TAGS = ("_day", "_block", "_core")


class Frames:
    """Window specifications valid inside one block."""

    def __init__(self, keys: list[str]):
        self._base = Window.partitionBy(*keys, "_block")

    def days(self, first: int, last: int):
        """Calendar frame: days counted from the current one, missing days stay missing."""
        return self._base.orderBy("_day").rangeBetween(first, last)

    @property
    def ordered(self):
        return self._base.orderBy("_day")


def _keys(series) -> list[str]:
    return [series] if isinstance(series, str) else list(series)


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have their keys. Rows without belong to no series.

    Saying so up front also keeps the two sides of a later outer join on the same plan: the
    optimiser would otherwise add the test to one side only, and their shuffle would not be shared.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def _by_block(
    df: DataFrame, keys: list[str], date: str, block_days: int, rows: int | None = None
) -> DataFrame:
    """Rows placed by (series, block) once; whatever is derived per block reuses that shuffle.

    With `rows`, about their number, there is a part for every TASK_ROWS of them.
    """
    block = F.floor(F.unix_date(F.col(date)) / block_days)
    parts = [] if rows is None else [max(1, -(-rows // TASK_ROWS))]
    return keyed(df, [*keys, date]).withColumn("_block", block).repartition(*parts, *keys, "_block")


def framed(
    df: DataFrame,
    before: int,
    after: int,
    build: Callable[[Frames], dict[str, Column]],
    *,
    series="series",
    date: str = "date",
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Adds columns whose frames reach `before` days back and `after` days ahead."""
    keys = _keys(series)
    day = F.unix_date(F.col(date))
    tagged = (
        keyed(df, [*keys, date])
        .withColumn("_day", day)
        .withColumn(
            "_block",
            F.explode(
                F.sequence(
                    F.floor((F.col("_day") - after) / block_days),
                    F.floor((F.col("_day") + before) / block_days),
                )
            ),
        )
        .withColumn("_core", F.col("_block") == F.floor(F.col("_day") / block_days))
    )
    return tagged.withColumns(build(Frames(keys))).where("_core").drop(*_TAGS)


def carried(
    df: DataFrame,
    back: dict[str, Column] | None = None,
    ahead: dict[str, Column] | None = None,
    *,
    series="series",
    date: str = "date",
    block_days: int = BLOCK_DAYS,
    rows: int | None = None,
) -> DataFrame:
    """The nearest non-NULL value of each expression, looking `back` or `ahead` from the row.

    The row's own value counts. Both directions share one shuffle and one hand-over table. `rows`,
    about the number of rows, lets the number of tasks follow it, so a task's memory stays the same;
    without it Spark's number of partitions holds.
    """
    keys = _keys(series)
    wanted = {**(back or {}), **(ahead or {})}
    tagged = _by_block(df, keys, date, block_days, rows).withColumns(
        {f"_v_{n}": v for n, v in wanted.items()}
    )

    def edge(name: str) -> Column:
        value = F.col(f"_v_{name}")
        pick = F.max_by if name in (back or {}) else F.min_by
        return pick(value, F.when(value.isNotNull(), F.col(date))).alias(f"_h_{name}")

    def nearest(name: str, column: str, keep: list[str], order: str, last: int) -> Column:
        along = F.col(order).asc() if name in (back or {}) else F.col(order).desc()
        frame = (
            Window.partitionBy(*keep).orderBy(along).rowsBetween(Window.unboundedPreceding, last)
        )
        return F.last(column, ignorenulls=True).over(frame)

    handed = (
        tagged.groupBy(*keys, "_block")
        .agg(*(edge(n) for n in wanted))
        .withColumns({f"_h_{n}": nearest(n, f"_h_{n}", keys, "_block", -1) for n in wanted})
    )
    inside = [*keys, "_block"]
    local = tagged.withColumns(
        {f"_l_{n}": nearest(n, f"_v_{n}", inside, date, Window.currentRow) for n in wanted}
    )
    out = local.join(handed, inside, "left").withColumns(
        {n: F.coalesce(f"_l_{n}", f"_h_{n}") for n in wanted}
    )
    return out.drop("_block", *(f"_{p}_{n}" for p in "vlh" for n in wanted))


def running_sum(
    df: DataFrame,
    values: dict[str, Column],
    *,
    series="series",
    date: str = "date",
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Running totals from the start of each series up to and including the row."""
    keys = _keys(series)
    tagged = _by_block(df, keys, date, block_days).withColumns(
        {f"_v_{n}": v for n, v in values.items()}
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        tagged.groupBy(*keys, "_block")
        .agg(*(F.sum(f"_v_{n}").alias(f"_h_{n}") for n in values))
        .withColumns({f"_h_{n}": F.sum(f"_h_{n}").over(earlier) for n in values})
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(date)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = tagged.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    zero = F.lit(0)
    out = local.join(offsets, [*keys, "_block"], "left").withColumns(
        {n: F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_h_{n}", zero) for n in values}
    )
    extra = [f"_{p}_{n}" for p in "vlh" for n in values]
    return out.drop("_block", *extra)
