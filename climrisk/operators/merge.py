"""Keyed merging of tables and the two-source daily merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.functions import geo
from climrisk.operators.calendar import densify


def latest_by_key(
    existing: DataFrame | None, new: DataFrame, keys, order: str = "downloaded_at"
) -> DataFrame:
    """One row per key: the latest by `order`, new rows winning a tie.

    The choice combines map-side, so repeated deliveries shrink before the shuffle.
    """
    rows = new.withColumn("_new", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("_new", F.lit(0)).unionByName(rows)
    rest = [c for c in new.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_new")))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*").select(*new.columns)


CELL = ["cell_x", "cell_y"]


def source_cells(
    territories: DataFrame, mesh: str = "power", lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Territories with the number and the centre of their source cell.

    Cells are joined by number, whole numbers counted as the source rounds: equal centres computed
    along different ways could differ in their last digit.
    """
    x, y = geo.cell_number(F.col(lon), F.col(lat), mesh)
    cx, cy = geo.cell_centre(F.col(lon), F.col(lat), mesh)
    return territories.withColumns({"cell_x": x, "cell_y": y, "cell_lon": cx, "cell_lat": cy})


def source_cell_merge(
    territories: DataFrame,
    coarse: DataFrame,
    rain: DataFrame,
    start,
    end,
    *,
    mesh: str = "power",
    series: str = "series",
    date: str = "date",
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """Calendar of every territory with its own rain and the coarse variables of its source cell.

    `coarse` has one row per (cell_x, cell_y, date); two make the job fail, as the source serves one
    series per cell. It is read once and cut to the cells that territories lie in, each of them once however
    many territories share it, before it meets their days; territories of one cell get equal values. A day
    that either source lacks stays NULL for that source, neither fills the other. Rows come back with
    cell_x, cell_y, NULL for a territory without a place.
    """
    placed = source_cells(territories, mesh, lon, lat).select(series, *CELL)
    cells = placed.select(*CELL).distinct()
    variables = [c for c in coarse.columns if c not in (*CELL, date)]
    one = coarse.join(cells, CELL, "left_semi").groupBy(*CELL, date).agg(F.count("*").alias("_rows"), *(F.max(v).alias(v) for v in variables))
    twice = F.raise_error(F.concat_ws(" ", F.lit("two rows for cell"), *CELL, F.lit("on"), date))
    one = one.withColumn("_rows", F.when(F.col("_rows") > 1, twice.cast("long")).otherwise(F.col("_rows"))).where(F.col("_rows") > 0).drop("_rows")
    dense = densify(rain, start, end, members=placed.select(series), series=series, date=date)
    return dense.join(placed, series).join(one, [*CELL, date], "left").select(series, *CELL, date, *[c for c in rain.columns if c not in (series, date)], *variables)


def two_source_merge(
    members: DataFrame,
    coarse: DataFrame,
    rain: DataFrame,
    start,
    end,
    *,
    series: str = "series",
    date: str = "date",
    coarse_key=("date",),
) -> DataFrame:
    """Calendar with the coarse variables of the cell and the rain of the district.

    A day either source lacks stays NULL for that source; neither fills the other.
    """
    dense = densify(rain, start, end, members=members, series=series, date=date)
    keyed = dense.join(members, series) if len(members.columns) > 1 else dense
    return keyed.join(coarse, list(coarse_key), "left")
