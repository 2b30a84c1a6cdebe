"""Polygons, grids and surfaces as relational jobs.

A polygon is a row (polygon, geometry) with geometry as parts > rings > points; ring 0 of a part
is its outline and later rings are holes. Most work runs on the edge table made from it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climrisk.functions import checks, geo
from climrisk.sources.tables import materialise

CELL = 0.05
SURFACE_MARGIN, SURFACE_SIDE = 0.03, 180
COINCIDENT = 1e-9
POINTS_PER_CHUNK = 512
FINE, MAX_EDGES = 16, 64


def edges(polygons: DataFrame, polygon: str = "polygon", geometry: str = "geometry") -> DataFrame:
    """One row per ring edge: polygon, part, ring, seq, x1, y1, x2, y2."""
    rings = polygons.select(polygon, F.posexplode(geometry).alias("part", "_p")).select(
        polygon, "part", F.posexplode("_p").alias("ring", "_r")
    )
    pair = lambda i: F.struct(
        i.alias("seq"),
        F.get("_r", i - 1)["lon"].alias("x1"),
        F.get("_r", i - 1)["lat"].alias("y1"),
        F.get("_r", i)["lon"].alias("x2"),
        F.get("_r", i)["lat"].alias("y2"),
    )
    # A lone vertex has no edge.
    steps = F.when(F.size("_r") > 1, F.sequence(F.lit(1), F.size("_r") - 1))
    return rings.select(
        polygon, "part", "ring", F.explode(F.transform(steps, pair)).alias("e")
    ).select(polygon, "part", "ring", "e.*")


def bounding_boxes(edge: DataFrame, polygon: str = "polygon") -> DataFrame:
    """Extent, centre and size in kilometres of every polygon."""
    return (
        edge.groupBy(polygon)
        .agg(
            F.min(F.least("x1", "x2")).alias("west"),
            F.max(F.greatest("x1", "x2")).alias("east"),
            F.min(F.least("y1", "y2")).alias("south"),
            F.max(F.greatest("y1", "y2")).alias("north"),
        )
        .withColumns(
            {
                "centre_lon": (F.col("west") + F.col("east")) / 2,
                "centre_lat": (F.col("south") + F.col("north")) / 2,
                "width_km": geo.width_km(*map(F.col, ("west", "east", "south", "north"))),
                "height_km": geo.height_km(F.col("south"), F.col("north")),
            }
        )
    )


def polygon_index(edge: DataFrame, step: float = CELL, polygon: str = "polygon") -> DataFrame:
    """Grid cells of every polygon: boundary cells with their edges, interior cells without.

    Coordinates are counted in cells, so grid lines are whole numbers. `corner` tells whether
    the lower right corner of the cell lies inside: the edges crossing the cell's lower line
    further right are counted by a running sum along the line. A point is then decided from its
    own cell's edges alone. Edges on a grid line belong to the cell on its left.
    """
    scaled = edge.select(
        polygon,
        *((F.col(c) / step).alias(c) for c in ("x1", "y1", "x2", "y2")),
    )
    ends = tuple(map(F.col, ("x1", "y1", "x2", "y2")))
    x1, y1, x2, y2 = ends
    rows = F.sequence(F.floor(F.least(y1, y2)), F.floor(F.greatest(y1, y2)))
    line = F.col("cy").cast("double")
    # Columns the edge can touch between this row's two lines, a cell to spare on either side:
    # a long slanted edge lists the cells along it, not its whole bounding box.
    at = lambda y: x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
    enters = at(F.greatest(F.least(y1, y2), line))
    leaves = at(F.least(F.greatest(y1, y2), line + 1))
    left = F.coalesce(F.least(enters, leaves), F.least(x1, x2))
    right = F.coalesce(F.greatest(enters, leaves), F.greatest(x1, x2))
    columns = F.sequence(
        F.greatest(F.ceil(left) - 2, F.ceil(F.least(x1, x2)) - 1),
        F.least(F.ceil(right), F.ceil(F.greatest(x1, x2)) - 1),
    )
    covered = scaled.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(columns))
    meets = (y1 <= line) != (y2 <= line)
    right_of = lambda column: geo.crossing_right_of(*ends, column.cast("double"), line)
    # The one cell whose left border the crossing has passed and whose right border it has not.
    here = right_of(F.col("cx")) & ~right_of(F.col("cx") + 1)
    cells = covered.groupBy(polygon, "cy", "cx").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"),
        F.count_if(meets & here).alias("_met"),
    )
    rightward = Window.partitionBy(polygon, "cy").orderBy(F.desc("cx"))
    strictly_right = rightward.rowsBetween(Window.unboundedPreceding, -1)
    boundary = cells.withColumns(
        {
            "corner": F.coalesce(F.sum("_met").over(strictly_right), F.lit(0)) % 2 == 1,
            "_next": F.lag("cx").over(rightward),
        }
    )
    gap = F.col("corner") & (F.col("_next") - F.col("cx") > 1)
    interior = boundary.where(gap).select(
        polygon,
        "cy",
        F.explode(F.sequence(F.col("cx") + 1, F.col("_next") - 1)).alias("cx"),
        F.lit(None).cast(boundary.schema["edges"].dataType).alias("edges"),
        F.lit(True).alias("corner"),
    )
    return boundary.select(polygon, "cy", "cx", "edges", "corner").unionByName(interior)


def _inside(px, py, cx, corner, cell_edges):
    """Parity of the path point -> right cell border -> lower right corner."""
    border = (cx + 1).cast("double")
    floor_line = F.floor(py).cast("double")

    def met(e):
        ends = e["x1"], e["y1"], e["x2"], e["y2"]
        x1, y1, x2, y2 = ends
        flat = (
            ((y1 <= py) != (y2 <= py))
            & geo.crossing_right_of(*ends, px, py)
            & ~geo.crossing_right_of(*ends, border, py)
        )
        upright = (
            ((x1 <= border) != (x2 <= border))
            & geo.crossing_below(*ends, border, py)
            & ~geo.crossing_below(*ends, border, floor_line)
        )
        return flat.cast("int") + upright.cast("int")

    crossings = F.aggregate(cell_edges, F.lit(0), lambda n, e: n + met(e))
    return (F.coalesce(crossings, F.lit(0)) + corner.cast("int")) % 2 == 1


def _holds(px, py, cx):
    """Test of one candidate cell entry for the point of the row."""
    return lambda entry: _inside(px, py, cx, entry["corner"], entry["edges"])


def refine(
    index: DataFrame, max_edges: int = MAX_EDGES, polygon: str = "polygon"
) -> tuple[DataFrame, DataFrame]:
    """Splits the index into ordinary cells and crowded ones cut into FINE x FINE smaller cells.

    Crowded means more than `max_edges` edges of all polygons together. A small cell gets the
    edges that can touch it, and its corner bit is decided from the large cell as for any point.
    FINE is a power of two, so scaling changes no digit and no answer.
    """
    checks.window_at_least(max_edges)
    cell = ["cx", "cy"]
    crowded = (
        index.groupBy(*cell)
        .agg(F.sum(F.coalesce(F.size("edges"), F.lit(0))).alias("_load"))
        .where(F.col("_load") > max_edges)
        .select(*cell)
    )
    steps = F.sequence(F.lit(0), F.lit(FINE - 1))
    small = (
        index.join(crowded, cell, "left_semi")
        .withColumn("_i", F.explode(steps))
        .withColumn("_j", F.explode(steps))
    )
    corner = _inside(
        F.col("cx") + (F.col("_i") + 1) / FINE,
        F.col("cy") + F.col("_j") / FINE,
        F.col("cx"),
        F.col("corner"),
        F.col("edges"),
    )
    x, y = F.col("cx") * FINE + F.col("_i"), F.col("cy") * FINE + F.col("_j")
    larger = lambda e: F.struct(
        *((e[n] * FINE).alias(n) for n in ("x1", "y1", "x2", "y2"))
    )
    touches = lambda e: (
        (F.ceil(F.least(e["x1"], e["x2"])) - 1 <= x)
        & (F.ceil(F.greatest(e["x1"], e["x2"])) - 1 >= x)
        & (F.floor(F.least(e["y1"], e["y2"])) <= y)
        & (F.floor(F.greatest(e["y1"], e["y2"])) >= y)
    )
    # New names first: inside a lambda a name would mean the new column of the same select.
    fine = small.select(
        polygon,
        y.alias("_cy"),
        x.alias("_cx"),
        F.filter(F.transform("edges", larger), touches).alias("_edges"),
        corner.alias("_corner"),
    ).where(F.col("_corner") | (F.size("_edges") > 0))
    fine = fine.withColumnsRenamed({f"_{c}": c for c in ("cy", "cx", "edges", "corner")})
    return index.join(crowded, cell, "left_anti"), fine


def locate_points(
    points: DataFrame,
    index: DataFrame,
    step: float = CELL,
    *,
    fine: DataFrame | None = None,
    lon: str = "lon",
    lat: str = "lat",
    polygon: str = "polygon",
    salts: int = 1,
) -> DataFrame:
    """Points with the polygon holding them; NULL outside all, one row each when several do.

    One equi join on the cell, left open, then a test on the row itself: points are never
    regrouped. `salts` repeats the index to split a cell holding very many points. With the two
    tables of `refine`, points of crowded cells are decided in the small ones.
    """
    checks.window_at_least(salts)
    salt = F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int")
    levels = [(index, 1)] + ([(fine, FINE)] if fine is not None else [])
    found, hits = points, []
    for number, (cells, scale) in enumerate(levels):
        u, v, cx, cy, inside = (f"_{c}{number}" for c in ("u", "v", "cx", "cy", "in"))
        found = found.withColumns(
            {u: F.col(lon) / step * scale, v: F.col(lat) / step * scale}
        ).withColumns({cx: F.floor(u), cy: F.floor(v)})
        candidates = cells.groupBy(F.col("cx").alias(cx), F.col("cy").alias(cy)).agg(
            F.collect_list(F.struct(polygon, "corner", "edges")).alias(inside)
        )
        keys = [cx, cy]
        if salts > 1:
            candidates = candidates.withColumn(
                "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
            )
            found = found.withColumn("_salt", salt)
            keys.append("_salt")
        found = found.join(candidates, keys, "left")
        none = F.array().cast(candidates.schema[inside].dataType)
        holding = F.filter(F.coalesce(inside, none), _holds(*map(F.col, (u, v, cx))))
        hits.append(F.transform(holding, lambda c: c[polygon]))
    return found.withColumn("_hits", F.concat(*hits)).select(
        *points.columns, F.explode_outer("_hits").alias(polygon)
    )


def coverage(index: DataFrame, step: float = CELL, polygon: str = "polygon") -> DataFrame:
    """Cells whose centre lies inside a polygon: the weights of a zonal mean."""
    cx, cy = F.col("cx") + 0.5, F.col("cy") + 0.5
    inside = _inside(cx, cy, F.col("cx"), F.col("corner"), F.col("edges"))
    return index.where(inside).select(polygon, "cx", "cy")


def zonal_mean(
    grid: DataFrame,
    covered: DataFrame,
    keys=("date",),
    *,
    value: str = "value",
    polygon: str = "polygon",
) -> DataFrame:
    """Mean of a gridded variable over each polygon; cells without a value do not count."""
    return (
        grid.join(covered, ["cx", "cy"])
        .groupBy(polygon, *keys)
        .agg(F.avg(value).alias("mean"), F.count(value).alias("cells"))
    )


def cells_touched(
    edge: DataFrame,
    step: float = CELL,
    spacing_m: float = 400.0,
    decimals=(None, 3, 2),
    polygon: str = "polygon",
) -> DataFrame:
    """Distinct cells along each boundary, walked in steps of at most `spacing_m`, per variant.

    A variant rounds the vertices to a number of decimals; None keeps them. Coarsening that
    leaves the count unchanged leaves the service's polygon mean unchanged too.
    """
    ends = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    variants = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(-1 if d is None else d).alias("decimals"),
                    *((v if d is None else F.round(v, d)).alias(c) for c, v in ends.items()),
                )
                for d in decimals
            )
        )
    )
    walked = edge.select(polygon, variants.alias("v")).select(polygon, "v.*")
    length = geo.haversine_m(*map(F.col, ("x1", "y1", "x2", "y2")))
    walked = walked.withColumn(
        "_n", F.greatest(F.lit(1), F.ceil(length / spacing_m))
    ).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    share = F.col("_i") / F.col("_n")
    x = F.col("x1") + share * (F.col("x2") - F.col("x1"))
    y = F.col("y1") + share * (F.col("y2") - F.col("y1"))
    return (
        walked.select(
            polygon,
            "decimals",
            F.floor((x + 180) / step).alias("cx"),
            F.floor((y + 90) / step).alias("cy"),
        )
        .distinct()
        .groupBy(polygon)
        .agg(
            *(
                F.count_if(F.col("decimals") == (-1 if d is None else d)).alias(
                    "original" if d is None else f"rounded_{d}"
                )
                for d in decimals
            )
        )
    )


def coarsening_sweep(edge: DataFrame, decimals=(4, 3, 2), polygon: str = "polygon") -> DataFrame:
    """Worst vertex count, text weight and area change over all polygons, per rounding."""
    ends = ("x1", "y1", "x2", "y2")
    swept = edge.select(
        polygon,
        *ends,
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(d).alias("decimals"),
                        *(F.round(c, d).alias(f"_{c}") for c in ends),
                    )
                    for d in decimals
                )
            )
        ).alias("r"),
    ).select(polygon, *ends, "r.*")
    moved = F.struct("_x1", "_y1") != F.struct("_x2", "_y2")
    shoelace = lambda a, b, c, d: F.sum(a * d - c * b) / 2
    per = swept.groupBy("decimals", polygon).agg(
        F.count_if(moved).alias("vertices"),
        (F.count_if(moved) * (2 * F.col("decimals") + 8)).alias("weight"),
        F.abs(shoelace(*map(F.col, ends))).alias("_before"),
        F.abs(shoelace(*(F.col(f"_{c}") for c in ends))).alias("_after"),
    )
    change = F.abs(F.col("_before") - F.col("_after")) / F.col("_before") * 100
    return per.groupBy("decimals").agg(
        F.max("vertices").alias("worst_vertices"),
        F.max("weight").alias("worst_weight"),
        F.max(change).alias("worst_area_change_pct"),
    )


def interior_points(edge: DataFrame, polygon: str = "polygon") -> DataFrame:
    """A point inside each polygon: middle of the widest inner stretch at a part's mid-latitude.

    Unlike a centroid it stays inside concave shapes, outside holes and on one of the parts.
    """
    mid = edge.groupBy(polygon, "part").agg(
        ((F.min(F.least("y1", "y2")) + F.max(F.greatest("y1", "y2"))) / 2).alias("lat")
    )
    y1, y2, lat = F.col("y1"), F.col("y2"), F.col("lat")
    crossing = F.col("x1") + (lat - y1) * (F.col("x2") - F.col("x1")) / F.nullif(
        y2 - y1, F.lit(0.0)
    )
    along = Window.partitionBy(polygon, "part").orderBy("x")
    # Widths equal to a tenth of a millimetre are a tie, which goes west.
    width = F.round(F.col("_to") - F.col("x"), 9)
    widest = F.struct(width, -F.col("x"), -F.col("part"))
    return (
        edge.join(mid, [polygon, "part"])
        .where((y1 <= lat) != (y2 <= lat))
        .select(polygon, "part", "lat", crossing.alias("x"))
        .withColumns({"_i": F.row_number().over(along), "_to": F.lead("x").over(along)})
        .where((F.col("_i") % 2 == 1) & F.col("_to").isNotNull())
        .groupBy(polygon)
        .agg(
            F.max_by((F.col("x") + F.col("_to")) / 2, widest).alias("lon"),
            F.max_by("lat", widest).alias("lat"),
        )
    )


def areas_km2(edge: DataFrame, polygon: str = "polygon") -> DataFrame:
    """Area in the national projection; holes count against it."""
    ax, ay = geo.to_metres(F.col("x1"), F.col("y1"))
    bx, by = geo.to_metres(F.col("x2"), F.col("y2"))
    flat = edge.select(
        polygon, "part", "ring", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")
    )
    ring = flat.groupBy(polygon, "part", "ring").agg(
        (
            F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2
        ).alias("_m2")
    )
    signed = F.when(F.col("ring") == 0, F.col("_m2")).otherwise(-F.col("_m2"))
    return ring.groupBy(polygon).agg((F.sum(signed) / 1e6).alias("area_km2"))


def area_coherence(
    stored: DataFrame,
    measured: DataFrame,
    parent: str,
    *,
    polygon: str = "polygon",
    own_limit_pct: float = 0.1,
    parent_limit_pct: float = 2.0,
) -> DataFrame:
    """Stored against recomputed area per polygon, and the sum per parent against its own area.

    `stored` carries polygon, parent, stored_km2 and parent_km2.
    """
    both = stored.join(measured, polygon)
    off = lambda a, b: F.abs(a - b) / b * 100
    per = both.withColumn("_off", off(F.col("stored_km2"), F.col("area_km2")))
    return per.groupBy(parent).agg(
        F.count("*").alias("polygons"),
        F.max("_off").alias("worst_own_pct"),
        F.count_if(F.col("_off") > own_limit_pct).alias("own_outside"),
        off(F.sum("area_km2"), F.max("parent_km2")).alias("sum_vs_parent_pct"),
        (off(F.sum("area_km2"), F.max("parent_km2")) > parent_limit_pct).alias("parent_outside"),
    )


def ring_validity(edge: DataFrame, polygon: str = "polygon") -> DataFrame:
    """Closure, vertex count, zero area and self-contact of every ring.

    Edges that aren't neighbours may neither cross nor touch, at a point or along a line; a
    neighbour may not run back along the edge before it. Repeated vertices are no fault.

    Edges are filed in grids whose cell is the power of two just above their own length, so a
    cell only holds edges of its size, at most four cells each. An edge looks for partners in its
    own grid and in the coarser ones of its ring. Fine detail next to long edges stays cheap.
    """
    ring = [polygon, "part", "ring"]
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.greatest(F.abs(dx), F.abs(dy), F.lit(1e-12))
    along = Window.partitionBy(*ring).orderBy("seq")
    sized = (
        edge.where((dx != 0) | (dy != 0))
        .withColumn("_level", F.ceil(F.log2(size)).cast("int"))
        .withColumn("seq", F.row_number().over(along))
    )
    whole = edge.groupBy(*ring).agg(
        (F.count("*") + 1).alias("vertices"),
        F.min_by(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), "seq").alias("_a"),
        F.max_by(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")), "seq").alias("_z"),
        (F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("_area"),
    )
    lengths = sized.groupBy(*ring).agg(
        F.max("seq").alias("_last"), F.array_sort(F.collect_set("_level")).alias("_levels")
    )
    facts = whole.join(lengths, ring, "left")

    def filed(df: DataFrame, grid: str) -> DataFrame:
        cell = F.pow(F.lit(2.0), F.col(grid))
        span = lambda a, b: F.explode(
            F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
        )
        return df.withColumn("_gx", span("x1", "x2")).withColumn("_gy", span("y1", "y2"))

    cell = [*ring, "_grid", "_gx", "_gy"]
    seekers = filed(
        sized.join(facts.select(*ring, "_levels", "_last"), ring).withColumn(
            "_grid", F.explode(F.filter("_levels", lambda g: g >= F.col("_level")))
        ),
        "_grid",
    )
    other = filed(sized.withColumn("_grid", F.col("_level")), "_grid").select(
        *cell, *(F.col(c).alias(f"o_{c}") for c in ("seq", "x1", "y1", "x2", "y2"))
    )
    side = lambda ax, ay, bx, by, px, py: F.signum(
        (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    )
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "o_x1", "o_y1", "o_x2", "o_y2")}
    mine = (c["x1"], c["y1"], c["x2"], c["y2"])
    theirs = (c["o_x1"], c["o_y1"], c["o_x2"], c["o_y2"])
    apart = side(*mine, *theirs[:2]) * side(*mine, *theirs[2:])
    across = side(*theirs, *mine[:2]) * side(*theirs, *mine[2:])
    step = F.abs(F.col("o_seq") - F.col("seq"))
    neighbours = (step <= 1) | (step == F.col("_last") - 1)
    back = (
        (step > 0)
        & (side(*mine, *theirs[:2]) == 0)
        & (side(*mine, *theirs[2:]) == 0)
        & (dx * (c["o_x2"] - c["o_x1"]) + dy * (c["o_y2"] - c["o_y1"]) < 0)
    )
    meet = lambda a, b: (
        (F.greatest(c[a], c[b]) >= F.least(c[f"o_{a}"], c[f"o_{b}"]))
        & (F.greatest(c[f"o_{a}"], c[f"o_{b}"]) >= F.least(c[a], c[b]))
    )
    crossed = (
        seekers.join(other, cell)
        .where(
            F.when(neighbours, back)
            .otherwise((apart <= 0) & (across <= 0) & meet("x1", "x2") & meet("y1", "y2"))
        )
        .select(*ring)
        .distinct()
        .withColumn("_x", F.lit(True))
    )
    return facts.join(crossed, ring, "left").select(
        *ring,
        "vertices",
        (F.col("_a") == F.col("_z")).alias("closed"),
        (F.col("_area") == 0).alias("zero_area"),
        F.coalesce("_x", F.lit(False)).alias("self_crossing"),
        (
            (F.col("_a") == F.col("_z"))
            & (F.col("vertices") >= 4)
            & (F.col("_area") > 0)
            & F.col("_x").isNull()
        ).alias("valid"),
    )


def _contacts(edge: DataFrame, polygon: str) -> DataFrame:
    """Where edges of different rings of a polygon meet, told from both sides.

    polygon, part, ring, seq, o_part, o_ring, kind and at: `cross` for a proper crossing, `line` for a
    common stretch, `touch` for a common point, which lies at the share `at` of the edge. Edges are filed
    in grids of their own size as in `ring_validity`, here by polygon.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.greatest(F.abs(dx), F.abs(dy))
    sized = edge.where(size > 0).withColumn("_level", F.ceil(F.log2(size)).cast("int"))
    levels_of = sized.groupBy(polygon).agg(F.collect_set("_level").alias("_levels"))

    def filed(df: DataFrame) -> DataFrame:
        cell = F.pow(F.lit(2.0), F.col("_grid"))
        span = lambda a, b: F.explode(
            F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
        )
        return df.withColumn("_gx", span("x1", "x2")).withColumn("_gy", span("y1", "y2"))

    coarser = F.explode(F.filter("_levels", lambda g: g >= F.col("_level")))
    seekers = filed(sized.join(levels_of, polygon).withColumn("_grid", coarser))
    cell = [polygon, "_grid", "_gx", "_gy"]
    held = ("part", "ring", "seq", "x1", "y1", "x2", "y2")
    others = filed(sized.withColumn("_grid", F.col("_level"))).select(*cell, *(F.col(c).alias(f"o_{c}") for c in held))
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "o_x1", "o_y1", "o_x2", "o_y2")}
    mine = (c["x1"], c["y1"], c["x2"], c["y2"])
    theirs = (c["o_x1"], c["o_y1"], c["o_x2"], c["o_y2"])
    side = lambda ax, ay, bx, by, px, py: F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    share = lambda ax, ay, bx, by, px, py: (
        ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    )
    s = [side(*mine, *theirs[:2]), side(*mine, *theirs[2:]), side(*theirs, *mine[:2]), side(*theirs, *mine[2:])]
    meet = lambda a, b: (
        (F.greatest(c[a], c[b]) >= F.least(c[f"o_{a}"], c[f"o_{b}"]))
        & (F.greatest(c[f"o_{a}"], c[f"o_{b}"]) >= F.least(c[a], c[b]))
    )
    pairs = (
        seekers.join(others, cell)
        .where((F.col("part") != F.col("o_part")) | (F.col("ring") != F.col("o_ring")))
        .where(meet("x1", "x2") & meet("y1", "y2") & (s[0] * s[1] <= 0) & (s[2] * s[3] <= 0))
    )
    # Ends of either edge that lie on the other one, as shares of this edge and of the other.
    along = [share(*mine, *theirs[:2]), share(*mine, *theirs[2:])]
    across = [share(*theirs, *mine[:2]), share(*theirs, *mine[2:])]
    on = lambda zero, t: (zero == 0) & t.between(0, 1)
    ends = [(on(s[0], along[0]), along[0], F.lit(0.0)), (on(s[1], along[1]), along[1], F.lit(1.0)), (on(s[2], across[0]), F.lit(0.0), across[0]), (on(s[3], across[1]), F.lit(1.0), across[1])]
    points = F.array_compact(F.array(*(F.when(held_, F.struct(a.alias("at"), b.alias("o_at"))) for held_, a, b in ends)))
    low, high = (f(F.transform("_points", lambda p: p["at"])) for f in (F.array_min, F.array_max))
    flat = (s[0] == 0) & (s[1] == 0)
    kind = F.when(F.size("_points") == 0, "cross").when(flat & (high > low), "line").otherwise("touch")
    met = pairs.withColumn("_points", points).withColumn("kind", kind).where(~(flat & (F.size("_points") == 0)))
    met = met.withColumn("_p", F.explode_outer("_points"))
    one = met.select(polygon, "part", "ring", "seq", "o_part", "o_ring", "kind", F.col("_p.at").alias("at"))
    back = met.select(
        polygon, F.col("o_part").alias("part"), F.col("o_ring").alias("ring"), F.col("o_seq").alias("seq"),
        F.col("part").alias("o_part"), F.col("ring").alias("o_ring"), "kind", F.col("_p.o_at").alias("at"),
    )
    return one.unionByName(back).distinct()


def polygon_validity(edge: DataFrame, step: float = CELL, polygon: str = "polygon") -> DataFrame:
    """polygon, reasons, valid: how the rings of every polygon lie to one another.

    Reasons, in order of the alphabet: `hole outside shell`, `nested holes`, `nested parts` (a part
    inside another one, but not inside a hole of it), `parts overlap`, `parts share a line`, `ring` (see
    `ring_validity`), `rings cross` and `rings share a line` (within a part). Rings may touch in single
    points. Not told: an interior that is cut in two by touching rings.

    Rings that don't cross properly can only change sides where they touch. So a ring is asked for
    at one point, and between the touches of every edge that has some: all of a ring's points lie
    inside another ring, or none does, or the two cross. Points meet rings in the cells of
    `polygon_index`, edges meet edges in grids of their size; no ring is compared with all others.
    """
    ring = [polygon, "part", "ring"]
    contacts = materialise(_contacts(edge, polygon))
    touched = contacts.where("kind = 'touch'").groupBy(*ring, "seq").agg(F.collect_set("at").alias("_at"))
    sound = edge.where("x1 <> x2 OR y1 <> y2")
    first = sound.groupBy(*ring).agg(F.min("seq").alias("_first"))
    asked = sound.join(first, ring).join(touched, [*ring, "seq"], "left").where((F.col("seq") == F.col("_first")) | F.col("_at").isNotNull())
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("_at", F.array().cast("array<double>")))))
    middles = F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), lambda i: (F.element_at("_cuts", i) + F.element_at("_cuts", i + 1)) / 2)
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("_m")
    points = asked.withColumn("_cuts", cuts).withColumn("_m", F.explode(middles)).select(*ring, at("x1", "x2").alias("lon"), at("y1", "y2").alias("lat"))
    index = polygon_index(edge.withColumn("_other", F.struct(F.col(polygon).alias("polygon"), "part", "ring")), step, "_other")
    found = locate_points(points, index, step, polygon="_other").where(F.col("_other.polygon") == F.col(polygon))
    hits = found.groupBy(*ring, F.col("_other.part").alias("o_part"), F.col("_other.ring").alias("o_ring")).agg(F.count("*").alias("_hits"))
    hits = hits.where("part <> o_part OR ring <> o_ring").join(points.groupBy(*ring).agg(F.count("*").alias("_all")), ring)
    pair = [*ring, "o_part", "o_ring"]
    met = contacts.groupBy(*pair).agg(F.max(F.col("kind") == "cross").alias("_cross"), F.max(F.col("kind") == "line").alias("_line"))
    told = met.join(hits, pair, "full").select(
        *pair,
        # Points on a common line tell no side.
        (F.coalesce("_cross", F.lit(False)) | (~F.coalesce("_line", F.lit(False)) & F.coalesce(F.col("_hits") < F.col("_all"), F.lit(False)))).alias("cross"),
        F.coalesce("_line", F.lit(False)).alias("line"),
        F.coalesce(F.col("_hits") == F.col("_all"), F.lit(False)).alias("inside"),
    )
    told = materialise(told)
    clean = ~F.col("cross") & ~F.col("line")
    same = F.col("part") == F.col("o_part")
    faults = [
        told.where(same & F.col("cross")).select(polygon, F.lit("rings cross").alias("reason")),
        told.where(same & F.col("line")).select(polygon, F.lit("rings share a line").alias("reason")),
        told.where(~same & F.col("cross")).select(polygon, F.lit("parts overlap").alias("reason")),
        told.where(~same & F.col("line")).select(polygon, F.lit("parts share a line").alias("reason")),
        told.where(same & clean & F.col("inside") & (F.col("ring") > 0) & (F.col("o_ring") > 0)).select(polygon, F.lit("nested holes").alias("reason")),
    ]
    # A hole has to lie in its shell; a pair that crosses or shares a line has its reason already.
    to_shell = told.where(same & (F.col("o_ring") == 0) & (F.col("inside") | ~clean)).select(*ring)
    holes = edge.where("ring > 0").select(*ring).distinct()
    faults.append(holes.join(to_shell, ring, "left_anti").select(polygon, F.lit("hole outside shell").alias("reason")))
    shells = told.where(~same & (F.col("ring") == 0) & clean & F.col("inside"))
    met_already = told.where(~same & ~clean).select(polygon, "part", "o_part")
    held = shells.where("o_ring > 0").select(polygon, "part", "o_part").unionByName(met_already)
    nested = shells.where("o_ring = 0").select(polygon, "part", "o_part").join(held, [polygon, "part", "o_part"], "left_anti")
    faults.append(nested.select(polygon, F.lit("nested parts").alias("reason")))
    faults.append(ring_validity(edge, polygon).where(~F.col("valid")).select(polygon, F.lit("ring").alias("reason")))
    every = reduce(DataFrame.unionByName, faults)
    reasons = every.groupBy(polygon).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    none = F.array().cast("array<string>")
    out = edge.select(polygon).distinct().join(reasons, polygon, "left").withColumn("reasons", F.coalesce("reasons", none))
    return out.withColumn("valid", F.size("reasons") == 0)


def reference_system_audit(
    polygons: DataFrame, expected: int = 4326, *, srid: str = "srid", geometry: str = "geometry"
) -> DataFrame:
    """Rows per declared reference system, and those outside its coordinate range."""
    outside = F.exists(
        F.flatten(F.flatten(geometry)),
        lambda p: (F.abs(p["lon"]) > 180) | (F.abs(p["lat"]) > 90),
    )
    return polygons.groupBy(srid).agg(
        F.count("*").alias("polygons"),
        F.count_if(F.size(geometry) == 0).alias("empty"),
        F.count_if(outside).alias("outside_range"),
        F.first(F.col(srid) == expected).alias("as_declared"),
    )


def cell_sharing(
    points: DataFrame, mesh: str, *, member: str = "polygon", lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Members per source cell. A source cannot tell members of one cell apart."""
    cx, cy = geo.cell_number(F.col(lon), F.col(lat), mesh)
    return points.groupBy(cx.alias("cx"), cy.alias("cy")).agg(
        F.count(member).alias("members"),
        F.min(member).alias("first_member"),
        F.max(member).alias("last_member"),
        (F.count(member) > 1).alias("shared"),
    )


_STRIP = T.StructType(
    [
        T.StructField("wv", T.ArrayType(T.DoubleType())),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("hit", T.ArrayType(T.IntegerType())),
    ]
)


def _weigh_strip(side: int, power: float):
    """Weighted sums of one chunk of points for all cells of one grid row."""

    @F.pandas_udf(_STRIP)
    def weigh(
        lat: pd.Series,
        west: pd.Series,
        step: pd.Series,
        ys: pd.Series,
        xs: pd.Series,
        vs: pd.Series,
    ) -> pd.DataFrame:
        out = {"wv": [], "w": [], "hit": []}
        for y, x0, dx, py, px, pv in zip(lat, west, step, ys, xs, vs):
            x = x0 + np.arange(side)[:, None] * dx
            d2 = (y - np.asarray(py)[None, :]) ** 2 + (x - np.asarray(px)[None, :]) ** 2
            on = d2 < COINCIDENT
            weight = np.where(on, 0.0, 1 / np.maximum(d2, COINCIDENT) ** (power / 2))
            out["wv"].append(weight @ np.asarray(pv))
            out["w"].append(weight.sum(axis=1))
            out["hit"].append(np.where(on.any(axis=1), on.argmax(axis=1), -1).astype("int32"))
        return pd.DataFrame(out)

    return weigh


def idw_surface(
    points: DataFrame,
    power: float = 2.0,
    side: int = SURFACE_SIDE,
    margin: float = SURFACE_MARGIN,
    *,
    value: str = "value",
    order: str = "polygon",
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """Inverse-distance surface over the points' extent, rows north to south.

    Points without a value take no part. A cell on a point takes the first such point's exact
    value. Points travel in hashed chunks; each (grid row, chunk) pair is one unit of work that
    hands on two sums per cell, so cell-point pairs never become rows.
    """
    if not 1 <= power <= 4:
        raise ValueError(f"the exponent must lie between 1 and 4, got {power}")
    checks.window_at_least(side, 2)
    known = points.where(F.col(value).isNotNull())
    facts = known.agg(
        F.greatest(F.ceil(F.count("*") / POINTS_PER_CHUNK), F.lit(1)).alias("chunks"),
        (F.max(lat) + margin).alias("north"),
        (F.min(lat) - margin).alias("south"),
        (F.max(lon) + margin).alias("east"),
        (F.min(lon) - margin).alias("west"),
    )
    extent = facts.select(F.struct(*facts.columns)).scalar()
    f = F.col("_f")
    point = F.struct(
        F.col(order).alias("o"),
        F.col(lat).alias("y"),
        F.col(lon).alias("x"),
        F.col(value).cast("double").alias("v"),
    )
    chunked = (
        known.withColumn("_chunk", F.pmod(F.xxhash64(order), extent["chunks"]))
        .groupBy("_chunk")
        .agg(F.sort_array(F.collect_list(point)).alias("_points"))
    )
    strips = (
        points.sparkSession.range(side)
        .select(F.col("id").cast("int").alias("row"), extent.alias("_f"))
        .select(
            "row",
            F.explode(F.sequence(F.lit(0).cast("bigint"), f["chunks"] - 1)).alias("_chunk"),
            (f["north"] - F.col("row") * ((f["north"] - f["south"]) / (side - 1))).alias("lat"),
            f["west"].alias("_west"),
            ((f["east"] - f["west"]) / (side - 1)).alias("_step"),
        )
    )
    part = lambda n: F.transform("_points", lambda p: p[n])
    sums = _weigh_strip(side, power)("lat", "_west", "_step", part("y"), part("x"), part("v"))
    cells = (
        strips.join(chunked, "_chunk")
        .withColumn("_s", sums)
        .select(
            "row",
            "lat",
            "_west",
            "_step",
            "_points",
            F.posexplode(F.arrays_zip("_s.wv", "_s.w", "_s.hit")).alias("col", "_c"),
        )
    )
    hit = F.get("_points", F.when(F.col("_c.hit") >= 0, F.col("_c.hit")))
    return (
        cells.select(
            "row",
            "col",
            "lat",
            (F.col("_west") + F.col("col") * F.col("_step")).alias("lon"),
            F.col("_c.wv").alias("wv"),
            F.col("_c.w").alias("w"),
            hit["v"].alias("hit"),
            hit["o"].alias("hit_order"),
        )
        .groupBy("row", "col", "lat", "lon")
        .agg(
            F.coalesce(
                F.min_by("hit", "hit_order"), F.sum("wv") / F.nullif(F.sum("w"), F.lit(0.0))
            ).alias("value")
        )
    )
