"""Grid, polygon and surface queries on the supplier polygons and the event detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from climrisk.functions import geo
from climrisk.operators import spatial
from climrisk.plans import adapters as a
from climrisk.plans.registry import query, rounded


def _edges(spark, sf):
    return spatial.edges(a.polygons(spark, sf))


@query(
    "cell_center",
    f"""WITH {a.DETECTIONS_SQL} SELECT round_even(lon / 0.625e0, 0) * 0.625e0 AS cell_lon,
      round_even(lat / 0.5e0, 0) * 0.5e0 AS cell_lat, count(*) AS points FROM detections
    GROUP BY 1, 2""",
)
def cell_center(spark, sf):
    cx, cy = geo.cell_centre(F.col("lon"), F.col("lat"))
    return a.detections(spark, sf).groupBy(cx.alias("cell_lon"), cy.alias("cell_lat")).agg(
        F.count("*").alias("points")
    )


@query(
    "cell_index",
    f"""WITH {a.DETECTIONS_SQL}
    SELECT 'power' AS mesh, CAST(round_even((lon + 180) / 0.625e0, 0) AS INTEGER) AS cx,
      CAST(round_even((lat + 90) / 0.5e0, 0) AS INTEGER) AS cy, count(*) AS points
    FROM detections GROUP BY 1, 2, 3
    UNION ALL SELECT 'chirps', CAST(floor((lon + 180) / 0.05e0) AS INTEGER),
      CAST(floor((lat + 90) / 0.05e0) AS INTEGER), count(*) FROM detections GROUP BY 1, 2, 3
    UNION ALL SELECT 'era5-land', CAST(round_even((lon + 180) / 0.1e0, 0) AS INTEGER),
      CAST(round_even((lat + 90) / 0.1e0, 0) AS INTEGER), count(*) FROM detections
      GROUP BY 1, 2, 3""",
)
def cell_index(spark, sf):
    meshes = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(m).alias("mesh"),
                    geo.cell_number(F.col("lon"), F.col("lat"), m)[0].alias("cx"),
                    geo.cell_number(F.col("lon"), F.col("lat"), m)[1].alias("cy"),
                )
                for m in ("power", "chirps", "era5-land")
            )
        )
    )
    points = a.detections(spark, sf).select(meshes.alias("m"))
    return points.groupBy("m.mesh", "m.cx", "m.cy").agg(F.count("*").alias("points"))


INTERIOR = f"""{a.EDGES_SQL}, mid AS (
      SELECT polygon, part, (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS lat FROM edges
      GROUP BY 1, 2), hits AS (
      SELECT e.polygon, e.part, lat, x1 + (lat - y1) * (x2 - x1) / (y2 - y1) AS x
      FROM edges e JOIN mid ON mid.polygon = e.polygon AND mid.part = e.part
      WHERE (y1 <= lat) <> (y2 <= lat)),
    gaps AS (SELECT *, row_number() OVER s AS i, lead(x) OVER s AS hi FROM hits
      WINDOW s AS (PARTITION BY polygon, part ORDER BY x)),
    inner_points AS (
      SELECT polygon, lat, (x + hi) / 2 AS lon FROM gaps WHERE i % 2 = 1 AND hi IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY polygon
        ORDER BY round(hi - x, 9) DESC, x, part) = 1)"""


@query(
    "interior_point",
    f"WITH {INTERIOR} SELECT polygon, round(lon, 6) AS lon, round(lat, 6) AS lat FROM inner_points",
)
def interior_point(spark, sf):
    return rounded(spatial.interior_points(_edges(spark, sf)), 6, "lon", "lat")


@query(
    "interior_check",
    f"""WITH {INTERIOR} SELECT count(*) AS polygons, count(*) AS inside_own FROM inner_points""",
)
def interior_check(spark, sf):
    edge = _edges(spark, sf)
    points = spatial.interior_points(edge).withColumnRenamed("polygon", "own")
    found = spatial.locate_points(points, spatial.polygon_index(edge))
    return found.agg(
        F.count("*").alias("polygons"),
        F.count_if(F.col("own").eqNullSafe(F.col("polygon"))).alias("inside_own"),
    )


@query(
    "cell_sharing",
    f"""WITH {INTERIOR}, c AS (SELECT polygon,
        CAST(round_even((lon + 180) / 0.1e0, 0) AS INTEGER) AS cx,
        CAST(round_even((lat + 90) / 0.1e0, 0) AS INTEGER) AS cy FROM inner_points)
    SELECT cx, cy, count(*) AS members, min(polygon) AS first_member, max(polygon) AS last_member,
      count(*) > 1 AS shared FROM c GROUP BY 1, 2""",
)
def cell_sharing(spark, sf):
    return spatial.cell_sharing(spatial.interior_points(_edges(spark, sf)), "era5-land")


@query(
    "bbox_center",
    f"""WITH {a.EDGES_SQL} SELECT polygon, min(least(x1, x2)) AS west,
      max(greatest(x1, x2)) AS east, min(least(y1, y2)) AS south, max(greatest(y1, y2)) AS north,
      round((min(least(x1, x2)) + max(greatest(x1, x2))) / 2, 6) AS centre_lon,
      round((min(least(y1, y2)) + max(greatest(y1, y2))) / 2, 6) AS centre_lat
    FROM edges GROUP BY 1""",
)
def bbox_center(spark, sf):
    boxes = spatial.bounding_boxes(_edges(spark, sf)).drop("width_km", "height_km")
    return rounded(boxes, 6, "centre_lon", "centre_lat")


AREA = """proj AS (
      SELECT *, radians(y1) AS p1, radians(x1 + 84) AS l1, radians(y2) AS p2,
        radians(x2 + 84) AS l2 FROM edges),
    conf AS (
      SELECT *, sinh(atanh(sin(p1)) - E * atanh(E * sin(p1))) AS t1,
        sinh(atanh(sin(p2)) - E * atanh(E * sin(p2))) AS t2 FROM proj),
    xe AS (
      SELECT *, atan2(t1, cos(l1)) AS xi1, atanh(sin(l1) / sqrt(1 + t1 * t1)) AS et1,
        atan2(t2, cos(l2)) AS xi2, atanh(sin(l2) / sqrt(1 + t2 * t2)) AS et2 FROM conf),
    metres AS (
      SELECT polygon, part, ring, K * (et1 + EAST1) + 500000 AS ax, K * (xi1 + NORTH1) AS ay,
        K * (et2 + EAST2) + 500000 AS bx, K * (xi2 + NORTH2) AS b_y FROM xe),
    rings AS (
      SELECT polygon, part, ring, abs(sum(ax * b_y - bx * ay)) / 2 AS m2 FROM metres
      GROUP BY 1, 2, 3),
    areas AS (SELECT polygon, sum(CASE WHEN ring = 0 THEN m2 ELSE -m2 END) / 1e6 AS area_km2
      FROM rings GROUP BY 1)"""


def _area_sql() -> str:
    e, radius, alpha = geo._mercator_constants()
    text = AREA
    for side in ("1", "2"):
        east = " + ".join(
            f"{al:.17e} * cos({2 * j} * xi{side}) * sinh({2 * j} * et{side})"
            for j, al in enumerate(alpha, start=1)
        )
        north = " + ".join(
            f"{al:.17e} * sin({2 * j} * xi{side}) * cosh({2 * j} * et{side})"
            for j, al in enumerate(alpha, start=1)
        )
        text = text.replace(f"EAST{side}", east).replace(f"NORTH{side}", north)
    text = text.replace("K * ", f"{geo.SCALE * radius:.17e} * ")
    return text.replace("E * ", f"{e:.17e} * ")


@query(
    "polygon_area",
    f"WITH {a.EDGES_SQL}, {_area_sql()} SELECT polygon, round(area_km2, 4) AS area_km2 FROM areas",
)
def polygon_area(spark, sf):
    return rounded(spatial.areas_km2(_edges(spark, sf)), 4, "area_km2")


@query(
    "area_coherence",
    f"""WITH {a.EDGES_SQL}, {_area_sql()}, st AS (
      SELECT polygon, s_nationkey AS parent, area_km2,
        area_km2 * (1 + (polygon % 5) * 0.0004e0) AS stored FROM areas
      JOIN supplier ON s_suppkey = polygon), par AS (
      SELECT parent, sum(area_km2) * 1.01e0 AS parent_km2 FROM st GROUP BY 1), o AS (
      SELECT st.*, parent_km2, abs(stored - area_km2) / area_km2 * 100 AS off
      FROM st JOIN par ON par.parent = st.parent)
    SELECT parent, count(*) AS polygons, round(max(off), 4) AS worst_own_pct,
      count(*) FILTER (WHERE off > 0.1e0) AS own_outside,
      round(abs(sum(area_km2) - max(parent_km2)) / max(parent_km2) * 100, 4) AS sum_vs_parent_pct,
      abs(sum(area_km2) - max(parent_km2)) / max(parent_km2) * 100 > 2 AS parent_outside
    FROM o GROUP BY 1""",
)
def area_coherence(spark, sf):
    measured = spatial.areas_km2(_edges(spark, sf))
    own = measured.join(
        a.table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("polygon"), F.col("s_nationkey").alias("parent")
        ),
        "polygon",
    ).withColumn("stored_km2", F.col("area_km2") * (1 + (F.col("polygon") % 5) * 0.0004))
    parents = own.groupBy("parent").agg((F.sum("area_km2") * 1.01).alias("parent_km2"))
    stored = own.drop("area_km2").join(parents, "parent")
    out = spatial.area_coherence(stored, measured, "parent")
    return rounded(out, 4, "worst_own_pct", "sum_vs_parent_pct")


@query(
    "extent_km",
    f"""WITH {a.EDGES_SQL}, {_area_sql()}, b AS (
      SELECT polygon, min(least(x1, x2)) AS w, max(greatest(x1, x2)) AS e,
        min(least(y1, y2)) AS s, max(greatest(y1, y2)) AS n FROM edges GROUP BY 1)
    SELECT b.polygon, round((e - w) * 111.320e0 * cos(radians((s + n) / 2)), 5) AS width_km,
      round((n - s) * 110.574e0, 5) AS height_km,
      (e - w) * 111.320e0 * cos(radians((s + n) / 2)) * (n - s) * 110.574e0 >= area_km2
        AS box_holds_area
    FROM b JOIN areas ON areas.polygon = b.polygon""",
)
def extent_km(spark, sf):
    edge = _edges(spark, sf)
    boxes = spatial.bounding_boxes(edge).select("polygon", "width_km", "height_km")
    both = boxes.join(spatial.areas_km2(edge), "polygon")
    out = both.withColumn(
        "box_holds_area", F.col("width_km") * F.col("height_km") >= F.col("area_km2")
    )
    return rounded(out.drop("area_km2"), 5, "width_km", "height_km")


@query(
    "ring_validity",
    f"""WITH {a.EDGES_SQL}, bad AS (
      SELECT polygon, part, ring, seq,
        CASE WHEN polygon % 7 = 3 AND ring = 0 AND part = 0 AND seq = 2 THEN x2 - 0.1e0 ELSE x2 END
          AS x2, CASE WHEN polygon % 7 = 3 AND ring = 0 AND part = 0 AND seq = 3 THEN x1 - 0.1e0
          ELSE x1 END AS x1, y1, y2 FROM edges),
    f AS (
      SELECT polygon, part, ring, count(*) + 1 AS vertices, arg_min(x1, seq) = arg_max(x2, seq)
        AND arg_min(y1, seq) = arg_max(y2, seq) AS closed,
        abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM bad GROUP BY 1, 2, 3),
    long AS (SELECT *, row_number() OVER (PARTITION BY polygon, part, ring ORDER BY seq) AS n,
        count(*) OVER (PARTITION BY polygon, part, ring) AS last
      FROM bad WHERE x1 <> x2 OR y1 <> y2),
    pairs AS (
      SELECT p.polygon, p.part, p.ring, q.n - p.n = 1 OR (p.n = 1 AND q.n = p.last) AS beside,
        sign((p.x2-p.x1)*(q.y1-p.y1)-(p.y2-p.y1)*(q.x1-p.x1)) AS s1,
        sign((p.x2-p.x1)*(q.y2-p.y1)-(p.y2-p.y1)*(q.x2-p.x1)) AS s2,
        sign((q.x2-q.x1)*(p.y1-q.y1)-(q.y2-q.y1)*(p.x1-q.x1)) AS s3,
        sign((q.x2-q.x1)*(p.y2-q.y1)-(q.y2-q.y1)*(p.x2-q.x1)) AS s4,
        (p.x2-p.x1)*(q.x2-q.x1) + (p.y2-p.y1)*(q.y2-q.y1) < 0 AS opposite,
        greatest(p.x1, p.x2) >= least(q.x1, q.x2) AND greatest(q.x1, q.x2) >= least(p.x1, p.x2)
          AND greatest(p.y1, p.y2) >= least(q.y1, q.y2) AND greatest(q.y1, q.y2) >= least(p.y1, p.y2) AS meet
      FROM long p JOIN long q ON p.polygon = q.polygon AND p.part = q.part AND p.ring = q.ring AND p.n < q.n),
    x AS (SELECT DISTINCT polygon, part, ring FROM pairs
      WHERE CASE WHEN beside THEN s1 = 0 AND s2 = 0 AND opposite ELSE s1 * s2 <= 0 AND s3 * s4 <= 0 AND meet END)
    SELECT f.polygon, CAST(f.part AS INTEGER) AS part, CAST(f.ring AS INTEGER) AS ring, vertices,
      closed, area = 0 AS zero_area, x.polygon IS NOT NULL AS self_crossing,
      closed AND vertices >= 4 AND area > 0 AND x.polygon IS NULL AS valid
    FROM f LEFT JOIN x ON x.polygon = f.polygon AND x.part = f.part AND x.ring = f.ring""",
)
def ring_validity(spark, sf):
    c = F.col
    broken = (c("polygon") % 7 == 3) & (c("ring") == 0) & (c("part") == 0)
    edge = _edges(spark, sf).withColumns(
        {
            "x2": F.when(broken & (c("seq") == 2), c("x2") - 0.1).otherwise(c("x2")),
            "x1": F.when(broken & (c("seq") == 3), c("x1") - 0.1).otherwise(c("x1")),
        }
    )
    return spatial.ring_validity(edge)


# Faults planted by polygon number, in thousandths of a degree: holes out of, across and along their shell,
# parts on, across and inside the other part.
MOVED = """CASE WHEN k % 16 = 6 AND ring = 1 THEN {v} + {out} WHEN k % 16 = 10 AND ring = 1 THEN {v} + {over}
        WHEN k % 16 = 14 AND ring = 1 THEN {v} + {along} WHEN k % 16 = 7 AND part = 1 THEN {v} + {on}
        WHEN k % 16 = 11 AND part = 1 THEN {v} + {across}
        WHEN k % 16 = 15 AND part = 1 THEN {first} + {lead} + ({v} - {first} - {base}) * {num} {div} 4 ELSE {v} END"""


def _moved(v: str, axis: str, div: str) -> str:
    x = axis == "x"
    first = (f"({a.WEST} + (k % {a.COLUMNS}) * {a.PITCH})" if x else f"({a.SOUTH} + (k {div} {a.COLUMNS}) * {a.PITCH})")
    shifts = {"out": 50, "over": 30, "along": 20, "on": -40, "across": -30} if x else {"out": 0, "over": 7, "along": 0, "on": 0, "across": 10}
    return MOVED.format(v=v, first=first, lead=5 if x else 8, base=40 if x else 0, num=2, div=div, **shifts)


def _fault_edges(div: str) -> str:
    columns = ", ".join(f"({_moved(f'i{c}', c[0], div)}) / 1e3 AS {c}" for c in ("x1", "y1", "x2", "y2"))
    return f"SELECT polygon, part, ring, seq, {columns} FROM numbered"


@query(
    "polygon_validity",
    f"""WITH {a.EDGES_SQL}, numbered AS (
      SELECT *, polygon AS k, CAST(round(x1 * 1000) AS BIGINT) AS ix1, CAST(round(y1 * 1000) AS BIGINT) AS iy1,
        CAST(round(x2 * 1000) AS BIGINT) AS ix2, CAST(round(y2 * 1000) AS BIGINT) AS iy2 FROM edges),
    e AS ({_fault_edges("//")}), pairs AS (
      SELECT p.polygon, p.part, p.ring, q.part AS o_part, q.ring AS o_ring,
        sign((p.x2-p.x1)*(q.y1-p.y1)-(p.y2-p.y1)*(q.x1-p.x1)) * sign((p.x2-p.x1)*(q.y2-p.y1)-(p.y2-p.y1)*(q.x2-p.x1)) < 0
        AND sign((q.x2-q.x1)*(p.y1-q.y1)-(q.y2-q.y1)*(p.x1-q.x1)) * sign((q.x2-q.x1)*(p.y2-q.y1)-(q.y2-q.y1)*(p.x2-q.x1)) < 0 AS crossing,
        (p.x2-p.x1)*(q.y1-p.y1)-(p.y2-p.y1)*(q.x1-p.x1) = 0 AND (p.x2-p.x1)*(q.y2-p.y1)-(p.y2-p.y1)*(q.x2-p.x1) = 0
        AND greatest(least(p.x2, greatest(q.x1, q.x2)), least(p.x1, greatest(q.x1, q.x2))) - least(greatest(p.x2, least(q.x1, q.x2)), greatest(p.x1, least(q.x1, q.x2)))
          + greatest(least(p.y2, greatest(q.y1, q.y2)), least(p.y1, greatest(q.y1, q.y2))) - least(greatest(p.y2, least(q.y1, q.y2)), greatest(p.y1, least(q.y1, q.y2))) > 0 AS along
      FROM e p JOIN e q ON p.polygon = q.polygon AND (p.part <> q.part OR p.ring <> q.ring)),
    met AS (SELECT polygon, part, ring, o_part, o_ring, bool_or(crossing) AS crossing, bool_or(along) AS along FROM pairs GROUP BY 1, 2, 3, 4, 5),
    middle AS (SELECT polygon, part, ring, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM e WHERE seq = 1),
    held AS (
      SELECT m.polygon, m.part, m.ring, q.part AS o_part, q.ring AS o_ring,
        count(*) FILTER ((q.y1 <= m.y) <> (q.y2 <= m.y) AND q.x1 + (m.y - q.y1) * (q.x2 - q.x1) / nullif(q.y2 - q.y1, 0) > m.x) % 2 = 1 AS inside
      FROM middle m JOIN e q ON m.polygon = q.polygon AND (m.part <> q.part OR m.ring <> q.ring) GROUP BY 1, 2, 3, 4, 5),
    told AS (SELECT *, inside AND NOT crossing AND NOT along AS within FROM met JOIN held USING (polygon, part, ring, o_part, o_ring)),
    why AS (
      SELECT polygon, CASE WHEN part = o_part THEN 'rings cross' ELSE 'parts overlap' END AS reason FROM told WHERE crossing
      UNION SELECT polygon, CASE WHEN part = o_part THEN 'rings share a line' ELSE 'parts share a line' END FROM told WHERE along
      UNION SELECT polygon, 'hole outside shell' FROM told WHERE part = o_part AND ring > 0 AND o_ring = 0 AND NOT within AND NOT crossing AND NOT along
      UNION SELECT polygon, 'nested parts' FROM told WHERE part <> o_part AND ring = 0 AND o_ring = 0 AND within)
    SELECT k.polygon, coalesce(r.reasons, '') AS reasons, r.reasons IS NULL AS valid FROM (SELECT DISTINCT polygon FROM e) k
    LEFT JOIN (SELECT polygon, string_agg(reason, ', ' ORDER BY reason) AS reasons FROM why GROUP BY 1) r ON r.polygon = k.polygon""",
)
def polygon_validity(spark, sf):
    whole = {f"i{c}": F.round(F.col(c) * 1000).cast("long") for c in ("x1", "y1", "x2", "y2")}
    numbered = _edges(spark, sf).withColumns(whole | {"k": F.col("polygon")})
    moved = numbered.select("polygon", "part", "ring", "seq", *(F.expr(f"({_moved(f'i{c}', c[0], 'div')}) / 1000D").alias(c) for c in ("x1", "y1", "x2", "y2")))
    told = spatial.polygon_validity(moved)
    return told.withColumn("reasons", F.array_join("reasons", ", "))


@query(
    "srid_audit",
    """SELECT CASE WHEN s_suppkey % 9 = 0 THEN 5367 ELSE 4326 END AS srid, count(*) AS polygons,
      CAST(0 AS BIGINT) AS empty, CAST(0 AS BIGINT) AS outside_range,
      min(s_suppkey % 9) <> 0 AS as_declared FROM supplier GROUP BY 1""",
)
def srid_audit(spark, sf):
    df = a.polygons(spark, sf).withColumn(
        "srid", F.when(F.col("polygon") % 9 == 0, 5367).otherwise(4326)
    )
    return spatial.reference_system_audit(df)


LOCATED = f"""WITH {a.EDGES_SQL}, {a.DETECTIONS_SQL}, boxes AS (
      SELECT polygon, min(least(x1, x2)) AS w, max(greatest(x1, x2)) AS e,
        min(least(y1, y2)) AS s, max(greatest(y1, y2)) AS n FROM edges GROUP BY 1), hit AS (
      SELECT d.detection_id, b.polygon FROM detections d
      JOIN boxes b ON lon BETWEEN w AND e AND lat BETWEEN s AND n
      JOIN edges g ON g.polygon = b.polygon
      WHERE (y1 <= lat) <> (y2 <= lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon
      GROUP BY 1, 2 HAVING count(*) % 2 = 1)
    SELECT d.detection_id, d.date, h.polygon FROM detections d
    LEFT JOIN hit h ON h.detection_id = d.detection_id"""


def _points(spark, sf):
    return a.detections(spark, sf).select("detection_id", "date", "lon", "lat")


@query("point_in_polygon", LOCATED)
def point_in_polygon(spark, sf):
    index = spatial.polygon_index(_edges(spark, sf))
    return spatial.locate_points(_points(spark, sf), index).select(
        "detection_id", "date", "polygon"
    )


@query("point_in_polygon_crowded", LOCATED)
def point_in_polygon_crowded(spark, sf):
    """The same answer from large cells, the crowded ones cut finer and all of them salted."""
    step = 0.4
    index, fine = spatial.refine(spatial.polygon_index(_edges(spark, sf), step), 16)
    found = spatial.locate_points(_points(spark, sf), index, step, fine=fine, salts=4)
    return found.select("detection_id", "date", "polygon")


@query(
    "cells_touched",
    f"""WITH {a.EDGES_SQL}, v AS (
      SELECT polygon, -1 AS d, x1, y1, x2, y2 FROM edges
      UNION ALL SELECT polygon, 2, round(x1, 2), round(y1, 2), round(x2, 2), round(y2, 2) FROM edges
      UNION ALL SELECT polygon, 1, round(x1, 1), round(y1, 1), round(x2, 1), round(y2, 1) FROM edges),
    l AS (
      SELECT *, greatest(1, CAST(ceil(2 * 6371008.8e0 * asin(sqrt(
        pow(sin((radians(y2 - y1)) / 2), 2) + cos(radians(y1)) * cos(radians(y2))
          * pow(sin((radians(x2 - x1)) / 2), 2))) / 400e0) AS BIGINT)) AS n FROM v),
    w AS (SELECT *, unnest(range(0, n + 1)) AS i FROM l), c AS (
      SELECT DISTINCT polygon, d,
        floor((x1 + CAST(i AS DOUBLE) / n * (x2 - x1) + 180) / 0.05e0) AS cx,
        floor((y1 + CAST(i AS DOUBLE) / n * (y2 - y1) + 90) / 0.05e0) AS cy FROM w)
    SELECT polygon, count(*) FILTER (WHERE d = -1) AS original,
      count(*) FILTER (WHERE d = 2) AS rounded_2, count(*) FILTER (WHERE d = 1) AS rounded_1
    FROM c GROUP BY 1""",
)
def cells_touched(spark, sf):
    return spatial.cells_touched(_edges(spark, sf), decimals=(None, 2, 1))


@query(
    "param_sweep",
    f"""WITH {a.EDGES_SQL}, v AS (
      SELECT polygon, x1, y1, x2, y2, d, round(x1, d) AS a1, round(y1, d) AS b1,
        round(x2, d) AS a2, round(y2, d) AS b2
      FROM edges, (VALUES (3), (2), (1)) t(d)), p AS (
      SELECT d, polygon, count(*) FILTER (WHERE a1 <> a2 OR b1 <> b2) AS vertices,
        abs(sum(x1 * y2 - x2 * y1) / 2) AS before, abs(sum(a1 * b2 - a2 * b1) / 2) AS after
      FROM v GROUP BY 1, 2)
    SELECT CAST(d AS INTEGER) AS decimals, max(vertices) AS worst_vertices,
      max(vertices * (2 * d + 8)) AS worst_weight,
      round(max(abs(before - after) / before * 100), 4) AS worst_area_change_pct
    FROM p GROUP BY 1""",
)
def param_sweep(spark, sf):
    out = spatial.coarsening_sweep(_edges(spark, sf), decimals=(3, 2, 1))
    return rounded(out, 4, "worst_area_change_pct")


@query(
    "zonal_mean",
    f"""WITH {a.EDGES_SQL}, {a.DETECTIONS_SQL}, grid AS (
      SELECT CAST(floor(lon / 0.01e0) AS BIGINT) AS cx, CAST(floor(lat / 0.01e0) AS BIGINT) AS cy,
        date, max(CAST(confidence AS DOUBLE)) AS value FROM detections GROUP BY 1, 2, 3),
    boxes AS (
      SELECT polygon, min(least(x1, x2)) AS w, max(greatest(x1, x2)) AS e,
        min(least(y1, y2)) AS s, max(greatest(y1, y2)) AS n FROM edges GROUP BY 1),
    cells AS (SELECT DISTINCT cx, cy, (cx + 0.5e0) * 0.01e0 AS lon, (cy + 0.5e0) * 0.01e0 AS lat
      FROM grid), cov AS (
      SELECT c.cx, c.cy, b.polygon FROM cells c
      JOIN boxes b ON lon BETWEEN w AND e AND lat BETWEEN s AND n
      JOIN edges g ON g.polygon = b.polygon
      WHERE (y1 <= lat) <> (y2 <= lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon
      GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
    SELECT polygon, date, round(avg(value), 6) AS mean, count(value) AS cells
    FROM grid JOIN cov ON cov.cx = grid.cx AND cov.cy = grid.cy GROUP BY 1, 2""",
)
def zonal_mean(spark, sf):
    step = 0.01
    grid = (
        a.detections(spark, sf)
        .groupBy(
            F.floor(F.col("lon") / step).alias("cx"), F.floor(F.col("lat") / step).alias("cy"), "date"
        )
        .agg(F.max(F.col("confidence").cast("double")).alias("value"))
    )
    covered = spatial.coverage(spatial.polygon_index(_edges(spark, sf), step), step)
    return rounded(spatial.zonal_mean(grid, covered), 6, "mean")


@query(
    "idw_surface",
    f"""WITH {a.EDGES_SQL}, b AS (
      SELECT polygon, (min(least(x1, x2)) + max(greatest(x1, x2))) / 2 AS lon,
        (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS lat FROM edges GROUP BY 1),
    pts AS (SELECT polygon, lon, lat, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS value
      FROM b JOIN supplier ON s_suppkey = polygon), k AS (SELECT * FROM pts WHERE value IS NOT NULL),
    ext AS (SELECT max(lat) + 0.03e0 AS n, min(lat) - 0.03e0 AS s, max(lon) + 0.03e0 AS e,
      min(lon) - 0.03e0 AS w FROM k),
    grid AS (SELECT r AS row, c AS col, n - r * ((n - s) / 179) AS lat,
        w + c * ((e - w) / 179) AS lon
      FROM ext, (SELECT unnest(range(0, 180)) AS r), (SELECT unnest(range(0, 180)) AS c)),
    d AS (SELECT row, col, grid.lat, grid.lon, value, polygon,
        pow(grid.lat - k.lat, 2) + pow(grid.lon - k.lon, 2) AS d2 FROM grid, k)
    SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(lat, 6) AS lat,
      round(lon, 6) AS lon, round(coalesce(arg_min(value, polygon) FILTER (WHERE d2 < 1e-9),
        sum(CASE WHEN d2 >= 1e-9 THEN value / d2 END) / sum(CASE WHEN d2 >= 1e-9 THEN 1 / d2 END)), 4)
        AS value
    FROM d GROUP BY row, col, lat, lon""",
)
def idw_surface(spark, sf):
    boxes = spatial.bounding_boxes(_edges(spark, sf))
    values = a.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("polygon"),
        F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal")).alias("value"),
    )
    points = boxes.join(values, "polygon").select(
        "polygon", F.col("centre_lon").alias("lon"), F.col("centre_lat").alias("lat"), "value"
    )
    return rounded(rounded(spatial.idw_surface(points), 6, "lat", "lon"), 4, "value")
