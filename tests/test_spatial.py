"""Grid cells, polygons and surfaces against brute force in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from climrisk.functions import geo
from climrisk.operators import spatial
from climrisk.schemas import MULTIPOLYGON

SCHEMA = f"polygon string, geometry {MULTIPOLYGON.simpleString()}"


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in (*points, points[0])]


SHAPES = {
    "box": [[ring((0, 0), (1, 0), (1, 1), (0, 1))]],
    "hole": [[ring((2, 0), (4, 0), (4, 2), (2, 2)), ring((2.5, 0.5), (2.5, 1.5), (3.5, 1.5), (3.5, 0.5))]],
    "u": [[ring((0, 3), (3, 3), (3, 6), (2, 6), (2, 4), (1, 4), (1, 6), (0, 6))]],
    "two": [[ring((5, 5), (6, 5), (6, 6))], [ring((7.1, 7.2), (8.3, 7.1), (8.2, 8.4), (7.3, 8.1))]],
}


def star(seed, cx, cy, n=40, radius=1.4):
    r = random.Random(seed)
    points = []
    for i in range(n):
        d = radius * r.uniform(0.25, 1)
        points.append((cx + d * math.cos(2 * math.pi * i / n), cy + d * math.sin(2 * math.pi * i / n)))
    return [[ring(*points)]]


@pytest.fixture(scope="module")
def shapes():
    return {**SHAPES, "star": star(1, -3, 2), "star2": star(2, -3.5, 2.5)}


@pytest.fixture(scope="module")
def edge(spark, shapes):
    return spatial.edges(spark.createDataFrame(list(shapes.items()), SCHEMA)).cache()


def inside(shape, x, y):
    odd = False
    for part in shape:
        for r in part:
            for a, b in zip(r, r[1:]):
                if (a["lat"] <= y) != (b["lat"] <= y):
                    at = a["lon"] + (y - a["lat"]) * (b["lon"] - a["lon"]) / (b["lat"] - a["lat"])
                    odd ^= at > x
    return odd


@pytest.mark.parametrize(
    "step,salts,crowd", [(0.05, 1, None), (0.3, 3, None), (1.0, 1, 3), (1.0, 2, 12), (10.0, 1, 1)]
)
def test_points_find_their_polygons(spark, edge, shapes, step, salts, crowd):
    r = random.Random(4)
    pts = [(i, r.uniform(-6, 9), r.uniform(-1, 9)) for i in range(1500)]
    pts += [(2000, 0.0, 0.0), (2001, 1.0, 0.5), (2002, 0.5, 1.0), (2003, 2.5, 1.0), (2004, 0.5, 0.0)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    index, fine = spatial.polygon_index(edge, step), None
    if crowd is not None:
        whole = index
        index, fine = spatial.refine(whole, crowd)
        assert 0 < fine.count() and index.count() < whole.count()
    got = {}
    for row in spatial.locate_points(df, index, step, fine=fine, salts=salts).collect():
        got.setdefault(row.id, []).append(row.polygon)
    for i, x, y in pts:
        want = sorted(n for n, s in shapes.items() if inside(s, x, y)) or [None]
        assert sorted(got[i], key=str) == sorted(want, key=str), (i, x, y)


def test_coverage_is_the_cells_with_inner_centres(edge, shapes):
    step = 0.25
    got = {}
    for r in spatial.coverage(spatial.polygon_index(edge, step), step).collect():
        got.setdefault(r.polygon, set()).add((r.cx, r.cy))
    for name, shape in shapes.items():
        want = {
            (cx, cy)
            for cx in range(-30, 45)
            for cy in range(-10, 45)
            if inside(shape, (cx + 0.5) * step, (cy + 0.5) * step)
        }
        assert got[name] == want


def test_interior_points_lie_inside(edge, shapes):
    rows = spatial.interior_points(edge).collect()
    assert len(rows) == len(shapes)
    for r in rows:
        assert inside(shapes[r.polygon], r.lon, r.lat), r


def test_zonal_mean_ignores_missing_cells(spark, edge):
    step = 0.5
    covered = spatial.coverage(spatial.polygon_index(edge, step), step).where("polygon = 'box'")
    rows = [(0, 0, "d", 1.0), (1, 0, "d", 3.0), (0, 1, "d", None), (9, 9, "d", 50.0)]
    grid = spark.createDataFrame(rows, "cx long, cy long, date string, value double")
    got = spatial.zonal_mean(grid, covered).first()
    assert (got["mean"], got.cells) == (2.0, 2)


def test_bounding_boxes(edge):
    row = spatial.bounding_boxes(edge.where("polygon = 'hole'")).first()
    assert (row.west, row.east, row.south, row.north) == (2, 4, 0, 2)
    assert (row.centre_lon, row.centre_lat) == (3, 1)
    assert row.height_km == pytest.approx(2 * 110.574)
    assert row.width_km == pytest.approx(2 * 111.320 * math.cos(math.radians(1)))


def test_projection_and_area(spark):
    # On the central meridian the easting is false easting; northing grows by the scale factor.
    p = spark.createDataFrame([(-84.0, 0.0), (-84.0, 10.0), (-85.0, 10.0)], "lon double, lat double")
    e, n = geo.to_metres(F.col("lon"), F.col("lat"))
    rows = p.select("lon", "lat", e.alias("e"), n.alias("n")).collect()
    assert rows[0].e == pytest.approx(500000) and rows[0].n == pytest.approx(0, abs=1e-6)
    # Meridian arc from the equator to 10 degrees on GRS80 is 1105854.833 m.
    assert rows[1].n == pytest.approx(0.9999 * 1105854.833, abs=0.01)
    assert rows[2].e < 500000
    d = 0.05
    box = [[ring((-84 - d, 10), (-84 + d, 10), (-84 + d, 10 + d), (-84 - d, 10 + d)), ring((-84, 10.01), (-83.99, 10.01), (-83.99, 10.02))]]
    edge = spatial.edges(spark.createDataFrame([("b", box)], SCHEMA))
    area = spatial.areas_km2(edge).first().area_km2
    # Ellipsoidal band area between the latitudes, less half a small box, scaled.
    a, f = geo.SEMI_MAJOR, geo.FLATTENING
    e2 = f * (2 - f)
    dens = lambda lat: a * a * (1 - e2) * math.cos(lat) / (1 - e2 * math.sin(lat) ** 2) ** 2
    lat = np.radians(np.linspace(10, 10 + d, 2001))
    vals = np.array([dens(x) for x in lat])
    band = np.sum((vals[1:] + vals[:-1]) / 2 * np.diff(lat)) * math.radians(2 * d)
    hole = dens(math.radians(10.015)) * math.radians(0.01) ** 2 / 2
    assert area == pytest.approx((band - hole) * 0.9999**2 / 1e6, rel=2e-5)


def test_area_coherence_flags_deviations(spark):
    stored = spark.createDataFrame(
        [("a", 1, 100.0, 200.0), ("b", 1, 100.2, 200.0), ("c", 2, 50.0, 60.0)],
        "polygon string, parent int, stored_km2 double, parent_km2 double",
    )
    measured = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 50.0)], "polygon string, area_km2 double")
    rows = {r.parent: r for r in spatial.area_coherence(stored, measured, "parent").collect()}
    assert rows[1].own_outside == 1 and not rows[1].parent_outside
    assert rows[2].own_outside == 0 and rows[2].parent_outside


def test_ring_validity(spark):
    bow = [[ring((0, 0), (2, 2), (2, 0), (0, 2))]]
    opened = [[ring((0, 0), (1, 0), (1, 1))[:-1] + [{"lon": 0.1, "lat": 0.0}]]]
    flat = [[ring((0, 0), (1, 0), (2, 0))]]
    rows = [("bow", bow), ("open", opened), ("flat", flat), ("star", star(7, 0, 0, 60)), *SHAPES.items()]
    out = spatial.ring_validity(spatial.edges(spark.createDataFrame(rows, SCHEMA))).collect()
    got = {(r.polygon, r.part, r.ring): r for r in out}
    assert got["bow", 0, 0].self_crossing and not got["bow", 0, 0].valid
    assert not got["open", 0, 0].closed
    assert got["flat", 0, 0].zero_area and not got["flat", 0, 0].valid
    assert got["star", 0, 0].valid and got["hole", 0, 1].valid and got["two", 1, 0].valid


def test_rings_that_touch_themselves_are_not_valid(spark):
    shapes = {
        "bow_at_a_vertex": ((0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2)),
        "vertex_on_an_edge": ((0, 0), (4, 0), (4, 4), (2, 0), (0, 4)),
        "edges_overlap": ((0, 0), (4, 0), (4, 2), (3, 2), (3, 0), (1, 0), (1, 2), (0, 2)),
        "spike": ((0, 0), (4, 0), (4, 4), (4, 7), (4, 4), (0, 4)),
        "repeated_vertex": ((0, 0), (4, 0), (4, 0), (4, 4), (0, 4)),
        "notched": ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4)),
    }
    rows = [(name, [[ring(*points)]]) for name, points in shapes.items()]
    out = spatial.ring_validity(spatial.edges(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.polygon for r in out if r.valid} == {"repeated_vertex", "notched"}


def box(x, y, w, h=None):
    h = w if h is None else h
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


VALIDITY = {
    "plain": ([[box(0, 0, 6)]], ()),
    "hole": ([[box(0, 0, 6), box(2, 2, 2)]], ()),
    "hole_touches_in_a_point": ([[box(0, 0, 6), ring((0, 3), (2, 2), (2, 4))]], ()),
    "hole_outside": ([[box(0, 0, 6), box(8, 0, 2)]], ("hole outside shell",)),
    "hole_outside_touching": ([[box(0, 0, 6), ring((6, 3), (8, 2), (8, 4))]], ("hole outside shell",)),
    "hole_crosses": ([[box(0, 0, 6), box(4, 2, 4, 2)]], ("rings cross",)),
    "hole_crosses_at_vertices": ([[ring((0, 0), (6, 0), (6, 3), (6, 6), (0, 6)), ring((5, 3), (6, 3), (7, 4), (6, 6), (5, 5))]], ("rings cross",)),
    "hole_shares_a_line": ([[box(0, 0, 6), box(4, 2, 2)]], ("rings share a line",)),
    "holes_nested": ([[box(0, 0, 9), box(1, 1, 6), box(3, 3, 2)]], ("nested holes",)),
    "holes_cross": ([[box(0, 0, 9), box(1, 1, 4), box(3, 3, 4)]], ("rings cross",)),
    "two_parts": ([[box(0, 0, 2)], [box(5, 0, 2)]], ()),
    "parts_touch_in_a_point": ([[box(0, 0, 2)], [box(2, 2, 2)]], ()),
    "parts_touch_along": ([[box(0, 0, 2)], [box(2, 0, 2)]], ("parts share a line",)),
    "parts_overlap": ([[box(0, 0, 4)], [box(2, 2, 4)]], ("parts overlap",)),
    "part_in_part": ([[box(0, 0, 6)], [box(2, 2, 2)]], ("nested parts",)),
    "island_in_a_hole": ([[box(0, 0, 9), box(1, 1, 7)], [box(3, 3, 2)]], ()),
    "island_across_a_hole": ([[box(0, 0, 9), box(2, 2, 3)], [box(4, 3, 2, 1)]], ("parts overlap",)),
    "island_in_an_island": ([[box(0, 0, 9), box(1, 1, 7)], [box(2, 2, 4)], [box(3, 3, 1)]], ("nested parts",)),
    "bow": ([[ring((0, 0), (2, 2), (2, 0), (0, 2))]], ("ring",)),
    "corner_on_corner": ([[box(0, 0, 6), ring((0, 0), (2, 1), (1, 2))]], ()),
}


def test_polygon_validity_names_each_fault(spark):
    rows = [(name, shape) for name, (shape, _) in VALIDITY.items()]
    for step in (0.7, 20.0):
        told = spatial.polygon_validity(spatial.edges(spark.createDataFrame(rows, SCHEMA)), step)
        got = {r.polygon: (tuple(r.reasons), r.valid) for r in told.collect()}
        assert got == {name: (reasons, not reasons) for name, (_, reasons) in VALIDITY.items()}


def crosses(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def test_self_crossing_matches_all_pairs(spark):
    """Rings with edges of very different lengths, some of them crossing."""
    rows, want = [], {}
    for seed in range(40):
        r = random.Random(seed)
        pts = [(r.uniform(0, 1), r.uniform(0, 1)) for _ in range(r.choice((3, 4, 5)))]
        for _ in range(6):
            x, y = pts[-1]
            pts.append((x + r.uniform(-1, 1) * 0.5 ** r.randint(0, 9), y + r.uniform(-1, 1) * 0.01))
        closed = [*pts, pts[0]]
        segs = list(zip(closed, closed[1:]))
        n = len(segs)
        want[str(seed)] = any(
            crosses(*segs[i], *segs[j])
            for i in range(n)
            for j in range(i + 2, n)
            if not (i == 0 and j == n - 1)
        )
        rows.append((str(seed), [[ring(*pts)]]))
    edge = spatial.edges(spark.createDataFrame(rows, SCHEMA))
    got = {r.polygon: r.self_crossing for r in spatial.ring_validity(edge).collect()}
    assert got == want and 0 < sum(want.values()) < 40


def test_cells_touched_counts_boundary_cells(spark):
    box = [[ring((0.01, 0.01), (0.14, 0.01), (0.14, 0.14), (0.01, 0.14))]]
    edge = spatial.edges(spark.createDataFrame([("b", box)], SCHEMA))
    row = spatial.cells_touched(edge, decimals=(None, 1)).first()
    assert row.original == 8


def test_reference_system_audit(spark):
    rows = [("a", SHAPES["box"], 4326), ("b", SHAPES["u"], 5367), ("c", [], 4326)]
    df = spark.createDataFrame(rows, SCHEMA + ", srid int")
    got = {r.srid: r for r in spatial.reference_system_audit(df).collect()}
    assert got[4326].as_declared and got[4326].empty == 1 and not got[5367].as_declared


def test_known_cell_cases(spark):
    pts = spark.createDataFrame([(-84.6, 10.8), (-84.97, 10.3), (0.0, 0.0)], "lon double, lat double")
    x, y = geo.cell_centre(F.col("lon"), F.col("lat"))
    got = [tuple(r) for r in pts.select(x, y).collect()]
    assert got == [(-84.375, 11.0), (-85.0, 10.5), (0.0, 0.0)]
    # Two points the coarse source is known to serve with one value share a centred cell.
    near = spark.createDataFrame([(-85.03, 10.42), (-84.87, 10.53)], "lon double, lat double")
    a, b = geo.cell_number(F.col("lon"), F.col("lat"), "power")
    assert near.select(a, b).distinct().count() == 1
    a, b = geo.cell_number(F.col("lon"), F.col("lat"), "chirps")
    assert near.select(a, b).distinct().count() == 2
    with pytest.raises(ValueError):
        geo.cell_centre(F.col("lon"), F.col("lat"), "chirps")


def test_cell_sharing(spark):
    df = spark.createDataFrame([("a", -85.03, 10.42), ("b", -84.87, 10.53), ("c", -80.0, 9.0)], "polygon string, lon double, lat double")
    rows = spatial.cell_sharing(df, "power").collect()
    assert sorted((r.members, r.shared) for r in rows) == [(1, False), (2, True)]


@pytest.mark.parametrize("power", [1.0, 2.0, 3.5])
def test_surface_matches_brute_force(spark, power, monkeypatch):
    monkeypatch.setattr(spatial, "POINTS_PER_CHUNK", 7)
    r = random.Random(6)
    pts = [(i, r.uniform(-85, -84), r.uniform(10, 11), r.random()) for i in range(40)]
    pts.append((40, -84.5, 10.5, None))
    df = spark.createDataFrame(pts, "polygon int, lon double, lat double, value double")
    side = 12
    got = {(r.row, r.col): r for r in spatial.idw_surface(df, power, side).collect()}
    known = [p for p in pts if p[3] is not None]
    north, south = max(p[2] for p in known) + 0.03, min(p[2] for p in known) - 0.03
    east, west = max(p[1] for p in known) + 0.03, min(p[1] for p in known) - 0.03
    assert len(got) == side * side
    for (i, j), row in got.items():
        lat, lon = north - i * (north - south) / (side - 1), west + j * (east - west) / (side - 1)
        w = [1 / ((lat - p[2]) ** 2 + (lon - p[1]) ** 2) ** (power / 2) for p in known]
        want = sum(a * p[3] for a, p in zip(w, known)) / sum(w)
        assert row.value == pytest.approx(want, rel=1e-9)


def test_surface_on_a_point_takes_its_exact_value(spark):
    pts = [("b", 0.0, 0.0, 7.0), ("a", 0.0, 0.0, 5.0), ("c", 0.06, 0.06, 9.0)]
    df = spark.createDataFrame(pts, "polygon string, lon double, lat double, value double")
    got = {(r.row, r.col): r.value for r in spatial.idw_surface(df, 2.0, 5).collect()}
    assert got[3, 1] == 5.0 and got[1, 3] == 9.0
    with pytest.raises(ValueError):
        spatial.idw_surface(df, 5.0)


def test_sweep_of_roundings(edge):
    rows = {r.decimals: r for r in spatial.coarsening_sweep(edge, (3, 1)).collect()}
    assert rows[3].worst_area_change_pct < rows[1].worst_area_change_pct


def test_band_index_is_null_on_zero_sum(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, -1.0), (None, 1.0)], "a double, b double")
    out = df.select(geo.normalised_difference(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in out] == [0.5, None, None]
