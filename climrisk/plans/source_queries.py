"""Payload parsing, sinks' pure parts and exports. Payloads are built from the tables by Spark."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import functions as F

from climrisk.operators import audits, calendar, risk
from climrisk.plans import adapters as a
from climrisk.plans.registry import query, rounded
from climrisk.schemas import REANALYSIS_COLUMNS, REANALYSIS_UNITS
from climrisk.sources import payloads, tables

# A supplier's whole series is one response, as a climate service sends it.
_PARAMETERS = {
    "T2M_MAX": "max(l_quantity)",
    "T2M_MIN": "min(l_quantity)",
    "T2M": "sum(l_quantity) / count(*)",
    "RH2M": "CASE WHEN max(l_linenumber) < 7 THEN 50e0 ELSE -999e0 END",
    "WS2M": "CAST(max(l_linenumber) AS DOUBLE)",
    "ALLSKY_SFC_SW_DWN": "CAST(min(l_linenumber) AS DOUBLE)",
}


def reanalysis_payloads(spark, sf):
    """Climate responses as JSON text, one per supplier; some declare a wrong unit."""
    spark_sql = {
        "T2M_MAX": F.max("l_quantity"),
        "T2M_MIN": F.min("l_quantity"),
        "T2M": F.sum("l_quantity") / F.count("*"),
        "RH2M": F.when(F.max("l_linenumber") < 7, 50.0).otherwise(-999.0),
        "WS2M": F.max("l_linenumber").cast("double"),
        "ALLSKY_SFC_SW_DWN": F.min("l_linenumber").cast("double"),
    }
    day = F.to_date("l_shipdate")
    daily = (
        a.table(spark, sf, "lineitem")
        .groupBy("l_suppkey", day.alias("date"))
        .agg(*(v.alias(p) for p, v in spark_sql.items()))
    )
    whole = daily.groupBy("l_suppkey").agg(
        *(
            F.map_from_entries(
                F.collect_list(F.struct(F.date_format("date", "yyyyMMdd"), F.col(p)))
            ).alias(p)
            for p in spark_sql
        )
    )
    units = lambda p, u: F.struct(
        (
            F.when(F.col("l_suppkey") % 5 == 0, F.lit("K")).otherwise(F.lit(u))
            if p == "T2M"
            else F.lit(u)
        ).alias("units")
    )
    doc = F.struct(
        F.struct(F.lit(-999.0).alias("fill_value")).alias("header"),
        F.struct(*(units(p, u).alias(p) for p, u in REANALYSIS_UNITS.items())).alias("parameters"),
        F.struct(F.struct(*(F.col(p) for p in spark_sql)).alias("parameter")).alias("properties"),
    )
    return whole.select("l_suppkey", F.to_json(doc).alias("payload"))


_DAILY = f"""daily AS (
      SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date,
        {', '.join(f'{v} AS {REANALYSIS_COLUMNS[p]}' for p, v in _PARAMETERS.items())}
      FROM lineitem GROUP BY 1, 2)"""


@query(
    "src_reanalysis_json",
    f"""WITH {_DAILY} SELECT l_suppkey, date, temp_max_c, temp_min_c,
      round(temp_mean_c, 6) AS temp_mean_c, nullif(humidity_pct, -999) AS humidity_pct, wind_ms,
      radiation_mj_m2 FROM daily""",
)
def src_reanalysis_json(spark, sf):
    parsed = payloads.parse_reanalysis(reanalysis_payloads(spark, sf))
    return rounded(payloads.reanalysis_daily(parsed, ("l_suppkey",)), 6, "temp_mean_c")


@query(
    "fill_to_null",
    f"""WITH {_DAILY} SELECT count(*) AS rows,
      count(*) FILTER (WHERE humidity_pct <> -999) AS measured,
      count(*) FILTER (WHERE humidity_pct = -999) AS missing,
      min(nullif(humidity_pct, -999)) AS lowest FROM daily""",
)
def fill_to_null(spark, sf):
    parsed = payloads.parse_reanalysis(reanalysis_payloads(spark, sf))
    daily = payloads.reanalysis_daily(parsed, ("l_suppkey",))
    return daily.agg(
        F.count("*").alias("rows"),
        F.count("humidity_pct").alias("measured"),
        F.count_if(F.col("humidity_pct").isNull()).alias("missing"),
        F.min("humidity_pct").alias("lowest"),
    )


@query(
    "unit_mismatch",
    """SELECT DISTINCT l_suppkey, 'T2M' AS parameter, 'C' AS expected, 'K' AS declared
    FROM lineitem WHERE l_suppkey % 5 = 0""",
)
def unit_mismatch(spark, sf):
    parsed = payloads.parse_reanalysis(reanalysis_payloads(spark, sf))
    return payloads.unit_mismatches(parsed, ("l_suppkey",))


def rain_payloads(spark, sf):
    """Rain responses as JSON text, one per order priority, customer and day of order."""
    day = F.to_date("o_orderdate")
    value = F.floor(F.col("o_totalprice") / 1000) - 20
    row = F.struct(
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        F.when(F.col("o_orderkey") % 7 != 0, F.struct(value.alias("avg"))).alias("value"),
    )
    flat = F.struct(
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        F.lit("plain").alias("value"),
        value.cast("double").alias("raw_value"),
    )
    text = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct(F.array(flat).alias("data"))))
    return a.table(spark, sf, "orders").select(
        "o_orderkey",
        text.otherwise(F.to_json(F.struct(F.array(row).alias("data")))).alias("payload"),
    )


@query(
    "rain_rows_clean",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
      CASE WHEN (o_orderkey % 3 = 0 OR o_orderkey % 7 <> 0) AND floor(o_totalprice / 1000) >= 20
        THEN floor(o_totalprice / 1000) - 20 END AS value FROM orders""",
)
def rain_rows_clean(spark, sf):
    return payloads.rain_rows(rain_payloads(spark, sf), ("o_orderkey",))


_RANGES = """ranges AS (
      SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_date,
        CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20000 AS INTEGER) AS DATE) AS end_date
      FROM orders)"""


@query(
    "range_tiles",
    f"""WITH RECURSIVE {_RANGES}, t AS (
      SELECT o_orderkey, start_date, end_date, 0 AS tile, start_date AS tile_start,
        least(CAST(start_date + INTERVAL 19 YEAR AS DATE), end_date) AS tile_end FROM ranges
      UNION ALL
      SELECT o_orderkey, start_date, end_date, tile + 1, CAST(tile_end + 1 AS DATE),
        least(CAST(CAST(tile_end + 1 AS DATE) + INTERVAL 19 YEAR AS DATE), end_date)
      FROM t WHERE tile_end < end_date)
    SELECT * FROM t""",
)
def range_tiles(spark, sf):
    start = F.to_date("o_orderdate")
    ranges = a.table(spark, sf, "orders").select(
        "o_orderkey",
        start.alias("start_date"),
        F.date_add(start, (F.col("o_orderkey") % 20000).cast("int")).alias("end_date"),
    )
    return calendar.range_tiles(ranges)


@query(
    "tile_overlap_guard",
    f"""WITH {a.STATIONS_SQL} SELECT series, date, CAST(2 AS BIGINT) AS tiles FROM stations_days
    WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-01-10'""",
)
def tile_overlap_guard(spark, sf):
    days = a.station_days(spark, sf)
    early = days.where(F.col("date") <= F.lit(Date(1998, 1, 10)))
    late = days.where(F.col("date") >= F.lit(Date(1998, 1, 1)))
    return calendar.overlapping_tiles(early.unionByName(late))


def feature_collections(spark, sf):
    """One collection per supplier: its polygon, one stray line, attributes with accents."""
    c = F.col
    coordinates = F.transform(
        c("geometry"),
        lambda part: F.transform(
            part, lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
        ),
    )
    attributes = F.struct(
        F.concat(F.lit("5"), F.lpad(c("polygon").cast("string"), 6, "0")).alias("CÓDIGO_DTA"),
        F.lit("160105").alias("CÓDIGO"),
        F.concat(F.lit(" Río "), c("polygon").cast("string"), F.lit(" ")).alias("DISTRITO"),
    )
    single = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(
                F.lit("Polygon").alias("type"), F.get(coordinates, 0).alias("coordinates")
            ).alias("geometry"),
            attributes.alias("properties"),
        )
    )
    multi = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias(
                "geometry"
            ),
            attributes.alias("properties"),
        )
    )
    line = F.lit(
        '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},'
        '"properties":{"CÓDIGO_DTA":"0"}}'
    )
    first = F.when(F.size("geometry") == 1, single).otherwise(multi)
    return a.polygons(spark, sf).select(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['), first, F.lit(","), line, F.lit("]}")
        ).alias("payload")
    )


@query(
    "src_geojson",
    f"""WITH {a.EDGES_SQL} SELECT '5' || lpad(CAST(polygon AS VARCHAR), 6, '0') AS code,
      'Río ' || CAST(polygon AS VARCHAR) AS name, CAST(count(DISTINCT part) AS INTEGER) AS parts,
      count(*) AS edges, min(x1) AS west, max(y2) AS north FROM edges GROUP BY polygon""",
)
def src_geojson(spark, sf):
    from climrisk.operators.spatial import edges

    rows = payloads.geojson_rows(feature_collections(spark, sf))
    sizes = (
        edges(rows, "code")
        .groupBy("code")
        .agg(F.count("*").alias("edges"), F.min("x1").alias("west"), F.max("y2").alias("north"))
    )
    return rows.select("code", "name", F.size("geometry").alias("parts")).join(sizes, "code")


@query(
    "src_events_csv",
    f"""WITH {a.CATALOG_SQL} SELECT event_id, district, CASE WHEN event_id % 50 <> 7 THEN start_date END AS start_date,
      CASE WHEN event_id % 50 = 7 THEN '2000-13-45' END AS start_unreadable,
      CASE WHEN event_id % 50 <> 8 THEN end_date END AS end_date,
      CASE WHEN event_id % 50 = 8 THEN 'soon' END AS end_unreadable, severity, source,
      description FROM catalog""",
)
def src_events_csv(spark, sf):
    # Some start and end dates are no dates.
    raw = a.raw_catalog(spark, sf).withColumn("event", F.lit(" "))
    odd = F.pmod(F.col("event_id"), F.lit(50))
    raw = raw.withColumns(
        {
            "start_date": F.when(odd == 7, F.lit("2000-13-45")).otherwise(F.col("start_date")),
            "end_date": F.when(odd == 8, F.lit("soon")).otherwise(F.col("end_date")),
        }
    )
    return payloads.clean_event_rows(raw).drop("event", "kind")


_AREA = {"west": -85.5, "east": -84.0, "south": 8.0, "north": 8.2}


@query(
    "src_hotspots",
    f"""WITH {a.DETECTIONS_SQL} SELECT detection_id, date, lon, lat, confidence FROM detections
    WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
      AND lon BETWEEN {_AREA['west']}e0 AND {_AREA['east']}e0
      AND lat BETWEEN {_AREA['south']}e0 AND {_AREA['north']}e0""",
)
def src_hotspots(spark, sf):
    found = payloads.detections_in(
        a.detections(spark, sf), Date(2024, 1, 5), Date(2024, 1, 25), **_AREA
    )
    return found.select("detection_id", "date", "lon", "lat", "confidence")


@query(
    "table_digest",
    """WITH named AS (SELECT 'orders' AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS a,
        CAST(o_custkey AS VARCHAR) AS b, CAST(o_orderkey AS VARCHAR) AS c, o_orderstatus AS d,
        CAST(o_totalprice AS VARCHAR) AS e FROM orders
      UNION ALL SELECT * FROM (VALUES
        ('bar_left', 'a|b', 'c', '1.0', NULL, NULL), ('bar_right', 'a', 'b|c', '1.0000000001', NULL, NULL),
        ('null_text', NULL, NULL, NULL, NULL, NULL), ('null_word', '\\N', 'N', NULL, NULL, NULL))),
    t AS (SELECT name, sha256(concat(
        coalesce(length(a) || ':' || a, 'N'), coalesce(length(b) || ':' || b, 'N'),
        coalesce(length(c) || ':' || c, 'N'), CASE WHEN name = 'orders' THEN coalesce(length(d) || ':' || d, 'N') ELSE '' END,
        CASE WHEN name = 'orders' THEN coalesce(length(e) || ':' || e, 'N') ELSE '' END)) AS h FROM named)
    SELECT name, count(*) AS rows, concat_ws('-',
      sum(CAST('0x' || substr(h, 1, 16) AS UBIGINT)), sum(CAST('0x' || substr(h, 17, 16) AS UBIGINT)),
      sum(CAST('0x' || substr(h, 33, 16) AS UBIGINT)), sum(CAST('0x' || substr(h, 49, 16) AS UBIGINT))) AS digest
    FROM t GROUP BY name""",
)
def table_digest(spark, sf):
    # Columns are hashed in name order. The small tables are pairs that careless texts confuse.
    orders = a.table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("a"), F.col("o_custkey").alias("b"), F.col("o_orderkey").alias("c"),
        F.col("o_orderstatus").alias("d"), F.col("o_totalprice").alias("e"),
    )
    pairs = {
        "bar_left": ("a|b", "c", 1.0),
        "bar_right": ("a", "b|c", 1.0000000001),
        "null_text": (None, None, None),
        "null_word": ("\\N", "N", None),
    }
    out = tables.table_digest(orders).withColumn("name", F.lit("orders"))
    for name, row in pairs.items():
        one = spark.createDataFrame([row], "a string, b string, c double")
        out = out.unionByName(tables.table_digest(one).withColumn("name", F.lit(name)))
    return out.select("name", "rows", "digest")


@query(
    "geojson_export",
    f"""WITH {a.EDGES_SQL}, rings AS (
      SELECT polygon, part, ring, '[' || string_agg('[' || x1 || ',' || y1 || ']', ',' ORDER BY seq)
        || ',[' || arg_max(x2, seq) || ',' || arg_max(y2, seq) || ']]' AS t
      FROM edges GROUP BY 1, 2, 3), parts AS (
      SELECT polygon, part, '[' || string_agg(t, ',' ORDER BY ring) || ']' AS t FROM rings
      GROUP BY 1, 2)
    SELECT CAST(polygon AS VARCHAR) AS code, '{{"type":"Feature","geometry":{{"type":'
      || '"MultiPolygon","coordinates":[' || string_agg(t, ',' ORDER BY part)
      || ']}},"properties":{{"code":"' || polygon || '","population":null}}}}' AS feature
    FROM parts GROUP BY polygon""",
)
def geojson_export(spark, sf):
    rows = a.polygons(spark, sf).withColumn("code", F.col("polygon").cast("string"))
    empty = F.lit(None).cast("int").alias("population")
    return risk.geojson_features(rows, (F.col("code"), empty))


@query(
    "export_coverage",
    """SELECT CAST(c_custkey AS VARCHAR) AS code, 'missing' AS side FROM customer
    WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def export_coverage(spark, sf):
    known = a.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("code"))
    return risk.export_coverage(geojson_export(spark, sf), known)


@query(
    "series_export",
    f"""WITH {a.REGIONS_SQL} SELECT series AS district, CAST(year(date) AS INTEGER) AS year,
      'value' AS variable, 'mm' AS unit, CAST(count(*) AS INTEGER) AS points,
      CAST(count(*) - count(value) AS INTEGER) AS gaps, min(date) AS first_day,
      arg_max(CAST(value AS VARCHAR), date) FILTER (WHERE date = (SELECT max(date) FROM regions)
        OR date = make_date(year(date), 12, 31)) AS last_value
    FROM regions GROUP BY 1, 2""",
)
def series_export(spark, sf):
    nested = risk.series_export(a.regions(spark, sf), "value", "mm")
    last = F.element_at("points", -1)
    return nested.select(
        "district",
        "year",
        "variable",
        "unit",
        F.size("points").alias("points"),
        F.size(F.filter("points", lambda p: p["value"].isNull())).alias("gaps"),
        F.get("points", 0)["date"].alias("first_day"),
        last["value"].cast("string").alias("last_value"),
    )


@query(
    "top_per_group",
    f"""WITH {a.STATIONS_SQL} SELECT series, date, value,
      CAST(row_number() OVER (PARTITION BY series ORDER BY value DESC, date) AS INTEGER) AS place
    FROM stations_days QUALIFY place <= 3""",
)
def top_per_group(spark, sf):
    order = (F.desc("value"), F.asc("date"))
    return audits.top_per_group(a.station_days(spark, sf), "series", order, 3)
