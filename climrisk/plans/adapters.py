"""The given tables read as climate entities, with the same reading written as SQL.

Values are whole numbers wherever they are summed, so both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climrisk.operators.calendar import densify

# Outlines in thousandths of a degree: parts > rings > vertices, one shape per polygon kind.
SHAPES = (
    [[[(0, 0), (60, 0), (60, 60), (0, 60), (0, 0)]]],
    [[[(0, 0), (60, 0), (60, 20), (20, 20), (20, 60), (0, 60), (0, 0)]]],
    [
        [
            [(0, 0), (60, 0), (60, 60), (0, 60), (0, 0)],
            [(20, 20), (20, 40), (40, 40), (40, 20), (20, 20)],
        ]
    ],
    [
        [[(0, 0), (20, 0), (20, 60), (0, 60), (0, 0)]],
        [[(40, 0), (60, 0), (60, 60), (40, 60), (40, 0)]],
    ],
)
PITCH, COLUMNS, WEST, SOUTH = 80, 40, -85900, 8000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- daily series -------------------------------------------------------------------------


def rain_days(spark, sf) -> DataFrame:
    """Three long series with few gaps: daily rain per return flag."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date"))
        .agg(F.sum(F.greatest(F.col("l_quantity") - 45, F.lit(0.0))).alias("value"))
    )


def rain(spark, sf) -> DataFrame:
    return densify(rain_days(spark, sf))


def region_days(spark, sf) -> DataFrame:
    """Five series with many gaps: thousands ordered per region and day."""
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("series"), F.to_date("o_orderdate").alias("date"))
        .agg(F.sum(F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("value"))
    )


def regions(spark, sf) -> DataFrame:
    return densify(region_days(spark, sf))


def station_days(spark, sf) -> DataFrame:
    """One sparse series per supplier; the number of series grows with the data."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("series"), F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def stations(spark, sf) -> DataFrame:
    return densify(station_days(spark, sf))


def station_rows(spark, sf) -> int:
    """Rows of `stations`: series times days, from one summary of the table."""
    day = F.to_date("l_shipdate")
    found = table(spark, sf, "lineitem").agg(
        F.count_distinct("l_suppkey").alias("series"),
        (F.datediff(F.max(day), F.min(day)) + 1).alias("days"),
    )
    n = found.first()
    return n["series"] * (n["days"] or 0)


def _dense_sql(name: str, source: str) -> str:
    return f"""
{name}_days AS ({source}),
{name} AS (
  SELECT m.series, c.date, d.value
  FROM (SELECT DISTINCT series FROM {name}_days) m
  CROSS JOIN (
    SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
    FROM {name}_days) c
  LEFT JOIN {name}_days d ON d.series = m.series AND d.date = c.date)"""


RAIN_SQL = _dense_sql(
    "rain",
    """SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date,
       SUM(greatest(l_quantity - 45, 0)) AS value FROM lineitem GROUP BY 1, 2""",
)
REGIONS_SQL = _dense_sql(
    "regions",
    """SELECT r_name AS series, CAST(o_orderdate AS DATE) AS date,
       CAST(SUM(floor(o_totalprice / 1000)) AS DOUBLE) AS value
       FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
STATIONS_SQL = _dense_sql(
    "stations",
    """SELECT l_suppkey AS series, CAST(l_shipdate AS DATE) AS date,
       SUM(l_quantity) AS value FROM lineitem GROUP BY 1, 2""",
)


# --- daily measurements, all variables ------------------------------------------------------


def measurements(spark, sf) -> DataFrame:
    """Wide daily table per supplier, one row per (district, date)."""
    c = F.col
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("district"),
            F.to_date("l_shipdate").alias("date"),
        )
        .agg(
            F.max("l_quantity").alias("temp_max_c"),
            F.min("l_quantity").alias("temp_min_c"),
            (F.sum("l_quantity") / F.count("*")).alias("temp_mean_c"),
            F.when(F.max("l_linenumber") < 7, F.round(F.max("l_discount") * 1000)).alias(
                "humidity_pct"
            ),
            F.round(F.max("l_tax") * 100).alias("wind_ms"),
            F.max("l_linenumber").cast("double").alias("radiation_mj_m2"),
            F.sum(
                F.when(c("l_quantity") > 2, F.greatest(c("l_quantity") - 45, F.lit(0.0)))
            ).alias("precip_mm"),
            F.when(F.bool_or(c("l_linestatus") == "O"), "chirps")
            .otherwise("otra")
            .alias("rain_source"),
            F.lit("power").alias("other_source"),
            F.bool_or(c("l_returnflag") == "R").alias("imputed"),
            F.when(F.bool_or(c("l_returnflag") == "R"), "media_movil")
            .otherwise("sin_imputar")
            .alias("imputation_method"),
            F.date_add(F.max(F.to_date("l_shipdate")), F.max("l_linenumber")).alias(
                "downloaded_at"
            ),
        )
    )


MEASUREMENTS_SQL = """
measurements AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS district, CAST(l_shipdate AS DATE) AS date,
    max(l_quantity) AS temp_max_c, min(l_quantity) AS temp_min_c,
    sum(l_quantity) / count(*) AS temp_mean_c,
    CASE WHEN max(l_linenumber) < 7 THEN round(max(l_discount) * 1000) END AS humidity_pct,
    round(max(l_tax) * 100) AS wind_ms,
    CAST(max(l_linenumber) AS DOUBLE) AS radiation_mj_m2,
    sum(CASE WHEN l_quantity > 2 THEN greatest(l_quantity - 45, 0) END) AS precip_mm,
    CASE WHEN max(l_linestatus) = 'O' THEN 'chirps' ELSE 'otra' END AS rain_source,
    'power' AS other_source,
    max(l_returnflag) = 'R' AS imputed,
    CASE WHEN max(l_returnflag) = 'R' THEN 'media_movil' ELSE 'sin_imputar' END
      AS imputation_method,
    CAST(max(CAST(l_shipdate AS DATE)) + CAST(max(l_linenumber) AS INTEGER) AS DATE)
      AS downloaded_at
  FROM lineitem GROUP BY 1, 2)"""


# --- territory ----------------------------------------------------------------------------


def cantons(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(
        (100 * (F.col("n_regionkey") + 1) + F.col("n_nationkey") + 1).alias("canton_code"),
        (F.col("n_regionkey") + 1).alias("province_code"),
        F.col("n_name").alias("canton_name"),
        "n_nationkey",
    )


def districts(spark, sf) -> DataFrame:
    """Suppliers as districts: text code starting with the canton's digits."""
    return (
        table(spark, sf, "supplier")
        .join(cantons(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(
                F.col("canton_code").cast("string"),
                F.lpad(F.col("s_suppkey").cast("string"), 6, "0"),
            ).alias("code"),
            "canton_code",
            F.col("s_name").alias("name"),
            F.when(F.col("s_suppkey") % 10 == 0, F.lit(0))
            .when(F.col("s_suppkey") % 10 < 4, (F.col("s_suppkey") * 3).cast("int"))
            .alias("population"),
            "s_suppkey",
        )
    )


DISTRICTS_SQL = """
cantons AS (
  SELECT 100 * (n_regionkey + 1) + n_nationkey + 1 AS canton_code,
    n_regionkey + 1 AS province_code, n_name AS canton_name, n_nationkey FROM nation),
districts AS (
  SELECT CAST(canton_code AS VARCHAR) || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code,
    canton_code, s_name AS name,
    CASE WHEN s_suppkey % 10 = 0 THEN 0 WHEN s_suppkey % 10 < 4 THEN CAST(s_suppkey * 3 AS INTEGER)
    END AS population, s_suppkey
  FROM supplier JOIN cantons ON s_nationkey = n_nationkey)"""


def polygons(spark, sf) -> DataFrame:
    """One multipolygon per supplier on a lattice: box, L, box with hole, two boxes."""

    def nested(shape) -> str:
        ring = lambda r: "array(" + ", ".join(f"array({x}, {y})" for x, y in r) + ")"
        part = lambda p: "array(" + ", ".join(map(ring, p)) + ")"
        return "array(" + ", ".join(map(part, shape)) + ")"

    x, y = _place("s_suppkey", "div")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("polygon"),
        F.expr(
            f"""transform(element_at(array({', '.join(map(nested, SHAPES))}),
              cast(s_suppkey % 4 as int) + 1), part -> transform(part, ring -> transform(ring,
              p -> named_struct('lon', ({x} + p[0]) / 1000D, 'lat', ({y} + p[1]) / 1000D))))"""
        ).alias("geometry"),
    )


def _edge_values() -> str:
    rows = []
    for kind, shape in enumerate(SHAPES):
        for part, rings in enumerate(shape):
            for ring, points in enumerate(rings):
                for seq, (a, b) in enumerate(zip(points, points[1:]), start=1):
                    rows.append(f"({kind},{part},{ring},{seq},{a[0]},{a[1]},{b[0]},{b[1]})")
    return ", ".join(rows)


def _place(k: str, whole: str) -> tuple[str, str]:
    """South-west corner of lattice place k in thousandths of a degree, as SQL text."""
    return (
        f"({WEST} + ({k} % {COLUMNS}) * {PITCH})",
        f"({SOUTH} + ({k} {whole} {COLUMNS}) * {PITCH})",
    )


_X, _Y = _place("s_suppkey", "//")
EDGES_SQL = f"""
shapes(kind, part, ring, seq, dx1, dy1, dx2, dy2) AS (VALUES {_edge_values()}),
edges AS (
  SELECT s_suppkey AS polygon, part, ring, seq,
    ({_X} + dx1) / 1e3 AS x1, ({_Y} + dy1) / 1e3 AS y1,
    ({_X} + dx2) / 1e3 AS x2, ({_Y} + dy2) / 1e3 AS y2
  FROM supplier JOIN shapes ON s_suppkey % 4 = kind)"""


# --- detections ---------------------------------------------------------------------------


def detections(spark, sf) -> DataFrame:
    """Events as point detections near the lattice place of their user."""
    x, y = _place("user_id", "div")
    return table(spark, sf, "events").selectExpr(
        "event_id AS detection_id",
        "CAST(ts AS DATE) AS date",
        f"({x} + (event_id * 37) % {PITCH}) / 1000D + 0.0005D AS lon",
        f"({y} + (event_id * 53) % {PITCH}) / 1000D + 0.0005D AS lat",
        "CAST(event_id % 101 AS INT) AS confidence",
        "event_type",
        "concat('D', CAST(user_id % 8 AS STRING)) AS district",
    )


_PX, _PY = _place("user_id", "//")
DETECTIONS_SQL = f"""
detections AS (
  SELECT event_id AS detection_id, CAST(ts AS DATE) AS date,
    ({_PX} + (event_id * 37) % {PITCH}) / 1e3 + 0.0005e0 AS lon,
    ({_PY} + (event_id * 53) % {PITCH}) / 1e3 + 0.0005e0 AS lat,
    CAST(event_id % 101 AS INTEGER) AS confidence, event_type,
    'D' || CAST(user_id % 8 AS VARCHAR) AS district
  FROM events)"""


def fire_counts(spark, sf) -> DataFrame:
    """Fire detections per district and day, days without any left out."""
    return (
        detections(spark, sf)
        .where("event_type = 'error'")
        .groupBy(F.col("district").alias("series"), "date")
        .agg(F.count("*").alias("detections"))
    )


FIRE_SQL = f"""{DETECTIONS_SQL},
fire_days AS (
  SELECT district AS series, date, count(*) AS detections FROM detections
  WHERE event_type = 'error' GROUP BY 1, 2),
fire AS (
  SELECT m.series, c.date, coalesce(d.detections, 0) AS detections
  FROM (SELECT DISTINCT series FROM fire_days) m
  CROSS JOIN (
    SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
    FROM fire_days) c
  LEFT JOIN fire_days d ON d.series = m.series AND d.date = c.date)"""


# --- risks and catalogue ------------------------------------------------------------------


def risks(spark, sf) -> DataFrame:
    """Events as estimated risks: highest scaled value per user, day and hazard."""
    kind = (
        F.when(F.col("event_type") == "click", "lluvia_intensa")
        .when(F.col("event_type") == "view", "sequia")
        .when(F.col("event_type") == "error", "incendio")
    )
    return (
        table(spark, sf, "events")
        .select(
            F.col("user_id").cast("string").alias("district"),
            F.to_date("ts").alias("date"),
            kind.alias("event"),
            (F.col("value") / 512).alias("p"),
        )
        .where(F.col("event").isNotNull())
        .groupBy("district", "date", "event")
        .agg(F.max("p").alias("probability"))
    )


RISKS_SQL = """
risks AS (
  SELECT CAST(user_id AS VARCHAR) AS district, CAST(ts AS DATE) AS date,
    CASE event_type WHEN 'click' THEN 'lluvia_intensa' WHEN 'view' THEN 'sequia'
      WHEN 'error' THEN 'incendio' END AS event,
    max(value / 512) AS probability
  FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2, 3),
leveled AS (
  SELECT *, CASE WHEN probability >= 2e0/3 THEN 'alto' WHEN probability >= 1e0/3 THEN 'medio'
    ELSE 'bajo' END AS level FROM risks)"""


def raw_catalog(spark, sf) -> DataFrame:
    """Orders as an event archive, every column as untrimmed text."""
    key = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    end = F.when(key % 5 != 0, F.date_add(start, (key % 11).cast("int") - 1))
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "FLOOD")
        .when(F.col("o_orderpriority") == "2-HIGH", "DROUGHT")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "LANDSLIDE")
        .when(F.col("o_orderpriority") == "5-LOW", "FORESTFIRE")
        .otherwise("FIRE")
    )
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("event_id"),
            F.concat(F.lit(" "), "r_name").alias("district"),
            kind.alias("kind"),
            start.cast("string").alias("start_date"),
            F.coalesce(F.concat(end.cast("string"), F.lit(" ")), F.lit("  ")).alias("end_date"),
            F.when(F.col("o_orderstatus") == "F", "alto")
            .when(F.col("o_orderstatus") == "O", "medio")
            .otherwise("")
            .alias("severity"),
            F.when(key % 17 == 0, "  ").otherwise("archivo ").alias("source"),
            F.when(key % 3 == 0, "Fuertes lluvias")
            .when(key % 3 == 1, "Epicentro cercano")
            .otherwise("")
            .alias("description"),
        )
    )


CATALOG_SQL = """
catalog AS (
  SELECT o_orderkey AS event_id, r_name AS district,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'FLOOD' WHEN '2-HIGH' THEN 'DROUGHT'
      WHEN '3-MEDIUM' THEN 'LANDSLIDE' WHEN '5-LOW' THEN 'FORESTFIRE' ELSE 'FIRE' END AS kind,
    CAST(o_orderdate AS DATE) AS start_date,
    CASE WHEN o_orderkey % 5 <> 0
      THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 - 1 AS INTEGER) END AS end_date,
    CASE o_orderstatus WHEN 'F' THEN 'alto' WHEN 'O' THEN 'medio' END AS severity,
    CASE WHEN o_orderkey % 17 <> 0 THEN 'archivo' END AS source,
    CASE o_orderkey % 3 WHEN 0 THEN 'Fuertes lluvias' WHEN 1 THEN 'Epicentro cercano' END
      AS description
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
mapped AS (
  SELECT *, CASE WHEN kind = 'FLOOD' THEN 'lluvia_intensa' WHEN kind = 'DROUGHT' THEN 'sequia'
    WHEN kind = 'FORESTFIRE' THEN 'incendio'
    WHEN kind = 'LANDSLIDE' AND description LIKE '%lluvia%' THEN 'lluvia_intensa' END AS event
  FROM catalog)"""
