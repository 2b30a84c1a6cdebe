"""Audits, merges, catalogues, reads of risk tables and set operations."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import functions as F

from climrisk.functions import geo
from climrisk.operators import audits, calendar, catalog, merge, risk, spatial
from climrisk.operators import labels as level_ops
from climrisk.plans import adapters as a
from climrisk.plans import series_queries as s
from climrisk.plans.registry import query, rounded
from climrisk.schemas import EVENTS, MEASURES
from climrisk.sources import payloads

FIRST_DAY, LAST_DAY = Date(1995, 6, 1), Date(2001, 6, 30)


@query("district_lookup", f"WITH {a.DISTRICTS_SQL} SELECT code, name, population FROM districts WHERE code = '101001000007' OR population = 0")
def district_lookup(spark, sf):
    d = a.districts(spark, sf)
    return d.where((F.col("code") == "101001000007") | (F.col("population") == 0)).select(
        "code", "name", "population"
    )


@query(
    "code_hierarchy",
    f"""WITH {a.DISTRICTS_SQL} SELECT code, CAST(substr(code, 1, 1) AS INTEGER) AS province,
      CAST(substr(code, 1, 3) AS INTEGER) AS canton,
      CAST(substr(code, 1, 3) AS INTEGER) = canton_code AS consistent FROM districts""",
)
def code_hierarchy(spark, sf):
    canton = F.substring("code", 1, 3).cast("int")
    return a.districts(spark, sf).select(
        "code",
        F.substring("code", 1, 1).cast("int").alias("province"),
        canton.alias("canton"),
        (canton == F.col("canton_code")).alias("consistent"),
    )


@query(
    "dim_join",
    f"""WITH {a.DISTRICTS_SQL} SELECT d.code, d.name, c.canton_name, c.province_code
    FROM districts d JOIN cantons c ON c.canton_code = d.canton_code""",
)
def dim_join(spark, sf):
    c = a.cantons(spark, sf).select("canton_code", "canton_name", "province_code")
    return a.districts(spark, sf).join(c, "canton_code").select(
        "code", "name", "canton_name", "province_code"
    )


@query(
    "two_source_merge",
    f"""WITH {a.REGIONS_SQL}, coarse AS (
      SELECT CAST(l_shipdate AS DATE) AS date, max(l_quantity) AS temp_max_c,
        max(CAST(l_linenumber AS DOUBLE)) AS wind_ms FROM lineitem GROUP BY 1)
    SELECT r.series, r.date, r.value, c.temp_max_c, c.wind_ms
    FROM regions r LEFT JOIN coarse c ON c.date = r.date""",
)
def two_source_merge(spark, sf):
    rain = a.region_days(spark, sf)
    coarse = (
        a.table(spark, sf, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg(
            F.max("l_quantity").alias("temp_max_c"),
            F.max(F.col("l_linenumber").cast("double")).alias("wind_ms"),
        )
    )
    lo, hi = calendar.span(rain)
    return merge.two_source_merge(rain.select("series").distinct(), coarse, rain, lo, hi)


CELL_X, CELL_Y = "CAST(round_even(({x} + 180) / 0.625e0, 0) AS INTEGER)", "CAST(round_even(({y} + 90) / 0.5e0, 0) AS INTEGER)"


@query(
    "source_cell_merge",
    f"""WITH {a.DETECTIONS_SQL}, {a.EDGES_SQL}, coarse AS (
      SELECT {CELL_X.format(x="lon")} AS cell_x, {CELL_Y.format(y="lat")} AS cell_y,
        CAST(date - INTERVAL 9000 DAY AS DATE) AS date, max(confidence) AS temp_max_c, count(*) AS observations FROM detections GROUP BY 1, 2, 3),
    placed AS (
      SELECT polygon AS series, {CELL_X.format(x="min(x1)")} AS cell_x, {CELL_Y.format(y="min(y1)")} AS cell_y
      FROM edges GROUP BY 1),
    days AS (SELECT l_suppkey AS series, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value
      FROM lineitem GROUP BY 1, 2),
    span AS (SELECT min(date) AS lo, max(date) AS hi FROM coarse)
    SELECT p.series, p.cell_x, p.cell_y, c.date, d.value, o.temp_max_c, o.observations
    FROM placed p CROSS JOIN (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span) c
    LEFT JOIN days d ON d.series = p.series AND d.date = c.date
    LEFT JOIN coarse o ON o.cell_x = p.cell_x AND o.cell_y = p.cell_y AND o.date = c.date""",
)
def source_cell_merge(spark, sf):
    """Suppliers' territories by their south-west corner, detections as the coarse source of their cells.

    Detections are moved back by 9,000 days, to where the deliveries lie.
    """
    x, y = geo.cell_number(F.col("lon"), F.col("lat"), "power")
    seen = a.detections(spark, sf).withColumns({"cell_x": x, "cell_y": y, "date": F.date_sub("date", 9000)})
    coarse = seen.groupBy("cell_x", "cell_y", "date").agg(
        F.max("confidence").alias("temp_max_c"), F.count("*").alias("observations")
    )
    corners = spatial.edges(a.polygons(spark, sf)).groupBy(F.col("polygon").alias("series")).agg(
        F.min("x1").alias("lon"), F.min("y1").alias("lat")
    )
    lo, hi = seen.agg(F.min("date"), F.max("date")).first()
    return merge.source_cell_merge(corners, coarse, a.station_days(spark, sf), lo, hi)


DELIVERY = """delivery AS (
      SELECT l_suppkey AS district, CAST(l_shipdate AS DATE) AS date, l_quantity AS precip_mm,
        l_orderkey * 10 + l_linenumber AS downloaded_at, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1
        END AS is_new FROM lineitem)"""


@query(
    "upsert_latest",
    f"""WITH {DELIVERY} SELECT district, date, max(downloaded_at) AS downloaded_at,
      arg_max(precip_mm, downloaded_at * 2 + is_new) AS precip_mm FROM delivery GROUP BY 1, 2""",
)
def upsert_latest(spark, sf):
    rows = a.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("district"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("precip_mm"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("downloaded_at"),
        "l_linestatus",
    )
    existing = rows.where("l_linestatus = 'F'").drop("l_linestatus")
    new = rows.where("l_linestatus <> 'F'").drop("l_linestatus")
    return merge.latest_by_key(existing, new, ("district", "date"))


@query(
    "provenance",
    f"""WITH {a.MEASUREMENTS_SQL} SELECT district, count(*) AS rows,
      count(*) FILTER (WHERE precip_mm IS NULL) AS null_rain,
      count(*) FILTER (WHERE temp_mean_c IS NULL) AS null_temp, min(date) AS first_day,
      max(date) AS last_day, max(downloaded_at) AS last_ingestion
    FROM measurements GROUP BY 1""",
)
def provenance(spark, sf):
    return audits.provenance(a.measurements(spark, sf))


@query(
    "completeness",
    f"""WITH {a.STATIONS_SQL} SELECT series, count(*) AS rows, min(date) AS first_day,
      max(date) AS last_day, CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER)
        AS calendar_days, count(*) = date_diff('day', min(date), max(date)) + 1 AS complete
    FROM stations_days GROUP BY 1""",
)
def completeness(spark, sf):
    return audits.completeness(a.station_days(spark, sf))


@query(
    "window_bounds",
    f"""WITH {a.STATIONS_SQL}, per AS (SELECT series, count(*) AS rows, min(date) AS lo,
        max(date) AS hi FROM stations_days GROUP BY 1)
    SELECT CAST(sum(rows) AS BIGINT) AS rows, min(lo) AS first_day, max(hi) AS last_day,
      count(*) FILTER (WHERE rows <> date_diff('day', lo, hi) + 1) AS incomplete_series FROM per""",
)
def window_bounds(spark, sf):
    return audits.window_bounds(audits.completeness(a.station_days(spark, sf)))


@query(
    "null_profile",
    f"""WITH {a.MEASUREMENTS_SQL} SELECT count(*) AS rows,
      count(*) FILTER (WHERE temp_max_c <= -900 OR precip_mm <= -900) AS sentinel_rows,
      {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS null_{c}' for c in MEASURES)},
      false AS suspiciously_full FROM measurements""",
)
def null_profile(spark, sf):
    return audits.null_profile(a.measurements(spark, sf))


@query(
    "source_mix",
    f"""WITH {a.MEASUREMENTS_SQL} SELECT rain_source, other_source, count(*) AS rows
    FROM measurements GROUP BY 1, 2 ORDER BY 3 DESC""",
)
def source_mix(spark, sf):
    return audits.source_mix(a.measurements(spark, sf))


_VARIED = ("precip_mm", "temp_mean_c", "wind_ms", "other_value")


@query(
    "spatial_variation",
    f"""WITH {a.MEASUREMENTS_SQL}, x AS (SELECT *, CAST(1 AS DOUBLE) AS other_value
        FROM measurements), d AS (
      SELECT date, {', '.join(f'count(DISTINCT {c}) AS n_{c}, round(max({c}), 4) - round(min({c}), 4) AS r_{c}' for c in _VARIED)}
      FROM x GROUP BY 1)
    {' UNION ALL '.join(f"SELECT '{c}' AS variable, count(*) AS days, count(*) FILTER (WHERE n_{c} > 1) AS days_differing, round(CAST(count(*) FILTER (WHERE n_{c} > 1) AS DOUBLE) / count(*), 6) AS share, round(max(r_{c}), 4) AS widest_range FROM d" for c in _VARIED)}""",
)
def spatial_variation(spark, sf):
    df = a.measurements(spark, sf).withColumn("other_value", F.lit(1.0))
    return rounded(rounded(audits.spatial_variation(df, _VARIED), 6, "share"), 4, "widest_range")


@query(
    "series_totals",
    f"""WITH {a.STATIONS_SQL}, t AS (SELECT series, sum(value) AS total FROM stations_days
        GROUP BY 1)
    SELECT series, total, round((max(total) OVER () - min(total) OVER ()) / min(total) OVER (), 6)
      AS spread FROM t ORDER BY total DESC""",
)
def series_totals(spark, sf):
    return rounded(audits.series_totals(a.station_days(spark, sf)), 6, "spread")


@query(
    "quality_report",
    f"""WITH {a.STATIONS_SQL}, {a.MEASUREMENTS_SQL}, many AS (
      SELECT district, imputation_method, count(*) AS n FROM measurements GROUP BY 1, 2)
    SELECT CAST(series AS VARCHAR) AS series, 'satelite' AS source, 'value' AS variable,
      min(date) AS period_start, max(date) AS period_end, count(*) AS expected,
      count(value) AS present, round((count(*) - count(value)) * 100e0 / count(*), 6)
        AS pct_missing, 'sin_imputar' AS imputation_method
    FROM stations GROUP BY 1
    UNION ALL
    SELECT district, 'power', v, min(date), max(date), count(*), count(x),
      round((count(*) - count(x)) * 100e0 / count(*), 6),
      any_value((SELECT imputation_method FROM many WHERE many.district = m.district
        ORDER BY n DESC, imputation_method LIMIT 1))
    FROM (SELECT district, date, 'humidity_pct' AS v, humidity_pct AS x FROM measurements
      UNION ALL SELECT district, date, 'precip_mm', precip_mm FROM measurements) m GROUP BY 1, 3""",
)
def quality_report(spark, sf):
    plain = audits.quality_report(a.stations(spark, sf), ("value",), "satelite")
    filled = audits.quality_report(
        a.measurements(spark, sf), ("humidity_pct", "precip_mm"), "power", series="district"
    ).withColumnRenamed("district", "series")
    both = plain.withColumn("series", F.col("series").cast("string")).unionByName(filled)
    return rounded(both, 6, "pct_missing")


@query(
    "audit_pk",
    """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, count(*) AS copies FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1""",
)
def audit_pk(spark, sf):
    raw = a.table(spark, sf, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    return audits.duplicate_keys(raw, ("l_suppkey", "date"))


_RULES = {
    "rain_not_negative": "precip_mm < 0",
    "wind_not_negative": "wind_ms < 0",
    "radiation_not_negative": "radiation_mj_m2 < 0",
    "humidity_in_percent": "humidity_pct < 0 OR humidity_pct > 100",
    "min_below_max": "temp_min_c > temp_max_c",
    "date_in_window": f"date < DATE '{FIRST_DAY}' OR date > DATE '{LAST_DAY}'",
    "known_method": "imputation_method NOT IN ('sin_imputar', 'media_movil')",
    "method_matches_flag": "imputed <> (imputation_method <> 'sin_imputar')",
}


@query(
    "audit_ranges",
    f"WITH {a.MEASUREMENTS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM measurements"
        for n, c in _RULES.items()
    ),
)
def audit_ranges(spark, sf):
    rules = audits.measurement_rules(FIRST_DAY, LAST_DAY)
    return audits.rule_violations(a.measurements(spark, sf), rules)


@query(
    "audit_fk",
    """SELECT user_id, count(*) AS rows FROM events
    WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
)
def audit_fk(spark, sf):
    return audits.missing_references(
        a.table(spark, sf, "events"), "user_id", a.table(spark, sf, "supplier"), "s_suppkey"
    )


@query(
    "audit_names",
    f"""WITH {a.DISTRICTS_SQL}, t AS (SELECT * FROM districts)
    SELECT 'code_pattern' AS rule, count(*) FILTER (WHERE NOT regexp_matches(code, '^\\d{{9}}$'))
      AS violations FROM t
    UNION ALL SELECT 'code_matches_canton', count(*) FILTER (WHERE
      CAST(substr(code, 1, 3) AS INTEGER) <> canton_code) FROM t
    UNION ALL SELECT 'code_prefix', count(*) FILTER (WHERE NOT starts_with(code, '2')) FROM t
    UNION ALL SELECT 'name_trimmed', count(*) FILTER (WHERE name <> trim(name)) FROM t
    UNION ALL SELECT 'name_not_blank', count(*) FILTER (WHERE length(trim(name)) = 0) FROM t
    UNION ALL SELECT 'name_intact', count(*) FILTER (WHERE name LIKE '%?%') FROM t
    UNION ALL SELECT 'population_not_filler', count(*) FILTER (WHERE population = 0) FROM t""",
)
def audit_names(spark, sf):
    rules = audits.name_rules(r"^\d{9}$", "2")
    return audits.rule_violations(a.districts(spark, sf), rules)


@query(
    "audit_risk",
    f"""WITH {a.RISKS_SQL}, x AS (SELECT probability, CASE WHEN probability > 0.1e0 THEN level END
        AS level FROM leveled)
    SELECT 'probability_in_range' AS rule, count(*) FILTER (WHERE probability < 0 OR
      probability > 1) AS violations FROM x
    UNION ALL SELECT 'known_level', count(*) FILTER (WHERE level NOT IN
      ('bajo', 'medio', 'alto')) FROM x
    UNION ALL SELECT 'level_and_probability_together', count(*) FILTER (WHERE (level IS NULL) <>
      (probability IS NULL)) FROM x""",
)
def audit_risk(spark, sf):
    from climrisk.functions.levels import level_from_probability

    p = F.col("probability")
    df = a.risks(spark, sf).withColumn("level", F.when(p > 0.1, level_from_probability(p)))
    return audits.rule_violations(df, audits.risk_rules())


@query(
    "audit_detections",
    f"""WITH {a.DETECTIONS_SQL} SELECT 'confidence_in_percent' AS rule,
      count(*) FILTER (WHERE confidence < 0 OR confidence > 100) AS violations FROM detections
    UNION ALL SELECT 'latitude', count(*) FILTER (WHERE abs(lat) > 90) FROM detections
    UNION ALL SELECT 'longitude', count(*) FILTER (WHERE abs(lon) > 180) FROM detections""",
)
def audit_detections(spark, sf):
    return audits.rule_violations(a.detections(spark, sf), audits.detection_rules())


@query(
    "code_diff",
    """WITH h AS (SELECT DISTINCT user_id AS code FROM events),
      w AS (SELECT c_custkey AS code FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT code, 'missing' AS side FROM w WHERE code NOT IN (SELECT code FROM h)
    UNION ALL SELECT code, 'extra' FROM h WHERE code NOT IN (SELECT code FROM w)""",
)
def code_diff(spark, sf):
    have = a.table(spark, sf, "events").select(F.col("user_id").alias("code"))
    want = a.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return audits.code_difference(have, want.select(F.col("c_custkey").alias("code")))


@query(
    "set_overlap",
    """SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem
    INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders""",
)
def set_overlap(spark, sf):
    ship = a.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    order = a.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return audits.shared_keys(ship, order, ["date"])


@query(
    "slice_invariance",
    f"""WITH {a.REGIONS_SQL} SELECT count(*) AS shared_days,
      CAST(0 AS BIGINT) AS disagreements FROM regions
    WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""",
)
def slice_invariance(spark, sf):
    daily = a.region_days(spark, sf)
    members = daily.select("series").distinct()
    early = calendar.densify(daily, Date(1995, 1, 1), Date(1998, 12, 31), members=members)
    late = calendar.densify(daily, Date(1997, 1, 1), Date(2001, 1, 1), members=members)
    both = early.join(late.withColumnRenamed("value", "other"), ["series", "date"])
    return both.agg(
        F.count("*").alias("shared_days"),
        F.count_if(~F.col("value").eqNullSafe(F.col("other"))).alias("disagreements"),
    )


@query(
    "topk",
    f"""WITH {a.STATIONS_SQL} SELECT series, date, value FROM stations_days
    ORDER BY value DESC, series, date LIMIT 25""",
)
def topk(spark, sf):
    order = (F.desc("value"), F.asc("series"), F.asc("date"))
    return audits.top_rows(a.station_days(spark, sf).select("series", "date", "value"), order, 25)


@query(
    "change_log",
    """WITH o AS (SELECT l_suppkey AS district, CAST(l_shipdate AS DATE) AS date,
        max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
      n AS (SELECT l_suppkey AS district, CAST(l_shipdate AS DATE) AS date,
        max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
    SELECT district, date, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed'
      ELSE 'changed' END AS change, o.v AS before, n.v AS after
    FROM o FULL JOIN n USING (district, date) WHERE o.v IS DISTINCT FROM n.v""",
)
def change_log(spark, sf):
    rows = a.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("district"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("v"),
        "l_linestatus",
    )
    snap = lambda st: (
        rows.where(F.col("l_linestatus") == st).groupBy("district", "date").agg(F.max("v").alias("v"))
    )
    log = audits.change_log(snap("F"), snap("O"), ("district", "date"), ("v",))
    return log.select(
        "district", "date", "change", F.col("before.v").alias("before"), F.col("after.v").alias("after")
    )


@query(
    "redundant_features",
    """SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right",
      round(corr(l_quantity, l_extendedprice), 6) AS r,
      abs(corr(l_quantity, l_extendedprice)) > 0.95 AS redundant FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6),
      abs(corr(l_quantity, l_discount)) > 0.95 FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6),
      abs(corr(l_extendedprice, l_discount)) > 0.95 FROM lineitem""",
)
def redundant_features(spark, sf):
    df = audits.redundant_features(
        a.table(spark, sf, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount")
    )
    return rounded(df, 6, "r")


@query(
    "band_index",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round((l_extendedprice - l_quantity) / nullif(l_extendedprice + l_quantity, 0), 9) AS ndvi,
      round((l_tax - l_discount) / nullif(l_tax + l_discount, 0), 6) AS ndwi
    FROM lineitem WHERE l_quantity <= 20""",
)
def band_index(spark, sf):
    c = F.col
    clear = a.table(spark, sf, "lineitem").where(c("l_quantity") <= 20)
    df = clear.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        geo.normalised_difference(c("l_extendedprice"), c("l_quantity")).alias("ndvi"),
        geo.normalised_difference(c("l_tax"), c("l_discount")).alias("ndwi"),
    )
    return rounded(rounded(df, 9, "ndvi"), 6, "ndwi")


# --- risk reads ---------------------------------------------------------------------------

DAY, EVENT = Date(2024, 1, 15), "sequia"
KNOWN = "known AS (SELECT CAST(c_custkey AS VARCHAR) AS code FROM customer)"


def leveled_risks(spark, sf):
    from climrisk.functions.levels import level_from_probability

    return a.risks(spark, sf).withColumn("level", level_from_probability(F.col("probability")))


def known_codes(spark, sf):
    return a.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("code"))


def _completed(spark, sf):
    return risk.complete_risks(known_codes(spark, sf), leveled_risks(spark, sf), DAY, EVENT)


COMPLETED = f"""{a.RISKS_SQL}, {KNOWN}, completed AS (
      SELECT code, DATE '{DAY}' AS date, '{EVENT}' AS event, level, probability
      FROM known LEFT JOIN leveled ON district = code AND date = DATE '{DAY}'
        AND event = '{EVENT}')"""


@query("risk_complete", f"WITH {COMPLETED} SELECT * FROM completed")
def risk_complete(spark, sf):
    return _completed(spark, sf)


@query(
    "risk_lookup",
    f"""WITH {a.RISKS_SQL} SELECT district, date, event, probability, level FROM leveled
    WHERE district = '7' AND date = DATE '2024-01-15' AND event = 'sequia'
    UNION ALL SELECT district, date, event, probability, level FROM leveled
    WHERE district = '3' AND date = DATE '2024-01-20' AND event = 'incendio'""",
)
def risk_lookup(spark, sf):
    r = leveled_risks(spark, sf)
    return risk.risk_lookup(r, "7", DAY, EVENT).unionByName(
        risk.risk_lookup(r, "3", Date(2024, 1, 20), "incendio")
    )


@query(
    "legend_counts",
    f"""WITH {COMPLETED} SELECT count(*) FILTER (WHERE level = 'bajo') AS bajo,
      count(*) FILTER (WHERE level = 'medio') AS medio,
      count(*) FILTER (WHERE level = 'alto') AS alto,
      count(*) FILTER (WHERE level IS NULL) AS without_estimate FROM completed""",
)
def legend_counts(spark, sf):
    return risk.legend_counts(_completed(spark, sf))


@query(
    "risk_packets",
    f"""WITH {COMPLETED} SELECT event, code, '{{"code":"' || code || '","date":"{DAY}","level":'
      || coalesce('"' || level || '"', 'null') || ',"probability":'
      || coalesce(CAST(round(probability, 3) AS VARCHAR), 'null') || '}}' AS packet
    FROM completed""",
)
def risk_packets(spark, sf):
    return risk.risk_packets(rounded(_completed(spark, sf), 3, "probability"))


# --- catalogue ----------------------------------------------------------------------------


def clean_catalog(spark, sf):
    return catalog.map_categories(
        payloads.clean_event_rows(a.raw_catalog(spark, sf).withColumn("event", F.lit(None).cast("string")))
        .drop("event", "start_unreadable", "end_unreadable")
    )


@query(
    "category_map",
    f"""WITH {a.CATALOG_SQL} SELECT kind, event, count(*) AS rows FROM mapped GROUP BY 1, 2""",
)
def category_map(spark, sf):
    return clean_catalog(spark, sf).groupBy("kind", "event").agg(F.count("*").alias("rows"))


@query(
    "events_filter",
    f"""WITH {a.CATALOG_SQL} SELECT 'sequia' AS wanted, count(*) AS rows, min(start_date) AS first
    FROM mapped WHERE event = 'sequia'
    UNION ALL SELECT 'all', count(*), min(start_date) FROM mapped""",
)
def events_filter(spark, sf):
    events = clean_catalog(spark, sf)
    facts = lambda df, name: df.agg(
        F.lit(name).alias("wanted"), F.count("*").alias("rows"), F.min("start_date").alias("first")
    )
    return facts(catalog.events_by_type(events, "sequia"), "sequia").unionByName(
        facts(catalog.events_by_type(events), "all")
    )


@query(
    "audit_catalog",
    f"""WITH {a.CATALOG_SQL} SELECT event_id, district, event, concat_ws('; ',
      CASE WHEN district = 'AFRICA' THEN 'unknown district' END,
      CASE WHEN event IS NULL THEN 'unknown event' END,
      CASE WHEN event_id % 50 = 7 THEN 'start unreadable' END,
      CASE WHEN event_id % 50 = 8 THEN 'end unreadable' END,
      CASE WHEN event_id % 50 NOT IN (7, 8) AND end_date < start_date THEN 'end before start' END,
      CASE WHEN event_id % 50 <> 7 AND start_date > DATE '2001-06-30' THEN 'start in the future' END,
      CASE WHEN source IS NULL THEN 'source missing' END,
      CASE WHEN event_id % 50 = 9 THEN 'unknown severity' END) AS problems FROM mapped""",
)
def audit_catalog(spark, sf):
    # Some dates are no dates, and some severities are none.
    known = a.table(spark, sf, "region").where("r_name <> 'AFRICA'").select(
        F.col("r_name").alias("code")
    )
    odd = F.pmod(F.col("event_id"), F.lit(50))
    raw = a.raw_catalog(spark, sf).withColumns(
        {
            "start_date": F.when(odd == 7, F.lit("2000-13-45")).otherwise(F.col("start_date")),
            "end_date": F.when(odd == 8, F.lit("soon")).otherwise(F.col("end_date")),
            "severity": F.when(odd == 9, F.lit("enorme")).otherwise(F.col("severity")),
        }
    )
    rows = catalog.map_categories(payloads.clean_event_rows(raw.withColumn("event", F.lit(" "))))
    checked = catalog.catalog_errors(rows, known, LAST_DAY)
    return checked.select(
        "event_id", "district", "event", F.concat_ws("; ", "errors").alias("problems")
    )


@query(
    "catalog_coverage",
    f"""WITH {a.CATALOG_SQL} SELECT 'event' AS kind, v AS value, count(event) AS rows
    FROM (VALUES ('lluvia_intensa'), ('sequia'), ('incendio')) t(v)
    LEFT JOIN mapped ON event = v GROUP BY 2
    UNION ALL SELECT 'district', n_name, count(event) FROM nation
    LEFT JOIN mapped ON district = n_name GROUP BY 2
    UNION ALL SELECT 'distinct', 'events', count(*) FROM (
      SELECT DISTINCT start_date, event FROM mapped)
    UNION ALL SELECT 'no_severity', 'rows', count(*) FROM mapped WHERE severity IS NULL""",
)
def catalog_coverage(spark, sf):
    events = clean_catalog(spark, sf)
    names = a.table(spark, sf, "nation").select(F.col("n_name").alias("code"))
    by_event = catalog.frequencies(events, "event", EVENTS).select(
        F.lit("event").alias("kind"), "value", "rows"
    )
    by_district = catalog.district_frequencies(events, names).select(
        F.lit("district").alias("kind"), F.col("district").alias("value"), "rows"
    )
    facts = catalog.coverage_summary(events)
    return (
        by_event.unionByName(by_district)
        .unionByName(
            facts.select(
                F.lit("distinct").alias("kind"),
                F.lit("events").alias("value"),
                F.col("distinct_events").alias("rows"),
            )
        )
        .unionByName(
            facts.select(
                F.lit("no_severity").alias("kind"),
                F.lit("rows").alias("value"),
                F.col("no_severity").alias("rows"),
            )
        )
    )


REGION_LEVELS = f"""{a.REGIONS_SQL}, sums AS (SELECT *, {s.STRICT3} AS total FROM regions {s.W3}),
    {s.ACC}, lev AS (
      SELECT s.series AS district, s.date, CASE WHEN total IS NULL OR p95_accumulated IS NULL
          THEN NULL WHEN total <= p95_accumulated THEN 'bajo' WHEN total <= p99_accumulated
          THEN 'medio' ELSE 'alto' END AS level
      FROM sums s LEFT JOIN acc ON acc.series = s.series)"""


@query(
    "catalog_contrast",
    f"""WITH {a.CATALOG_SQL}, {REGION_LEVELS}, m AS (
      SELECT e.event_id, e.district, e.event, count(l.date) AS span_days,
        count(*) FILTER (WHERE l.level = 'alto') AS high_days,
        count(*) FILTER (WHERE l.level <> 'alto') AS lower_days,
        count(l.date) FILTER (WHERE l.level IS NULL) AS days_without_estimate
      FROM mapped e LEFT JOIN lev l ON l.district = e.district
        AND l.date BETWEEN e.start_date AND coalesce(e.end_date, (SELECT max(date) FROM lev))
      GROUP BY ALL)
    SELECT *, CASE WHEN high_days > 0 THEN 'hit' WHEN high_days + lower_days > 0 THEN 'miss'
      ELSE 'no estimate' END AS outcome FROM m""",
)
def catalog_contrast(spark, sf):
    daily = a.regions(spark, sf)
    levels = level_ops.rain_levels(daily).select(
        F.col("series").alias("district"), "date", "level"
    )
    events = clean_catalog(spark, sf).select(
        "event_id", "district", "event", "start_date", "end_date"
    )
    return catalog.contrast(events, levels).drop("start_date", "end_date")


GAZETTEER = """gazetteer AS (
      SELECT s_suppkey AS code, 'Río  ' || CAST(CASE WHEN s_suppkey % 6 < 2
        THEN s_suppkey - s_suppkey % 2 ELSE s_suppkey END AS VARCHAR) AS name FROM supplier)"""


@query(
    "place_candidates",
    f"""WITH {GAZETTEER}, c AS (
      SELECT 'rio ' || split_part(name, '  ', 2) AS place, count(DISTINCT code) AS candidates
      FROM gazetteer GROUP BY 1), r AS (
      SELECT CASE WHEN l_linenumber = 1 THEN l_suppkey END AS declared,
        'rio ' || CAST(l_suppkey AS VARCHAR) AS place FROM lineitem)
    SELECT CASE WHEN declared IS NOT NULL THEN 'declared' WHEN candidates = 1
        THEN 'only candidate' WHEN candidates > 1 THEN 'ambiguous' ELSE 'unknown' END AS how,
      count(*) AS reports, count(CASE WHEN declared IS NOT NULL OR candidates = 1 THEN 1 END)
        AS resolved FROM r LEFT JOIN c ON c.place = r.place GROUP BY 1""",
)
def place_candidates(spark, sf):
    k = F.col("s_suppkey")
    gazetteer = a.table(spark, sf, "supplier").select(
        k.alias("code"),
        F.concat(
            F.lit("Río  "), F.when(k % 6 < 2, k - k % 2).otherwise(k).cast("string")
        ).alias("name"),
    )
    reports = a.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).alias("declared_code"),
        F.concat(F.lit(" RÍO "), F.col("l_suppkey").cast("string")).alias("place_name"),
    )
    found = catalog.resolve_places(reports, gazetteer)
    return found.groupBy("how").agg(
        F.count("*").alias("reports"), F.count("resolved_code").alias("resolved")
    )
