"""Payloads, catalogues, audits, risk reads, keyed tables and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climrisk import schemas
from climrisk.functions import levels
from climrisk.operators import audits, catalog, labels, merge, risk
from climrisk.sources import payloads, tables, versions
from climrisk.streaming import detections as stream
from tests.conftest import EPOCH

D = datetime.date


# --- payloads -------------------------------------------------------------------------------


def response(unit="C", fill=-999.0, drop=None):
    values = {p: {"20200101": 1.5, "20200102": fill} for p in schemas.REANALYSIS_COLUMNS if p != drop}
    return json.dumps(
        {
            "header": {"fill_value": fill},
            "geometry": {"coordinates": [-85.0, 10.5, 400.0]},
            "parameters": {
                p: {"units": unit if p == "T2M" else u} for p, u in schemas.REANALYSIS_UNITS.items()
            },
            "properties": {"parameter": values},
        }
    )


def test_reanalysis_files_become_daily_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(response(fill=-99.0))
    rows = payloads.read_reanalysis(spark, str(tmp_path)).orderBy("date").collect()
    assert [r.date for r in rows] == [D(2020, 1, 1), D(2020, 1, 2)]
    assert rows[0].temp_mean_c == 1.5 and rows[0].lon == -85.0
    assert rows[1].temp_mean_c is None, "the fill value of the header is a missing value"
    assert set(schemas.REANALYSIS_COLUMNS.values()) <= set(rows[0].asDict())


def test_wrong_units_and_missing_parameters_stop_the_load(spark, tmp_path):
    (tmp_path / "a.json").write_text(response(unit="K"))
    with pytest.raises(ValueError, match="unit"):
        payloads.read_reanalysis(spark, str(tmp_path))
    one = spark.createDataFrame([(response(drop="WS2M"),)], "payload string")
    with pytest.raises(Exception, match="lacks a parameter"):
        payloads.reanalysis_daily(payloads.parse_reanalysis(one)).collect()
    none = json.loads(response())
    none["parameters"].pop("RH2M")
    one = spark.createDataFrame([(json.dumps(none),)], "payload string")
    wrong = payloads.unit_mismatches(payloads.parse_reanalysis(one)).collect()
    assert [(r.parameter, r.declared) for r in wrong] == [("RH2M", None)]


def test_rain_rows(spark):
    data = [
        {"year": 2020, "month": 1, "day": 1, "value": {"avg": 3.5}},
        {"year": 2020, "month": 1, "day": 2, "value": {"avg": -9999}},
        {"year": 2020, "month": 1, "day": 3, "value": {"avg": None}},
        {"year": 2020, "month": 1, "day": 4, "value": 7, "raw_value": 2.0},
        {"year": 2020, "month": 1, "day": 5, "value": {"avg": 0}},
        {"year": 2020, "month": 1, "day": 6},
    ]
    df = spark.createDataFrame([(json.dumps({"data": data}),)], "payload string")
    got = [r.value for r in payloads.rain_rows(df).orderBy("date").collect()]
    assert got == [3.5, None, None, 2.0, 0.0, None]
    bad = json.dumps({"data": [{"year": 2020, "month": 13, "day": 1, "value": {"avg": 1}}]})
    with pytest.raises(Exception, match="usable date"):
        payloads.rain_rows(spark.createDataFrame([(bad,)], "payload string")).collect()
    gone = json.dumps({"data": [{"year": 2020, "value": {"avg": 1}}]})
    with pytest.raises(Exception, match="usable date"):
        payloads.rain_rows(spark.createDataFrame([(gone,)], "payload string")).collect()


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [
        {"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"CÓDIGO_DTA": 10101, "CÓDIGO": 9, "DISTRITO": " Río Seco "}},
        {"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, "properties": {"CÓDIGO_DTA": "10102", "DISTRITO": "  "}},
        {"geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {}},
    ]
    (tmp_path / "d.geojson").write_text(json.dumps({"features": features}), encoding="utf-8")
    rows = payloads.read_geojson(spark, str(tmp_path)).orderBy("code").collect()
    assert [(r.code, r.name, len(r.geometry)) for r in rows] == [("10101", "Río Seco", 1), ("10102", None, 2)]
    assert rows[0].geometry[0][0][1].lon == 1.0
    (tmp_path / "lines").mkdir()
    lines = "\n".join(json.dumps(f) for f in features)
    (tmp_path / "lines" / "d.geojsonl").write_text(lines, encoding="utf-8")
    same = payloads.read_geojson(spark, str(tmp_path / "lines"), per_line=True)
    assert sorted(r.code for r in same.collect()) == ["10101", "10102"]


def test_event_and_measurement_csv(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(
        "district,event,start_date,end_date,severity,source,description\n"
        ' 10101 ,sequia,2001-02-03,, ,prensa,"a, b"\n'
        "10102,incendio,2001-13-03,2001-01-01,alto,,\n",
        encoding="utf-8",
    )
    rows = payloads.read_events_csv(spark, str(path)).orderBy("district").collect()
    assert rows[0].district == "10101" and rows[0].start_date == D(2001, 2, 3)
    assert rows[0].end_date is None and rows[0].severity is None and rows[0].description == "a, b"
    assert rows[1].start_date is None and rows[1].source is None
    path = tmp_path / "m.csv"
    path.write_text("series,date,value\nx,2001-01-01,1.5\nx,2001-01-02,\n")
    rows = payloads.read_measurements_csv(spark, str(path)).orderBy("date").collect()
    assert [r.value for r in rows] == [1.5, None]


def test_detections_filter_is_pushed_to_the_scan(spark, tmp_path):
    rows = [(D(2020, 1, i), float(i), 10.0) for i in range(1, 9)]
    spark.createDataFrame(rows, "date date, lon double, lat double").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    out = payloads.detections_in(df, D(2020, 1, 2), D(2020, 1, 6), 3.0, 9.0, 9.0, 11.0)
    assert out.count() == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2020-01-02)" in plan and "IsNotNull(lat)" in plan


# --- catalogue ------------------------------------------------------------------------------

EVENT = "district string, event string, start_date date, end_date date, severity string, source string"


def test_categories(spark):
    rows = [("FLOOD", None), ("LANDSLIDE", "Fuertes lluvias"), ("LANDSLIDE", "Epicentro"), ("LANDSLIDE", None), ("FIRE", "x"), ("FORESTFIRE", None), ("DROUGHT", None)]
    df = catalog.map_categories(spark.createDataFrame(rows, "kind string, description string"))
    got = [r.event for r in df.collect()]
    assert got == ["lluvia_intensa", "lluvia_intensa", None, None, None, "incendio", "sequia"]


def test_catalogue_rules_and_quarantine(spark):
    rows = [
        ("a", "sequia", D(2001, 1, 1), None, None, "x"),
        ("b", "sequia", D(2001, 1, 1), D(2000, 1, 1), None, "x"),
        ("zz", "terremoto", D(2001, 1, 1), None, "grave", " "),
        ("a", None, None, None, None, None),
        ("a", "sequia", D(2050, 1, 1), None, "alto", "x"),
    ]
    known = spark.createDataFrame([("a",), ("b",)], "code string")
    checked = catalog.catalog_errors(spark.createDataFrame(rows, EVENT), known, D(2024, 1, 1))
    got = sorted((r.errors for r in checked.collect()), key=len)
    assert [] in got and ["end before start"] in got and ["start in the future"] in got
    assert ["unknown district", "unknown event", "source missing", "unknown severity"] in got
    assert ["unknown event", "start missing", "source missing"] in got
    valid, bad = catalog.split_catalog(checked)
    assert (valid.count(), bad.count()) == (1, 4)


def test_catalogue_coverage(spark):
    rows = [("a", "sequia", D(2001, 1, 1), None, None, "x"), ("b", "sequia", D(2001, 1, 1), None, "alto", "x")]
    df = spark.createDataFrame(rows, EVENT)
    got = {r.value: r.rows for r in catalog.frequencies(df, "event", schemas.EVENTS).collect()}
    assert got == {"lluvia_intensa": 0, "sequia": 2, "incendio": 0}
    s = catalog.coverage_summary(df).first()
    assert (s["rows"], s.no_severity, s.distinct_events, s.enough) == (2, 1, 1, False)
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    by = {r.district: r["rows"] for r in catalog.district_frequencies(df, known).collect()}
    assert by == {"a": 1, "b": 1, "c": 0}
    assert catalog.events_by_type(df, "incendio").count() == 0 and catalog.events_by_type(df).count() == 2


def test_contrast_counts_days_without_expanding_spans(spark):
    levels_ = ["bajo", "alto", None, "alto", "medio", "bajo", None, None]
    days = [("a", EPOCH + datetime.timedelta(days=i), v) for i, v in enumerate(levels_)]
    daily = spark.createDataFrame(days, "district string, date date, level string")
    at = lambda i: EPOCH + datetime.timedelta(days=i)
    spans = [(1, "a", 0, 2), (2, "a", 4, 5), (3, "a", 6, 7), (4, "a", 3, None), (5, "a", -9, 1), (6, "a", 50, 60), (7, "ghost", 0, 3)]
    events = spark.createDataFrame(
        [(i, d, at(s), None if e is None else at(e)) for i, d, s, e in spans],
        "id int, district string, start_date date, end_date date",
    )
    got = {r.id: r for r in catalog.contrast(events, daily).collect()}
    facts = {i: (r.span_days, r.high_days, r.lower_days, r.days_without_estimate, r.outcome) for i, r in got.items()}
    assert facts[1] == (3, 1, 1, 1, "hit")
    assert facts[2] == (2, 0, 2, 0, "miss")
    assert facts[3] == (2, 0, 0, 2, "no estimate")
    assert facts[4] == (5, 1, 2, 2, "hit")
    assert facts[5] == (2, 1, 1, 0, "hit")
    assert facts[6][:1] == (0,) and facts[6][4] == "no estimate"
    assert facts[7][4] == "no estimate"


def test_places_with_several_candidates_stay_open(spark):
    gaz = spark.createDataFrame([("1", "Río Chiquito"), ("2", "rio  chiquito"), ("3", "Arenal")], "code string, name string")
    reports = spark.createDataFrame(
        [("RIO CHIQUITO", None), ("Río chiquito", "2"), (" arenal ", None), ("Nowhere", None)],
        "place_name string, declared_code string",
    )
    got = [(r.how, r.resolved_code, r.candidates) for r in catalog.resolve_places(reports, gaz).orderBy("how", "declared_code").collect()]
    assert sorted(got, key=str) == sorted(
        [("ambiguous", None, 2), ("declared", "2", 2), ("only candidate", "3", 1), ("unknown", None, 0)], key=str
    )
    assert catalog.place_candidates(gaz).where("candidates = 2").count() == 2


# --- audits ---------------------------------------------------------------------------------


def measurement(spark, **changes):
    base = {f.name: None for f in schemas.MEASUREMENT}
    base |= {"district": "a", "date": EPOCH, "imputed": False, "imputation_method": "sin_imputar", "rain_source": "chirps", "other_source": "power"}
    return spark.createDataFrame([tuple((base | changes).values())], schemas.MEASUREMENT)


def test_measurement_rules(spark):
    rules = audits.measurement_rules(D(1991, 1, 1), D(2025, 12, 31))
    broken = lambda **c: {
        r.rule for r in audits.rule_violations(measurement(spark, **c), rules).where("violations > 0").collect()
    }
    assert broken() == set(), "missing values pass every rule"
    assert broken(precip_mm=-0.1) == {"rain_not_negative"}
    assert broken(temp_min_c=5.0, temp_max_c=4.0) == {"min_below_max"}
    assert broken(humidity_pct=100.5) == {"humidity_in_percent"}
    assert broken(date=D(1990, 12, 31)) == {"date_in_window"}
    assert broken(imputation_method="otro", imputed=True) == {"known_method"}
    assert broken(imputed=True) == {"method_matches_flag"}
    assert schemas.conformance(measurement(spark), schemas.MEASUREMENT) == []
    assert schemas.conformance(measurement(spark).drop("date"), schemas.MEASUREMENT) == ["missing column date"]


def test_keys_references_and_sets(spark, daily):
    df = daily(a=[1, 2]).unionByName(daily(a=[9]))
    assert audits.duplicate_keys(df, ("series", "date")).first().copies == 2
    parent = spark.createDataFrame([("a",), ("c",)], "code string")
    child = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "d string")
    assert [tuple(r) for r in audits.missing_references(child, "d", parent, "code").collect()] == [("b", 2)]
    have = spark.createDataFrame([("a",), ("b",)], "code string")
    got = sorted(tuple(r) for r in audits.code_difference(have, parent).collect())
    assert got == [("b", "extra"), ("c", "missing")]
    a, b = daily(a=[1, None, 3]), daily(a=[1, None, 4])
    assert audits.disagreeing_rows(a, b, ("series", "date")).count() == 1
    assert audits.shared_keys(a, b, ["date"]).count() == 3


def test_names(spark):
    rows = [("10101", 101, "Uno", None), ("10201", 101, " Dos", 0), ("1010", 101, "Tr?s", 5)]
    df = spark.createDataFrame(rows, "code string, canton_code int, name string, population int")
    got = {r.rule: r.violations for r in audits.rule_violations(df, audits.name_rules(prefix="101")).collect()}
    assert got == {
        "code_pattern": 1,
        "code_matches_canton": 1,
        "code_prefix": 1,
        "name_trimmed": 1,
        "name_not_blank": 0,
        "name_intact": 1,
        "population_not_filler": 1,
    }
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "canton_code int, name string")
    assert audits.repeated_names(twice, "canton_code").count() == 1


def test_completeness_and_profiles(spark, daily):
    df = daily(a=[1, None, 3], b=[1, 1, 1]).where("value IS NOT NULL")
    got = {r.series: (r["rows"], r.calendar_days, r.complete) for r in audits.completeness(df).collect()}
    assert got == {"a": (2, 3, False), "b": (3, 3, True)}
    whole = audits.window_bounds(audits.completeness(df)).first()
    assert (whole["rows"], whole.incomplete_series) == (5, 1)
    full = measurement(spark, **{c: 1.0 for c in schemas.MEASURES})
    assert audits.null_profile(full).first().suspiciously_full
    fill = audits.null_profile(measurement(spark, precip_mm=-999.0)).first()
    assert fill.sentinel_rows == 1 and fill.null_wind_ms == 1 and not fill.suspiciously_full


def test_spatial_variation(daily):
    df = daily(a=[1, 2, 3], b=[1, 5, None]).withColumn("same", F.lit(4.0))
    got = {r.variable: r for r in audits.spatial_variation(df, ("value", "same")).collect()}
    assert (got["value"].days_differing, got["value"].days, got["value"].widest_range) == (1, 3, 3.0)
    assert got["same"].days_differing == 0
    totals = audits.series_totals(df).collect()
    assert [(r.series, r.total) for r in totals] == [("a", 6.0), ("b", 6.0)]


def test_quality_report(daily):
    r = audits.quality_report(daily(a=[1, None, None, 4]), ("value",), "chirps").first()
    assert (r.expected, r.present, r.pct_missing, r.imputation_method) == (4, 2, 50.0, "sin_imputar")


def test_change_log_knows_null_from_absent(spark):
    schema = "k int, v double"
    old = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 4.0)], schema)
    new = spark.createDataFrame([(1, 1.0), (2, None), (3, 9.0), (5, None)], schema)
    got = sorted((r.k, r.change) for r in audits.change_log(old, new, ("k",), ("v",)).collect())
    assert got == [(3, "changed"), (4, "removed"), (5, "added")]


# --- risk reads -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def risks(spark):
    day = D(2024, 1, 1)
    rows = [("a", day, "sequia", "alto", 0.9), ("b", day, "incendio", "bajo", 0.1)]
    return spark.createDataFrame(rows, "district string, date date, event string, level string, probability double")


def test_completion_keeps_missing_risks_null(spark, risks):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    done = risk.complete_risks(known, risks, D(2024, 1, 1), "sequia")
    got = {r.code: (r.level, r.probability) for r in done.collect()}
    assert got == {"a": ("alto", 0.9), "b": (None, None), "c": (None, None)}
    legend = risk.legend_counts(done).first()
    assert (legend.alto, legend.bajo, legend.without_estimate) == (1, 0, 2)
    assert risk.risk_lookup(risks, "b", D(2024, 1, 1), "sequia").count() == 0
    packet = {r.code: json.loads(r.packet) for r in risk.risk_packets(done).collect()}
    assert packet["c"] == {"code": "c", "date": "2024-01-01", "level": None, "probability": None}


def test_risk_and_detection_rules(spark):
    rows = [("alto", 0.5), (None, 0.2), ("raro", 0.5), ("bajo", 1.5), (None, None)]
    df = spark.createDataFrame(rows, "level string, probability double")
    got = {r.rule: r.violations for r in audits.rule_violations(df, audits.risk_rules()).collect()}
    assert got == {"probability_in_range": 1, "known_level": 1, "level_and_probability_together": 1}
    spots = spark.createDataFrame([(101, 0.0, 0.0), (None, 91.0, -181.0)], "confidence int, lat double, lon double")
    got = {r.rule: r.violations for r in audits.rule_violations(spots, audits.detection_rules()).collect()}
    assert got == {"confidence_in_percent": 1, "latitude": 1, "longitude": 1}


def test_geojson_export_round_trip(spark):
    geometry = [[[{"lon": 0.5, "lat": 1.0}, {"lon": 2.0, "lat": 1.0}, {"lon": 0.5, "lat": 1.0}]]]
    df = spark.createDataFrame(
        [("x", geometry), ("y", [])], f"code string, geometry {schemas.MULTIPOLYGON.simpleString()}"
    )
    out = risk.geojson_features(df, (F.col("code"), F.lit(None).cast("int").alias("population")))
    first = json.loads(out.where("code = 'x'").first().feature)
    assert first["properties"] == {"code": "x", "population": None}
    assert first["geometry"]["coordinates"][0][0][1] == [2.0, 1.0]
    known = spark.createDataFrame([("x",), ("y",), ("z",)], "code string")
    got = sorted(tuple(r) for r in risk.export_coverage(out, known).collect())
    assert got == [("y", "no coordinates"), ("z", "missing")]


def test_series_export_keeps_gaps(daily):
    row = risk.series_export(daily(a=[1, None, 3]), "value", "mm").first()
    assert [p.value for p in row.points] == [1.0, None, 3.0] and row.unit == "mm"


# --- keyed tables ---------------------------------------------------------------------------


def deliveries(spark, rows):
    schema = "district string, date date, precip_mm double, downloaded_at timestamp"
    return spark.createDataFrame(rows, schema)


def when(h):
    return datetime.datetime(2024, 1, 1, h)


def test_latest_wins_and_new_wins_ties(spark):
    old = deliveries(spark, [("a", EPOCH, 1.0, when(5)), ("b", EPOCH, 1.0, when(5))])
    new = deliveries(spark, [("a", EPOCH, 2.0, when(5)), ("b", EPOCH, 2.0, when(4)), ("c", EPOCH, None, when(1))])
    got = {r.district: r.precip_mm for r in merge.latest_by_key(old, new, ("district", "date")).collect()}
    assert got == {"a": 2.0, "b": 1.0, "c": None}


def test_upsert_is_idempotent_and_touches_only_its_years(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = deliveries(spark, [("a", D(2001, 1, 1), 1.0, when(1)), ("a", D(2002, 1, 1), 1.0, when(1))])
    keys = ("district", "date")
    assert versions.upsert_by_year(spark, path, first, keys) == 2
    old = versions.manifest(spark, path)["years"]["2001"]
    more = deliveries(spark, [("a", D(2002, 1, 1), 7.0, when(2)), ("b", D(2002, 1, 2), 3.0, when(2))])
    for _ in range(2):
        versions.upsert_by_year(spark, path, more, keys)
    rows = {(r.district, r.date): r.precip_mm for r in versions.read_years(spark, path).collect()}
    assert rows == {("a", D(2001, 1, 1)): 1.0, ("a", D(2002, 1, 1)): 7.0, ("b", D(2002, 1, 2)): 3.0}
    assert old == versions.manifest(spark, path)["years"]["2001"]
    plan = versions.read_years(spark, path).where("year = 2001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert {r.precip_mm for r in versions.read_years(spark, path, 1).collect()} == {1.0}


def test_all_years_of_a_load_appear_together(spark, tmp_path, monkeypatch):
    """A load over several years that fails before or while it is committed leaves the old table whole."""
    path, keys = f"{tmp_path}/t", ("district", "date")
    versions.upsert_by_year(spark, path, deliveries(spark, [("a", D(y, 1, 1), float(y), when(1)) for y in (2001, 2002, 2003)]), keys)
    held = lambda: {r.date.year: r.precip_mm for r in versions.read_years(spark, path).collect()}
    before = held()
    more = deliveries(spark, [("a", D(y, 1, 1), -1.0, when(2)) for y in (2001, 2003, 2004)])

    def broken(*_):
        raise OSError("the store went away")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_commit", broken)
        with pytest.raises(OSError):
            versions.upsert_by_year(spark, path, more, keys)
    assert held() == before and versions.versions(spark, path) == [1]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1, "folders of the failed load are gone"
    seen = []
    versions.upsert_by_year(spark, path, more, keys, validate=lambda df: seen.append((df.count(), held())))
    assert seen == [(3, before)], "readers see the old table until the load is whole"
    assert held() == {2001: -1.0, 2002: 2002.0, 2003: -1.0, 2004: -1.0}


def test_writers_that_start_from_one_version_cannot_both_win(spark, tmp_path):
    path, keys = f"{tmp_path}/t", ("district", "date")
    versions.upsert_by_year(spark, path, deliveries(spark, [("a", EPOCH, 1.0, when(1))]), keys)

    def overtake(_):
        versions.upsert_by_year(spark, path, deliveries(spark, [("b", EPOCH, 5.0, when(2))]), keys)

    with pytest.raises(versions.WriteConflict):
        versions.upsert_by_year(spark, path, deliveries(spark, [("a", EPOCH, 2.0, when(2))]), keys, validate=overtake)
    assert {(r.district, r.precip_mm) for r in versions.read_years(spark, path).collect()} == {("a", 1.0), ("b", 5.0)}


def test_claims_of_dead_writers_expire(spark, tmp_path, monkeypatch):
    path, keys = f"{tmp_path}/t", ("district", "date")
    versions.upsert_by_year(spark, path, deliveries(spark, [("a", EPOCH, 1.0, when(1))]), keys)
    (tmp_path / "t" / "manifest" / "v0000000002.claim").touch()
    load = lambda: versions.upsert_by_year(spark, path, deliveries(spark, [("a", EPOCH, 2.0, when(2))]), keys)
    with pytest.raises(versions.WriteConflict):
        load()
    monkeypatch.setattr(versions, "STALE_SECONDS", -1)
    assert load() == 1 and versions.versions(spark, path) == [1, 2]


def test_old_versions_are_cleared_by_a_call(spark, tmp_path):
    path, keys = f"{tmp_path}/t", ("district", "date")
    for k in range(4):
        versions.upsert_by_year(spark, path, deliveries(spark, [("a", D(2001 + k % 2, 1, 1), float(k), when(k))]), keys)
    assert versions.versions(spark, path) == [1, 2, 3, 4]
    assert versions.clear_versions(spark, path, keep=2) == 2
    assert versions.versions(spark, path) == [3, 4] and len(list((tmp_path / "t" / "data").iterdir())) == 3
    assert {r.precip_mm for r in versions.read_years(spark, path).collect()} == {2.0, 3.0}
    assert {r.precip_mm for r in versions.read_years(spark, path, 3).collect()} == {1.0, 2.0}
    with pytest.raises(FileNotFoundError):
        versions.read_years(spark, path, 2)
    with pytest.raises(ValueError):
        versions.clear_versions(spark, path, keep=0)


def test_replayed_batches_change_nothing(spark, tmp_path):
    path, keys = f"{tmp_path}/t", ("district", "date")
    row = lambda v, k: deliveries(spark, [("a", EPOCH, v, when(k))])
    assert versions.upsert_by_year(spark, path, row(1.0, 1), keys, batch=("s", 0)) == 1
    # Equal times: a plain replay would win the tie again; the ledger keeps it out.
    assert versions.upsert_by_year(spark, path, row(9.0, 1), keys, batch=("other", 0)) == 1
    assert versions.upsert_by_year(spark, path, row(1.0, 1), keys, batch=("s", 0)) == 0
    assert versions.upsert_by_year(spark, path, row(1.0, 1).limit(0), keys, batch=("s", 1)) == 0
    assert [r.precip_mm for r in versions.read_years(spark, path).collect()] == [9.0]
    assert versions.manifest(spark, path)["batches"] == {"s": 1, "other": 0} and versions.versions(spark, path) == [1, 2, 3]


def test_failed_validation_leaves_the_target_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    keys = ("district", "date")
    versions.upsert_by_year(spark, path, deliveries(spark, [("a", EPOCH, 1.0, when(1))]), keys)

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        versions.upsert_by_year(spark, path, deliveries(spark, [("a", EPOCH, 9.0, when(2))]), keys, validate=refuse)
    assert [r.precip_mm for r in versions.read_years(spark, path).collect()] == [1.0]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1, "what was refused is gone"


@pytest.mark.parametrize("entity", ["risk", "model_metrics", "quality_report", "province"])
def test_small_tables_upsert_by_their_own_key(spark, tmp_path, entity):
    schema = getattr(schemas, entity.upper())
    stamped = T.StructType([*schema, T.StructField("updated_at", T.IntegerType())])
    sample = {"string": "x", "date": EPOCH, "double": 0.5, "smallint": 3, "bigint": 4}
    values = [sample.get(f.dataType.simpleString()) for f in schema]
    path = f"{tmp_path}/{entity}"
    with pytest.raises(FileNotFoundError):
        tables.read_whole(spark, path)
    for stamp in (1, 3, 2):
        df = spark.createDataFrame([(*values, stamp)], stamped)
        tables.upsert_whole(spark, path, df, schemas.KEYS[entity])
    assert [r.updated_at for r in tables.read_whole(spark, path).collect()] == [3]


def test_intermediate_tables_go_to_the_shared_folder(spark, daily):
    folder = spark.conf.get("spark.checkpoint.dir")
    df = daily(a=[1, None, 3])
    out = tables.materialise(df)
    assert out.inputFiles() and all(folder in f for f in out.inputFiles())
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_digest_ignores_order_and_sees_changes(spark):
    rows = [(i, float(i), None if i == 2 else "x", [i]) for i in range(20)]
    schema = "a int, b double, c string, d array<int>"
    df = spark.createDataFrame(rows, schema)
    same = spark.createDataFrame(rows[::-1], schema).repartition(5)
    digest = lambda x: tables.table_digest(x).first().digest
    assert digest(df) == digest(same)
    assert digest(df) != digest(df.withColumn("c", F.coalesce("c", F.lit(""))))
    assert digest(df) != digest(df.where("a > 0"))


def test_snapshot_is_stored_under_its_digest(spark, daily, tmp_path):
    df = daily(a=[1, None, 3])
    one = tables.write_snapshot(spark, df, str(tmp_path / "s"))
    two = tables.write_snapshot(spark, df.repartition(3), str(tmp_path / "s"))
    assert one == two and one["rows"] == 3 and one["first_day"] == EPOCH
    assert spark.read.parquet(one["path"]).count() == 3
    assert spark.read.json(f"{tmp_path}/s/_manifest").count() == 1


# --- streams --------------------------------------------------------------------------------


def test_stream_upsert_equals_batch(spark, tmp_path):
    rows = [("a", EPOCH, 1.0, when(1)), ("b", EPOCH, 2.0, when(1)), ("a", EPOCH, 5.0, when(3)), ("b", EPOCH, 0.0, when(0))]
    schema = deliveries(spark, rows).schema
    for i, row in enumerate(rows):
        deliveries(spark, [row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = stream.read_stream(spark, f"{tmp_path}/in", schema, per_trigger=1)
    writer = stream.upsert_stream(source, f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp")
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    batch = merge.latest_by_key(None, deliveries(spark, rows), ("district", "date"))
    got = versions.read_years(spark, f"{tmp_path}/out").select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("committed", [False, True])
def test_stream_killed_around_its_commit_replays_to_the_same_table(spark, tmp_path, monkeypatch, committed):
    """The second batch dies before or after its commit; the restart gives the rows of the batch rule."""
    rows = [("a", EPOCH, 1.0, when(1)), ("a", D(2002, 3, 1), 2.0, when(1)), ("b", EPOCH, 5.0, when(3))]
    schema = deliveries(spark, rows).schema
    for row in rows:
        deliveries(spark, [row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    commit, calls = versions._commit, []

    def dying(spark_, path, state):
        calls.append(state["version"])
        if len(calls) == 2 and not committed:
            raise OSError("killed")
        commit(spark_, path, state)
        if len(calls) == 2:
            raise OSError("killed")

    def run():
        source = stream.read_stream(spark, f"{tmp_path}/in", schema, per_trigger=1)
        writer = stream.upsert_stream(source, f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp")
        return writer.trigger(availableNow=True).start().awaitTermination(120)

    monkeypatch.setattr(versions, "_commit", dying)
    with pytest.raises(Exception, match="killed"):
        run()
    assert run()
    got = versions.read_years(spark, f"{tmp_path}/out").drop("year")
    batch = merge.latest_by_key(None, deliveries(spark, rows), ("district", "date")).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert versions.versions(spark, f"{tmp_path}/out") == [1, 2, 3]


def test_stream_windows_equal_batch_on_closed_windows(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1, 6)
    rows = [(i, f"d{i % 2}", base + datetime.timedelta(hours=9 * i)) for i in range(60)]
    schema = "detection_id int, district string, ts timestamp"
    df = spark.createDataFrame(rows + rows[:10], schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    counts = stream.sliding_counts(source.dropDuplicates(["detection_id", "ts"]))
    query = counts.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.district, r.date): r.n for r in spark.table("win").collect()}
    daily = (
        spark.createDataFrame(rows, schema)
        .groupBy(F.col("district").alias("series"), F.to_date("ts").alias("date"))
        .agg(F.count("*").alias("detections"))
    )
    batch = labels.trailing_counts(daily).collect()
    assert len(batch) > 30
    for r in batch:
        assert got[r.series, r.date] == r.n


def test_stream_drops_late_repeats(spark, tmp_path):
    ts = datetime.datetime(2024, 1, 1, 6)
    df = spark.createDataFrame([(1, ts), (1, ts), (2, ts)], "detection_id int, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = stream.distinct_detections(source).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_severity_round_trip(spark):
    df = spark.createDataFrame([("bajo",), ("medio",), ("alto",), (None,)], "l string")
    out = df.select(levels.level_name(levels.severity(F.col("l"))).alias("b"), "l").collect()
    assert all(r.b == r.l for r in out)


def test_digest_tells_careless_texts_apart(spark):
    digest = lambda rows: tables.table_digest(spark.createDataFrame(rows, "a string, b string, v double")).first().digest
    seen = [
        digest([("a|b", "c", 1.0)]),
        digest([("a", "b|c", 1.0)]),
        digest([("a", "b|c", 1.0000000001)]),
        digest([(None, "c", 1.0)]),
        digest([("\\N", "c", 1.0)]),
        digest([("N", "c", 1.0)]),
        digest([(None, "c", 1.0)] * 2),
    ]
    assert len(set(seen)) == len(seen)


def test_snapshot_keeps_every_version(spark, daily, tmp_path):
    root = str(tmp_path / "versions")
    one = tables.write_snapshot(spark, daily(a=[1.0]), root)
    two = tables.write_snapshot(spark, daily(a=[1.0000001]), root)
    assert one["path"] != two["path"]
    assert spark.read.parquet(two["path"]).first().value == 1.0000001
    assert not list((tmp_path / "versions" / "_draft").glob("*"))


def test_upsert_refuses_rows_without_key_or_date(spark, tmp_path):
    path = str(tmp_path / "keyed")
    keys = ["district", "date"]
    versions.upsert_by_year(spark, path, deliveries(spark, [("a", EPOCH, 1.0, when(1))]), keys)
    for row in ((None, EPOCH, 2.0, when(2)), ("a", None, 2.0, when(2))):
        with pytest.raises(ValueError, match="NULL"):
            versions.upsert_by_year(spark, path, deliveries(spark, [row]), keys)
    assert [r.precip_mm for r in versions.read_years(spark, path).collect()] == [1.0]


def test_unreadable_dates_are_not_absent_ones(spark):
    columns = ["district", "event", "start_date", "end_date", "severity", "source", "description"]
    rows = [("a", "sequia", "2000-13-45", "2000-02-03", None, "s", None), ("a", "sequia", "2000-01-01", "soon", None, "s", None), ("a", "sequia", "2000-01-01", " ", None, "s", None)]
    clean = payloads.clean_event_rows(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)))
    checked = catalog.catalog_errors(clean, spark.createDataFrame([("a",)], "code string"), "2020-01-01")
    assert sorted(tuple(r.errors) for r in checked.collect()) == [(), ("end unreadable",), ("start unreadable",)]


def test_long_climate_payloads_are_parsed_in_linear_time(spark):
    import time

    days = [(EPOCH + datetime.timedelta(days=i)).strftime("%Y%m%d") for i in range(12_784)]
    doc = {
        "header": {"fill_value": -999.0},
        "parameters": {p: {"units": u} for p, u in schemas.REANALYSIS_UNITS.items()},
        "properties": {"parameter": {p: {d: float(i % 40) for i, d in enumerate(days)} for p in schemas.REANALYSIS_UNITS}},
    }
    one = spark.createDataFrame([(json.dumps(doc),)], "payload string")
    read = lambda: payloads.reanalysis_daily(payloads.parse_reanalysis(one)).count()
    assert read() == len(days)
    began = time.time()
    read()
    assert time.time() - began < 10  # 18 s and more when each day was looked up in a map


def test_source_cells_are_shared_and_never_fill_each_other(spark):
    """Two territories of one cell get equal coarse values; rain and coarse variables stay apart."""
    places = spark.createDataFrame([("a", -84.0, 10.0), ("b", -83.9, 10.1), ("c", -80.0, 10.0), ("d", None, None)], "series string, lon double, lat double")
    cells = {r.series: (r.cell_x, r.cell_y, r.cell_lon, r.cell_lat) for r in merge.source_cells(places).collect()}
    assert cells["a"] == cells["b"] != cells["c"] and cells["a"][2:] == (-83.75, 10.0)
    days = [EPOCH + datetime.timedelta(days=k) for k in range(3)]
    x, y = cells["a"][:2]
    coarse = spark.createDataFrame([(x, y, days[0], 30.0), (x, y, days[2], 32.0), (1, 1, days[1], 99.0)], "cell_x int, cell_y int, date date, temp_max_c double")
    rain = spark.createDataFrame([("a", days[1], 5.0), ("c", days[0], 7.0)], "series string, date date, value double")
    got = {(r.series, r.date): (r.value, r.temp_max_c) for r in merge.source_cell_merge(places, coarse, rain, days[0], days[2]).collect()}
    temps = (30.0, None, 32.0)
    want = {(s, d): (None, temps[k] if s in "ab" else None) for s in "abcd" for k, d in enumerate(days)}
    want |= {("a", days[1]): (5.0, None), ("c", days[0]): (7.0, None)}
    assert got == want
    with pytest.raises(Exception, match="two rows for cell"):
        merge.source_cell_merge(places, coarse.union(coarse), rain, days[0], days[2]).collect()
