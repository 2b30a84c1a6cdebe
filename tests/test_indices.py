"""Thresholds, precipitation index, anomalies and spectra."""

import datetime
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from climrisk.functions import special
from climrisk.operators import indices, spectrum, spi, thresholds
from climrisk.schemas import DERIVED_INDEX, conformance

D = datetime.date


def months(spark, values, start=1990, series="s"):
    rows = [
        (series, D(start + i // 12, i % 12 + 1, 1), None if v is None else float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "series string, month_start date, total double")


def series_of(df, name, order="month_start"):
    return [r[name] for r in df.orderBy(order).collect()]


# --- thresholds -----------------------------------------------------------------------------


def test_percentile_is_linear_interpolation(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert df.agg(F.percentile("v", 0.5)).first()[0] == 2.5
    one = spark.createDataFrame([(7.0,)], "v double")
    assert one.agg(F.percentile("v", 0.95)).first()[0] == 7.0


def wet(df, **kw):
    rows = thresholds.wet_day_percentiles(df, **kw).collect()
    return {r.series: r for r in rows}


def test_only_wet_days_count(daily):
    r = random.Random(17)
    for wet_days in (0, 7, 33, 150):
        rain = [round(r.uniform(1, 60), 2) for _ in range(wet_days)]
        v = rain + [round(r.uniform(0, 0.99), 2) for _ in range(211)]
        r.shuffle(v)
        row = wet(daily(a=v)).get("a")
        if not wet_days:
            assert row is None
        elif wet_days < thresholds.MIN_SAMPLE:
            assert row.p95_daily is None and row.wet_days == wet_days
        else:
            assert row.p95_daily == pytest.approx(float(np.percentile(rain, 95)))
            assert row.p99_daily == pytest.approx(float(np.percentile(rain, 99)))


def test_base_period_is_inclusive(daily):
    old = daily(a=[100.0] * 60, start=D(1990, 1, 1))
    new = daily(a=[5.0] * 60, start=D(1991, 1, 1))
    assert wet(old.unionByName(new))["a"].p99_daily == 5.0
    edge = daily(a=[3.0] * 25, start=D(2020, 12, 7))
    assert wet(edge)["a"].wet_days == 25


def test_accumulated_percentile_keeps_dry_sums_and_drops_gaps(daily):
    got = thresholds.accumulated_percentiles(daily(a=[10.0] * 100)).first()
    assert (got.windows, got.p95_accumulated) == (98, 30.0)
    v = [10.0] * 50 + [None] + [10.0] * 49
    got = thresholds.accumulated_percentiles(daily(a=v)).first()
    assert (got.windows, got.p95_accumulated) == (95, 30.0)
    dry = thresholds.accumulated_percentiles(daily(a=[0.0] * 50)).first()
    assert dry.p99_accumulated == 0.0


def test_window_reaches_before_the_base_period(daily):
    df = daily(a=[100.0] * 2 + [1.0] * 40, start=D(1990, 12, 30))
    got = thresholds.accumulated_percentiles(df, percents=(99,)).first()
    assert got.windows == 40 and got.p99_accumulated > 100


def test_district_without_data_keeps_nulls(daily):
    df = daily(a=[None] * 400, b=[float(i % 9) for i in range(400)])
    rows = {r.series: r for r in thresholds.district_thresholds(df).collect()}
    assert rows["a"].p95_daily is None and rows["a"].p99_accumulated is None
    assert rows["b"].p99_daily >= rows["b"].p95_daily
    with pytest.raises(ValueError):
        thresholds.wet_day_percentiles(df, percents=(100,))


def test_threshold_audit_truncated_percentile(daily):
    r = random.Random(1)
    v = [round(r.expovariate(0.2), 3) if r.random() < 0.4 else 0.0 for _ in range(900)]
    row = thresholds.threshold_audit(daily(a=v)).first()
    assert row.p95_all_days == sorted(v)[int(0.95 * 899)]
    sums = [sum(v[i - 2 : i + 1]) for i in range(2, 900)]
    p99 = float(np.percentile(sums, 99))
    assert row.high_right == sum(s > p99 for s in sums)


def test_fire_threshold_over_all_or_active_windows(spark):
    rows = [("a", n) for n in (0, 0, 0, 0, 1, 2, 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "series string, n long")
    assert thresholds.count_threshold(df).first().p90 == pytest.approx(5.1)
    active = thresholds.count_threshold(df, only_active=True).first()
    assert active.p90 == pytest.approx(5.5)


# --- index ----------------------------------------------------------------------------------


def test_monthly_totals_are_strict_and_dense(daily):
    v = [1.0] * 31 + [None] + [1.0] * 27
    df = daily(a=v).unionByName(daily(a=[2.0] * 30, start=D(1995, 4, 1)))
    got = series_of(spi.monthly_totals(df), "total")
    assert got == [31.0, None, None, 60.0]


def test_accumulate_golden(spark):
    acc = lambda v, w: series_of(spi.accumulate(months(spark, v), w), "accumulated")
    assert acc([1, 2, 3, 4, 5], 2) == [None, None, 5, 7, 9]
    assert acc([1, 2, None, 4, 5], 2) == [None, None, None, None, 9]
    assert acc([1, 2, 3, 4], 3) == [None, None, None, 9]
    assert acc([1, 2], 1) == [None, 2]
    with pytest.raises(ValueError):
        acc([1], 0)


def fit(spark, values):
    df = spark.createDataFrame([("a", 1, float(v)) for v in values], "series string, month int, accumulated double")
    return spi.gamma_parameters(df).first()


def test_gamma_fit_separates_zeros(spark):
    row = fit(spark, [0, 0] + [10 * i for i in range(1, 9)])
    assert row.zero_share == pytest.approx(0.2) and row.shape > 0 and row.scale > 0
    few = fit(spark, [0, 0, 0, 5])
    assert (few.shape, few.scale, few.zero_share) == (None, None, 0.75)
    flat = fit(spark, [50.0] * 30)
    assert flat.shape is None


def over(spark, rows, schema, text):
    """Values of an SQL expression, one per row, in the order of the rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", F.expr(text).alias("v")).orderBy("i").collect()]


def test_gamma_shape_solves_the_likelihood_equation(spark):
    r = np.random.default_rng(3)
    rows = []
    for a in (0.02, 0.3, 1.0, 7.5, 400.0, 3e5):
        x = r.gamma(a, 2.0, 500)
        rows.append((float(x.mean()), float(np.log(x).mean())))
    shapes = over(spark, rows, "x double, y double", special.gamma_shape("x", "y"))
    left = over(spark, [(a,) for a in shapes], "x double", special.log_less_digamma("x"))
    for (m, ml), value in zip(rows, left):
        assert value == pytest.approx(math.log(m) - ml, rel=1e-9, abs=1e-12)
    odd = [(1.0, 0.0), (1.0, 0.5), (None, 0.1), (float("nan"), 0.1)]
    assert over(spark, odd, "x double, y double", special.gamma_shape("x", "y")) == [None] * 4


def test_special_functions_obey_their_identities(spark):
    x = [0.1, 0.9, 2.5, 9.99, 10.0, 11.0, 300.0, 1e9]
    rows = [(v,) for v in x]
    assert over(spark, rows, "x double", special.log_gamma("x")) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-14)
    digamma = lambda c: f"(ln({c}) - {special.log_less_digamma(c)})"
    assert over(spark, rows[:-1], "x double", f"{digamma('x + 1')} - {digamma('x')}") == pytest.approx([1 / v for v in x[:-1]], rel=1e-9)
    trigamma = lambda c: f"({special.trigamma_less_inverse(c)} + 1 / ({c}))"
    assert over(spark, rows[:-1], "x double", f"{trigamma('x')} - {trigamma('x + 1')}") == pytest.approx([v**-2 for v in x[:-1]], rel=1e-8)
    z = [-6.5, -3.0, -0.4, 0.0, 2.2]
    p = [(math.erfc(-v / math.sqrt(2)) / 2,) for v in z]
    assert over(spark, p, "x double", special.normal_quantile("x")) == pytest.approx(z, abs=1e-12)
    assert over(spark, [(0.0,), (1.0,), (None,)], "x double", special.normal_quantile("x")) == [None] * 3


def test_gamma_distribution_function(spark):
    t = [0.01, 0.5, 3.0, 20.0, 200.0]
    p = special.gamma_cdf("x", "y")
    at = lambda rows: over(spark, rows, "x double, y double", p)
    assert at([(v, 1.0) for v in t]) == pytest.approx([1 - math.exp(-v) for v in t], abs=1e-14)
    assert at([(v, 2.0) for v in t]) == pytest.approx([1 - math.exp(-v) * (1 + v) for v in t], abs=1e-13)
    assert at([(v, 0.5) for v in t]) == pytest.approx([math.erf(math.sqrt(v)) for v in t], abs=1e-13)
    # P(a + 1, x) = P(a, x) - x**a * exp(-x) / gamma(a + 1), at any size of a.
    for a in (0.2, 9.5, 10.0, 400.0, 1e5, 1e7):
        for z in (-3.0, 0.0, 0.7, 3.5):
            x = a + z * math.sqrt(a)
            if x <= 0:
                continue
            low, high = at([(x, a), (x, a + 1)])
            off = (x - a) / a
            front = math.exp(-a * (off - math.log1p(off)) - special_rest(a))
            assert low - high == pytest.approx(front, abs=1e-12)
    assert at([(1.0, 2e8), (1.0, None), (None, 1.0), (0.0, 1.0)]) == [None] * 4
    assert at([(1e-3, 1e6), (1e9, 1e6)]) == [0.0, 1.0]


def special_rest(a):
    """lgamma(a + 1) - (a ln a - a), for the front factor above."""
    return math.lgamma(a + 1) - (a * math.log(a) - a) if a < 1e3 else 0.5 * math.log(2 * math.pi * a) + 1 / (12 * a)


def test_index_limits_and_zero_mass(spark):
    index = special.standard_index("x", "2D", "1D", "0.5D")
    out = over(spark, [(0.0,), (1e9,), (None,), (float("nan"),)], "x double", index)
    assert out[0] == pytest.approx(NormalDist().inv_cdf(0.25))
    assert out[1] == pytest.approx(NormalDist().inv_cdf(1 - 1e-4))
    assert out[2:] == [None, None]


def test_index_needs_no_python_worker(spark):
    plan = spi.spi(months(spark, rainy(60)), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def rainy(n, seed=5):
    r = random.Random(seed)
    dry = {12, 1, 2, 3, 4}
    return [
        r.gammavariate(2, 10 if i % 12 + 1 in dry else 120) for i in range(n)
    ]


def test_spi_by_month_is_an_anomaly_index(spark):
    df = months(spark, rainy(420))
    own = spi.spi(df, 3).where("spi IS NOT NULL")
    dry = own.where(F.col("month").isin(12, 1, 2, 3, 4)).agg(F.avg("spi")).first()[0]
    assert abs(dry) < 0.1
    assert series_of(spi.spi(df, 3), "spi")[:3] == [None] * 3
    pooled = spi.spi(df, 3, by_month=False).where("spi IS NOT NULL")
    assert pooled.where(F.col("month").isin(2, 3, 4)).agg(F.avg("spi")).first()[0] < -0.5


def test_spi_grows_with_rain_inside_a_month(spark):
    rows = spi.spi(months(spark, rainy(360)), 1).where("month = 7 AND spi IS NOT NULL").collect()
    ordered = sorted(rows, key=lambda r: r.accumulated)
    values = [r.spi for r in ordered]
    assert values == sorted(values)


def test_spi_thin_and_flat_samples_are_null(spark):
    assert series_of(spi.spi(months(spark, [1, 2, 3]), 1), "spi") == [None] * 3
    assert set(series_of(spi.spi(months(spark, [50.0] * 30), 1), "spi")) == {None}
    v = rainy(120)
    for i in range(0, 120, 12):
        v[i] = None if i > 24 else v[i]
    out = spi.spi(months(spark, v), 1)
    assert set(series_of(out.where("month = 1"), "spi")) == {None}
    assert None not in series_of(out.where("month = 2"), "spi")


def test_spi_refuses_negative_rain(spark):
    with pytest.raises(ValueError, match="negative"):
        spi.spi(months(spark, [1, -2, 3]), 1, guard=True)


def test_dry_spell_is_a_drought(spark):
    v = rainy(360)
    v[240:252] = [0.1] * 12
    out = series_of(spi.spi(months(spark, v), 3), "spi")
    assert np.mean(out[243:252]) < -1


def test_anomaly_without_normal_is_null(daily):
    df = daily(a=[10.0] * 31 + [4.0] * 28)
    normals = spi.climatology(df.where(F.month("date") == 1))
    out = spi.anomaly(df, normals).orderBy("date").collect()
    assert out[0].anomaly == 0.0 and out[40].anomaly is None


# --- spectra --------------------------------------------------------------------------------


def wave(n, *parts, offset=0.0):
    return [offset + sum(a * math.sin(2 * math.pi * f * t) for a, f in parts) for t in range(n)]


def test_annual_wave_dominates_with_its_amplitude(daily):
    year = 1 / 365.25
    for offset in (0.0, 1000.0):
        df = daily(a=wave(1461, (10, year), offset=offset))
        bins = spectrum.spectrum(df).where("k > 0").orderBy(F.desc("magnitude")).first()
        near = spectrum.nearest_bin(spectrum.spectrum(df), year).first()
        assert bins.k == near.k and near.magnitude == pytest.approx(10, rel=0.02)
        assert near.period == pytest.approx(365.25)


def test_plain_sums_equal_the_transform(daily):
    r = random.Random(9)
    df = daily(a=[r.random() for _ in range(501)], b=[r.random() for _ in range(400)])
    cycles = {"annual": spectrum.ANNUAL, "week": 1 / 7}
    sums = {(r.series, r.k): r.magnitude for r in spectrum.spectrum_at(df, cycles).collect()}
    full = {(r.series, r.k): r.magnitude for r in spectrum.spectrum(df).collect()}
    for key, magnitude in sums.items():
        assert magnitude == pytest.approx(full[key], abs=1e-10)


def test_gaps_fail_or_stay_without_magnitudes(daily):
    df = daily(a=[1.0, None, 2.0, None, 5.0], b=[1.0, 2.0, 1.0], c=[4.0])
    with pytest.raises(Exception, match="gap-free.* lacks 2"):
        spectrum.spectrum(df.where("series = 'a'")).collect()
    rows = spectrum.spectrum(df, on_gap="null").collect()
    assert {(r.series, r.k, r.n, r.missing) for r in rows if r.magnitude is None} == {("a", k, 5, 2) for k in range(3)} | {("c", 0, 1, 0)}
    assert {(r.series, r.k) for r in rows if r.magnitude is not None} == {("b", 0), ("b", 1)}
    rows = spectrum.spectrum(df.where("value IS NOT NULL"), on_gap="null").where("series = 'a'").collect()
    assert {(r.k, r.n, r.magnitude, r.missing) for r in rows} == {(k, 5, None, 2) for k in range(3)}
    at = {r.series: r for r in spectrum.spectrum_at(df.where("series <> 'c'"), {"x": 0.4}, on_gap="null").collect()}
    assert at["a"].magnitude is None and at["a"].missing == 2 and at["b"].magnitude > 0
    peaks = spectrum.spectral_peaks(spectrum.spectrum(df.where("series <> 'c'"), on_gap="null")).collect()
    assert {(r.series, r.rank, r.missing) for r in peaks} == {("a", None, 2), ("b", 1, 0)}
    with pytest.raises(ValueError):
        spectrum.spectrum(df, rate=0)


@pytest.mark.parametrize("uneven", [0, 1, 10**6])
def test_transform_equals_numpy_at_all_kinds_of_length(daily, monkeypatch, uneven):
    """Primes, squares, powers of two and products; by the split alone, by chirps, and mixed."""
    monkeypatch.setattr(spectrum, "UNEVEN", uneven)
    r = np.random.default_rng(4)
    lengths = (2, 3, 4, 7, 30, 64, 97, 121, 360, 509)
    waves = {f"s{n}": r.normal(3, 50, n) for n in lengths}
    rows = spectrum.spectrum(daily(**{s: v.tolist() for s, v in waves.items()})).collect()
    got = {(x.series, x.k): x.magnitude for x in rows}
    for n in lengths:
        v = waves[f"s{n}"]
        want = np.abs(np.fft.rfft(v - v.mean())) * 2 / n
        assert len([1 for s, _ in got if s == f"s{n}"]) == n // 2 + 1
        assert [got[f"s{n}", k] for k in range(n // 2 + 1)] == pytest.approx(want.tolist(), abs=1e-9)


def test_transform_runs_without_python(daily):
    plan = spectrum.spectrum(daily(a=[1.0, 2.0, 4.0]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_nearest_bin_number_matches_search(spark):
    for n in (50, 365, 366, 1461, 2499):
        for f in (spectrum.ANNUAL, spectrum.SEMIANNUAL, 1 / 7, 0.49999, 0.00001):
            want = min(range(1, n // 2 + 1), key=lambda k: abs(k / n - f))
            got = spark.range(1).select(
                spectrum.nearest_bin_number(F.lit(n), f).alias("k")
            ).first().k
            assert got == want, (n, f)


def greedy(mags, how_many, sep):
    chosen = []
    for k in sorted(range(1, len(mags)), key=lambda k: (-mags[k], k)):
        if len(chosen) < how_many and all(abs(k - c) >= sep for c in chosen):
            chosen.append(k)
    return chosen


@pytest.mark.parametrize("how_many,sep", [(5, 3), (2, 1), (3, 8)])
def test_peaks_match_greedy_search(spark, how_many, sep):
    r = random.Random(how_many * 10 + sep)
    mags = [0.0] + [float(r.randint(0, 40)) for _ in range(150)]
    rows = [("a", k, k / 300, m) for k, m in enumerate(mags)]
    df = spark.createDataFrame(rows, "series string, k int, frequency double, magnitude double")
    got = spectrum.spectral_peaks(df, how_many, sep).orderBy("rank").collect()
    assert [x.k for x in got] == greedy(mags, how_many, sep)
    with pytest.raises(ValueError):
        spectrum.spectral_peaks(df, 2, 0)


def test_ratio_without_annual_cycle_is_null(spark):
    rows = [("a", "annual", 0.0), ("a", "semiannual", 3.0), ("b", "annual", 2.0), ("b", "semiannual", 1.0)]
    df = spark.createDataFrame(rows, "series string, target string, magnitude double")
    got = {r.series: r.ratio for r in spectrum.seasonal_ratio(df).collect()}
    assert got == {"a": None, "b": 0.5}


def test_bimodality_needs_more_than_the_harmonic(daily):
    n = 4 * 365 + 1
    year = 1 / 365.25
    start = D(1995, 1, 1)
    plain = [max(0.0, math.sin(math.pi * ((t % 365) - 121) / 213)) ** 0.35 * 10 if 121 <= t % 365 <= 334 else 0.0 for t in range(n)]
    two = wave(n, (5, year), (9, 2 * year))
    rows = {r.series: r for r in spectrum.bimodality(daily(one=plain, two=two, start=start)).collect()}
    assert rows["two"].bimodal and not rows["one"].bimodal
    assert rows["one"].ratio == pytest.approx(rows["one"].null_ratio)
    assert rows["one"].annual_dominates
    spread = spectrum.homogeneity(spectrum.seasonal_ratio(spectrum.spectrum_at(daily(one=plain, two=two), {"annual": year, "semiannual": 2 * year}))).first()
    assert spread.highest > spread.lowest


# --- table of derived indices ---------------------------------------------------------------


def years_of_days(daily, values, start=D(1990, 1, 1)):
    return daily(a=values, start=start)


def test_derived_indices_carry_only_what_a_day_could_know(spark, daily):
    r = random.Random(4)
    rain = years_of_days(daily, [max(0.0, r.gauss(0, 8)) for _ in range(6 * 365 + 2)])
    heat = years_of_days(daily, [20 + r.random() for _ in range(6 * 365 + 2)])
    out = indices.derived_indices(rain, heat)
    assert conformance(out, DERIVED_INDEX) == []
    monthly = {x.month_start: x.spi for x in spi.spi(spi.monthly_totals(rain), 1).collect()}
    rows = out.where("year(date) = 1994").collect()
    assert len(rows) == 365
    for row in rows:
        before = D(row.date.year - (row.date.month == 1), (row.date.month - 2) % 12 + 1, 1)
        assert row.spi_1m == monthly[before] and row.spi_1m is not None
    # Rain of a month changes nothing in the rows of that month but the dry days.
    changed = rain.withColumn("value", F.when(F.col("date") >= D(1995, 12, 1), 500.0).otherwise(F.col("value")))
    kept = lambda df: df.where("date between '1995-12-01' and '1995-12-31'").select("date", "spi_1m", "spi_3m", "temp_anomaly")
    seen = {x.date: tuple(x) for x in kept(indices.derived_indices(changed, heat)).collect()}
    for x in kept(out).collect():
        # The fit of a calendar month covers all its years; November's, seen in December, is untouched.
        assert seen[x.date] == tuple(x)


def test_derived_indices_of_days_that_one_input_lacks(spark, daily):
    out = {r.date: r for r in indices.derived_indices(daily(a=[5.0, 0.0]), daily(a=[21.0, 22.0, None], b=[1.0])).where("district = 'a'").collect()}
    assert [out[D(1995, 1, i)].dry_days for i in (1, 2, 3)] == [0, 1, None]
    assert out[D(1995, 1, 3)].temp_anomaly is None and out[D(1995, 1, 1)].spi_1m is None
    assert out[D(1995, 1, 1)].temp_anomaly == pytest.approx(-0.5)
    none = indices.derived_indices(daily(a=[1.0]).where("false"), daily(a=[1.0]).where("false"))
    assert none.count() == 0


def test_derived_indices_are_stored_and_read_back(spark, daily, tmp_path):
    path = str(tmp_path / "indices")
    days = [1.0] * 400
    rows = indices.derived_indices(daily(a=days, b=days), daily(a=days, b=days))
    assert indices.save_indices(spark, path, rows) == 800
    first, last = D(1995, 12, 30), D(1996, 1, 2)
    got = indices.read_indices(spark, path, first, last)
    assert got.count() == 8 and got.columns == [f.name for f in DERIVED_INDEX]
    later = rows.where("district = 'a' and year(date) = 1996").withColumn("dry_days", F.lit(99))
    indices.save_indices(spark, path, later, batch=("nightly", 1))
    assert indices.save_indices(spark, path, later.withColumn("dry_days", F.lit(1)), batch=("nightly", 1)) == 0
    again = indices.read_indices(spark, path, first, last, "a").orderBy("date").collect()
    assert [r.dry_days for r in again] == [0, 0, 99, 99]
    assert indices.read_indices(spark, path, D(1990, 1, 1), D(2000, 1, 1)).count() == 800
    plan = indices.read_indices(spark, path, first, D(1995, 12, 31))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
