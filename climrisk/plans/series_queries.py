"""Calendars, windows, thresholds, indices and spectra of daily series."""

from __future__ import annotations

import re
from datetime import date as Date

from pyspark.sql import functions as F

from climrisk.functions import special
from climrisk.operators import audits, calendar, indices, spectrum, spi, thresholds, windows
from climrisk.plans import adapters as a
from climrisk.plans.registry import query, rounded

STRICT3 = """CASE WHEN count(value) OVER w3 = 3 THEN sum(value) OVER w3 END"""
W3 = "WINDOW w3 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query("densify_daily", f"WITH {a.STATIONS_SQL} SELECT series, date, value FROM stations")
def densify_daily(spark, sf):
    return a.stations(spark, sf)


@query(
    "series_range",
    f"""WITH {a.REGIONS_SQL} SELECT * FROM regions
    WHERE series = 'ASIA' AND date BETWEEN DATE '1996-02-20' AND DATE '1998-03-05'""",
)
def series_range(spark, sf):
    return calendar.series_range(
        a.regions(spark, sf), "ASIA", Date(1996, 2, 20), Date(1998, 3, 5)
    )


@query("rolling_sum_strict", f"WITH {a.STATIONS_SQL} SELECT *, {STRICT3} AS total FROM stations {W3}")
def rolling_sum_strict(spark, sf):
    return windows.rolling_sum(a.stations(spark, sf), 3)


@query(
    "moving_average",
    f"""WITH {a.REGIONS_SQL} SELECT series, date, value,
    CASE WHEN value IS NOT NULL THEN round(avg(value) OVER (PARTITION BY series ORDER BY date
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) END AS smooth FROM regions""",
)
def moving_average(spark, sf):
    return rounded(windows.moving_average(a.regions(spark, sf), 5), 6, "smooth")


def _savgol_sql(window: int, order: int, source: str) -> str:
    """Least squares by explicit matrices: fixed weights at every place of the run."""
    from climrisk.functions.kernels import smoothing_matrix

    h = window // 2
    m = smoothing_matrix(window, order)
    weights = ", ".join(
        f"({i},{j},{float(m[i][j])!r}e0)".replace("e-", "e-").replace("e0)", ")")
        if "e" in repr(float(m[i][j]))
        else f"({i},{j},{float(m[i][j])!r}e0)"
        for i in range(window)
        for j in range(window)
    )
    return f"""
weights(i, j, w) AS (VALUES {weights}),
present AS (
  SELECT *, date - CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS run
  FROM {source} WHERE value IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY series, run ORDER BY date) - 1 AS p,
    count(*) OVER (PARTITION BY series, run) AS n FROM present),
target AS (
  SELECT *, CASE WHEN p < {h} THEN p WHEN p >= n - {h} THEN {window} - (n - p) ELSE {h} END AS i,
    CASE WHEN p < {h} THEN 0 WHEN p >= n - {h} THEN n - {window} ELSE p - {h} END AS first
  FROM placed WHERE n >= {window}),
smoothed AS (
  SELECT t.series, t.date, sum(w.w * q.value) AS smooth
  FROM target t JOIN weights w ON w.i = t.i
  JOIN placed q ON q.series = t.series AND q.run = t.run AND q.p = t.first + w.j
  GROUP BY 1, 2),
filtered AS (
  SELECT s.series, s.date, s.value, coalesce(f.smooth, s.value) AS smooth
  FROM {source} s LEFT JOIN smoothed f ON f.series = s.series AND f.date = s.date)"""


@query(
    "savgol",
    f"""WITH {a.REGIONS_SQL}, {_savgol_sql(7, 2, 'regions')}
    SELECT series, date, value, round(smooth, 5) AS smooth FROM filtered""",
)
def savgol(spark, sf):
    return rounded(windows.smooth(a.regions(spark, sf)), 5, "smooth")


@query(
    "runs",
    f"""WITH {a.STATIONS_SQL}, isl AS (
      SELECT series, date,
        date - CAST(row_number() OVER (PARTITION BY series ORDER BY date) AS INTEGER) AS g
      FROM stations WHERE value IS NOT NULL)
    SELECT series, min(date) AS run_start, CAST(max(date) + 1 AS DATE) AS run_end,
      CAST(count(*) AS INTEGER) AS days FROM isl GROUP BY series, g""",
)
def runs(spark, sf):
    return windows.runs(a.stations(spark, sf))


@query(
    "dry_streak",
    f"""WITH {a.RAIN_SQL}, marked AS (
      SELECT *, max(CASE WHEN value IS NULL OR value >= 1 THEN date END) OVER (
          PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS brk,
        min(date) OVER (PARTITION BY series) - 1 AS start FROM rain)
    SELECT series, date, value,
      CASE WHEN value IS NOT NULL THEN CAST(date_diff('day', coalesce(brk, start), date) AS INTEGER)
      END AS dry_days FROM marked""",
)
def dry_streak(spark, sf):
    return windows.dry_streak(a.rain(spark, sf))


@query(
    "resample",
    f"""WITH {a.REGIONS_SQL}, pos AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS INTEGER) // 10
        AS block FROM regions)
    SELECT series, block, min(date) AS block_start, count(value) AS present,
      CASE WHEN (count(*) - count(value)) * 2 <= count(*) THEN round(avg(value), 6) END AS value
    FROM pos GROUP BY series, block""",
)
def resample(spark, sf):
    return rounded(windows.resample(a.regions(spark, sf), 10, "mean"), 6, "value")


@query(
    "features",
    f"""WITH {a.RAIN_SQL} SELECT series, date, value,
      lag(value, 1) OVER s AS lag_1, lag(value, 3) OVER s AS lag_3, lag(value, 7) OVER s AS lag_7,
      CASE WHEN count(value) OVER w3 = 3 THEN sum(value) OVER w3 END AS sum_3,
      CASE WHEN count(value) OVER w7 = 7 THEN sum(value) OVER w7 END AS sum_7,
      round(avg(value) OVER w7, 6) AS mean_7, date AS touched
    FROM rain WINDOW s AS (PARTITION BY series ORDER BY date),
      w3 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
      w7 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def features(spark, sf):
    return rounded(windows.lagged_features(a.rain(spark, sf)), 6, "mean_7")


@query(
    "leak_audit",
    f"""WITH {a.REGIONS_SQL}, own AS (
      SELECT date, lag(date, 1) OVER s AS lag_1, lag(date, 7) OVER s AS lag_7, lead(date, 3) OVER s AS ahead_3,
        max(date) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sum_7
      FROM regions WINDOW s AS (PARTITION BY series ORDER BY date)),
    each AS (
      SELECT 'sound' AS features, 'lag_1' AS feature, date, lag_1 AS day FROM own
      UNION ALL SELECT 'sound', 'lag_7', date, lag_7 FROM own
      UNION ALL SELECT 'sound', 'sum_7', date, sum_7 FROM own
      UNION ALL SELECT 'leaking', 'lag_1', date, lag_1 FROM own
      UNION ALL SELECT 'leaking', 'ahead_3', date, ahead_3 FROM own)
    SELECT features, feature, count(*) AS rows, count(*) FILTER (WHERE day > date) AS violations,
      CAST(max(date_diff('day', date, day)) AS INTEGER) AS latest_offset_days
    FROM each GROUP BY 1, 2""",
)
def leak_audit(spark, sf):
    # One sound table of features, and one that reads three days ahead.
    made = lambda lags, sums: windows.leak_audit(
        windows.lagged_features(a.regions(spark, sf), lags, sums, (), audit=True)
    )
    sound, leaking = made((1, 7), (7,)), made((1, -3), ())
    return sound.withColumn("features", F.lit("sound")).unionByName(leaking.withColumn("features", F.lit("leaking")))


_NEIGHBOURS = """
    max(CASE WHEN value IS NOT NULL THEN date END) OVER (
      PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS pd,
    min(CASE WHEN value IS NOT NULL THEN date END) OVER (
      PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd"""


@query(
    "impute_linear",
    f"""WITH {a.STATIONS_SQL}, near AS (SELECT *, {_NEIGHBOURS} FROM stations), line AS (
      SELECT n.series, n.date, n.value,
        CASE WHEN n.value IS NULL AND date_diff('day', pd, nd) - 1 <= 7
          THEN round(p.value + (q.value - p.value) * date_diff('day', pd, n.date)
            / date_diff('day', pd, nd), 6) END AS fill
      FROM near n LEFT JOIN stations_days p ON p.series = n.series AND p.date = pd
      LEFT JOIN stations_days q ON q.series = n.series AND q.date = nd)
    SELECT series, date, value, coalesce(value, fill) AS filled,
      value IS NULL AND fill IS NOT NULL AS imputed,
      CASE WHEN value IS NULL AND fill IS NOT NULL THEN 'interpolacion_lineal'
        ELSE 'sin_imputar' END AS imputation_method FROM line""",
)
def impute_linear(spark, sf):
    rows = a.station_rows(spark, sf)
    return rounded(windows.impute_linear(a.stations(spark, sf), rows=rows), 6, "filled")


@query(
    "impute_mean",
    f"""WITH {a.REGIONS_SQL}, near AS (SELECT *, avg(value) OVER (PARTITION BY series ORDER BY date
        ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS fill FROM regions)
    SELECT series, date, value, round(coalesce(value, fill), 6) AS filled,
      value IS NULL AND fill IS NOT NULL AS imputed,
      CASE WHEN value IS NULL AND fill IS NOT NULL THEN 'media_movil'
        ELSE 'sin_imputar' END AS imputation_method FROM near""",
)
def impute_mean(spark, sf):
    return rounded(windows.impute_moving_mean(a.regions(spark, sf)), 6, "filled")


NORMALS = """normals AS (
      SELECT series, CAST(month(date) AS INTEGER) AS month, avg(value) AS normal FROM {t}
      WHERE date BETWEEN DATE '1991-01-01' AND DATE '2020-12-31' GROUP BY 1, 2)"""


@query(
    "climatology",
    f"""WITH {a.REGIONS_SQL}, {NORMALS.format(t='regions')}
    SELECT series, month, round(normal, 6) AS normal FROM normals""",
)
def climatology(spark, sf):
    return rounded(spi.climatology(a.regions(spark, sf)), 6, "normal")


@query(
    "anomaly",
    f"""WITH {a.REGIONS_SQL}, {NORMALS.format(t='regions')}
    SELECT r.series, r.date, r.value, CAST(month(r.date) AS INTEGER) AS month,
      round(n.normal, 6) AS normal, round(r.value - n.normal, 6) AS anomaly
    FROM regions r LEFT JOIN normals n ON n.series = r.series AND n.month = month(r.date)""",
)
def anomaly(spark, sf):
    daily = a.regions(spark, sf)
    return rounded(spi.anomaly(daily, spi.climatology(daily)), 6, "normal", "anomaly")


@query(
    "impute_clim",
    f"""WITH {a.REGIONS_SQL}, {NORMALS.format(t='regions')}
    SELECT r.series, r.date, r.value, round(coalesce(r.value, n.normal), 6) AS filled,
      r.value IS NULL AND n.normal IS NOT NULL AS imputed,
      CASE WHEN r.value IS NULL AND n.normal IS NOT NULL THEN 'climatologia_mensual'
        ELSE 'sin_imputar' END AS imputation_method
    FROM regions r LEFT JOIN normals n ON n.series = r.series AND n.month = month(r.date)""",
)
def impute_clim(spark, sf):
    daily = a.regions(spark, sf)
    return rounded(windows.impute_climatology(daily, spi.climatology(daily)), 6, "filled")


@query(
    "outlier_flags",
    f"""WITH {a.REGIONS_SQL}, q AS (
      SELECT series, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM regions WHERE value IS NOT NULL GROUP BY 1)
    SELECT r.series, r.date, r.value,
      coalesce(r.value < q1 - 1.5e0 * (q3 - q1) OR r.value > q3 + 1.5e0 * (q3 - q1), false)
        AS outlier,
      coalesce(r.value < 0 OR r.value > 5000, false) AS impossible
    FROM regions r LEFT JOIN q ON q.series = r.series""",
)
def outlier_flags(spark, sf):
    return windows.outlier_flags(a.regions(spark, sf), lowest=0, highest=5000)


# --- thresholds ---------------------------------------------------------------------------

SUMS = f"sums AS (SELECT *, {STRICT3} AS total FROM rain {W3})"
BASE = "date BETWEEN DATE '1991-01-01' AND DATE '2020-12-31'"
WET = f"""wet AS (SELECT series, count(*) AS wet_days,
      CASE WHEN count(*) >= 20 THEN quantile_cont(value, 0.95) END AS p95_daily,
      CASE WHEN count(*) >= 20 THEN quantile_cont(value, 0.99) END AS p99_daily
      FROM rain WHERE value >= 1 AND {BASE} GROUP BY 1)"""
ACC = f"""acc AS (SELECT series, count(*) AS windows,
      CASE WHEN count(*) >= 20 THEN quantile_cont(total, 0.95) END AS p95_accumulated,
      CASE WHEN count(*) >= 20 THEN quantile_cont(total, 0.99) END AS p99_accumulated
      FROM sums WHERE total IS NOT NULL AND {BASE} GROUP BY 1)"""


@query(
    "wetday_percentiles",
    f"""WITH {a.RAIN_SQL}, {WET} SELECT series, wet_days, round(p95_daily, 6) AS p95_daily,
      round(p99_daily, 6) AS p99_daily FROM wet""",
)
def wetday_percentiles(spark, sf):
    df = thresholds.wet_day_percentiles(a.rain(spark, sf))
    return rounded(df, 6, "p95_daily", "p99_daily")


@query(
    "acc72_percentiles",
    f"""WITH {a.RAIN_SQL}, {SUMS}, {ACC} SELECT series, windows,
      round(p95_accumulated, 6) AS p95_accumulated,
      round(p99_accumulated, 6) AS p99_accumulated FROM acc""",
)
def acc72_percentiles(spark, sf):
    df = thresholds.accumulated_percentiles(a.rain(spark, sf))
    return rounded(df, 6, "p95_accumulated", "p99_accumulated")


@query(
    "district_thresholds",
    f"""WITH {a.RAIN_SQL}, {SUMS}, {WET}, {ACC}
    SELECT m.series, round(p95_daily, 6) AS p95_daily, round(p99_daily, 6) AS p99_daily,
      round(p95_accumulated, 6) AS p95_accumulated, round(p99_accumulated, 6) AS p99_accumulated
    FROM (SELECT DISTINCT series FROM rain) m LEFT JOIN wet ON wet.series = m.series
    LEFT JOIN acc ON acc.series = m.series""",
)
def district_thresholds(spark, sf):
    df = thresholds.district_thresholds(a.rain(spark, sf))
    return rounded(df, 6, *df.columns[1:])


@query(
    "threshold_audit",
    f"""WITH {a.RAIN_SQL}, {SUMS}, {WET}, {ACC}, plain AS (
      SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value) AS i,
        count(*) OVER (PARTITION BY series) AS n FROM rain WHERE value IS NOT NULL)
    SELECT s.series, count(*) AS windows,
      count(*) FILTER (WHERE total > p99_accumulated) AS high_right,
      count(*) FILTER (WHERE total > p99_daily) AS high_wrong,
      round(min(p95_daily), 6) AS p95_daily,
      (SELECT value FROM plain p WHERE p.series = s.series AND i = floor(0.95e0 * (n - 1)) + 1)
        AS p95_all_days
    FROM sums s JOIN wet ON wet.series = s.series JOIN acc ON acc.series = s.series
    WHERE total IS NOT NULL GROUP BY s.series""",
)
def threshold_audit(spark, sf):
    return rounded(thresholds.threshold_audit(a.rain(spark, sf)), 6, "p95_daily")


@query(
    "filter_audit",
    f"""WITH {a.RAIN_SQL}, {_savgol_sql(7, 2, 'rain')}, both_ AS (
      SELECT * FROM filtered WHERE value IS NOT NULL), lim AS (
      SELECT series, quantile_cont(value, 0.95) AS p95_raw, quantile_cont(smooth, 0.95) AS p95_smooth,
        quantile_cont(value, 0.99) AS p99_raw, quantile_cont(smooth, 0.99) AS p99_smooth
      FROM both_ WHERE value >= 1 GROUP BY 1)
    SELECT b.series, round(p95_raw, 4) AS p95_raw, round(p95_smooth, 4) AS p95_smooth,
      round(p99_raw, 4) AS p99_raw, round(p99_smooth, 4) AS p99_smooth,
      count(*) AS days, count(*) FILTER (WHERE value >= 1 AND value > p99_raw) AS extremes_raw,
      count(*) FILTER (WHERE value >= 1 AND value > p99_raw AND smooth > p99_smooth)
        AS extremes_kept,
      count(*) FILTER (WHERE value >= 1 AND smooth > p99_raw) AS over_raw_limit,
      count(*) FILTER (WHERE smooth < -1e-9) AS negative_days, round(min(smooth), 4) AS lowest,
      count(*) FILTER (WHERE value = 0) AS dry_days,
      count(*) FILTER (WHERE value = 0 AND smooth >= 1 - 1e-9) AS dry_turned_wet,
      sum(value) AS mass_raw, round(sum(smooth), 3) AS mass_smooth,
      round((p99_smooth - p99_raw) / p99_raw * 100, 4) AS p99_shift_pct
    FROM both_ b JOIN lim ON lim.series = b.series GROUP BY b.series, lim.p95_raw, lim.p95_smooth,
      lim.p99_raw, lim.p99_smooth""",
)
def filter_audit(spark, sf):
    smoothed = windows.smooth(a.rain(spark, sf))
    # A smoothed 0 or 1 may come out a hair off, so values are kept to nine decimals.
    clean = smoothed.withColumn("smooth", F.round("smooth", 9))
    df = audits.filter_effect(clean, "smooth")
    df = rounded(df, 4, "p95_raw", "p95_smooth", "p99_raw", "p99_smooth", "lowest", "p99_shift_pct")
    return rounded(df, 3, "mass_smooth")


def _sweep_sql() -> str:
    parts, picks = [], []
    for size in (3, 5, 7, 11):
        text = _savgol_sql(size, 2, "rain")
        for name in ("weights", "present", "placed", "target", "smoothed", "filtered"):
            text = re.sub(rf"\b{name}\b", f"{name}_{size}", text)
        parts.append(text)
        picks.append(
            f"""SELECT f.series, CAST({size} AS INTEGER) AS "window", count(*) AS days,
              count(*) FILTER (WHERE smooth < -1e-9) AS negative_days,
              count(*) FILTER (WHERE value = 0 AND smooth >= 1 - 1e-9) AS dry_turned_wet,
              round(quantile_cont(CASE WHEN value >= 1 THEN smooth END, 0.99), 4) AS p99_smooth
            FROM filtered_{size} f WHERE value IS NOT NULL GROUP BY 1"""
        )
    return f"WITH {a.RAIN_SQL}, " + ", ".join(parts) + " " + " UNION ALL ".join(picks)


@query("filter_sweep", _sweep_sql())
def filter_sweep(spark, sf):
    df = audits.filter_sweep(a.rain(spark, sf)).select(
        "series", "window", "days", "negative_days", "dry_turned_wet", "p99_smooth"
    )
    return rounded(df, 4, "p99_smooth")


# --- monthly index ------------------------------------------------------------------------

MONTHS = """months AS (
      SELECT series, CAST(date_trunc('month', date) AS DATE) AS month_start,
        CASE WHEN count(value) = day(last_day(min(date))) THEN sum(value) END AS total,
        CAST(count(value) AS INTEGER) AS days_present FROM {t} GROUP BY 1, 2)"""
ACCUMULATED = """acc AS (
      SELECT *, CAST(month(month_start) AS INTEGER) AS month,
        CASE WHEN row_number() OVER s > 3 AND count(total) OVER w = 3 THEN sum(total) OVER w END
          AS accumulated
      FROM months WINDOW s AS (PARTITION BY series ORDER BY month_start),
        w AS (PARTITION BY series ORDER BY month_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query(
    "monthly_totals",
    f"""WITH {a.RAIN_SQL}, {MONTHS.format(t='rain')}
    SELECT series, month_start, total, days_present FROM months""",
)
def monthly_totals(spark, sf):
    return spi.monthly_totals(a.rain(spark, sf))


@query(
    "spi_accumulate",
    f"""WITH {a.RAIN_SQL}, {MONTHS.format(t='rain')}, {ACCUMULATED}
    SELECT series, month_start, total, days_present, accumulated FROM acc""",
)
def spi_accumulate(spark, sf):
    return spi.accumulate(spi.monthly_totals(a.rain(spark, sf)), 3)


def _ratio_sql(pair, x: str) -> str:
    """The quotient of two polynomials of the published normal quantile."""
    powers = lambda cs: " + ".join(f"{c:.20e} * pow({x}, {len(cs) - 1 - i})" for i, c in enumerate(cs))
    return f"(({powers(pair[0])}) / ({powers(pair[1])}))"


def _fit_sql(keys: str, join: str) -> str:
    """Shape by Newton steps on the likelihood equation, index by series and rational quantile."""
    digamma = (
        "(ln(y) - 0.5e0/y - (1e0/12 - (1e0/120 - (1e0/252 - (1e0/240 - 1e0/132/(y*y))/(y*y))"
        "/(y*y))/(y*y))/(y*y)"
        " - (1/a + 1/(a+1) + 1/(a+2) + 1/(a+3) + 1/(a+4) + 1/(a+5) + 1/(a+6) + 1/(a+7)))"
    )
    trigamma = (
        "(1/y + 0.5e0/(y*y) + (1e0/6 - (1e0/30 - (1e0/42 - (1e0/30)/(y*y))/(y*y))/(y*y))/(y*y*y)"
        " + 1/(a*a) + 1/((a+1)*(a+1)) + 1/((a+2)*(a+2)) + 1/((a+3)*(a+3)) + 1/((a+4)*(a+4))"
        " + 1/((a+5)*(a+5)) + 1/((a+6)*(a+6)) + 1/((a+7)*(a+7)))"
    )
    return f"""
stats AS (
  SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE accumulated > 0) AS n_positive,
    avg(accumulated) FILTER (WHERE accumulated > 0) AS m,
    avg(CASE WHEN accumulated > 0 THEN ln(accumulated) END) AS ml,
    (max(accumulated) FILTER (WHERE accumulated > 0)
      - min(accumulated) FILTER (WHERE accumulated > 0))
      / avg(accumulated) FILTER (WHERE accumulated > 0) AS spread
  FROM acc WHERE accumulated IS NOT NULL GROUP BY {keys}),
usable AS (
  SELECT *, ln(m) - ml AS s FROM stats WHERE n_positive >= 4 AND spread >= 1e-9),
newton AS (
  SELECT {keys}, s, m, 0 AS it, (3 - s + sqrt((s-3)*(s-3) + 24*s)) / (12*s) AS a FROM usable
  UNION ALL
  SELECT {keys}, s, m, it + 1, a - (ln(a) - {digamma} - s) / (1/a - {trigamma}) AS a
  FROM (SELECT *, a + 8 AS y FROM newton) WHERE it < 25),
shapes AS (SELECT {keys}, a, m / a AS b FROM newton WHERE it = 25),
fit AS (
  SELECT {keys}, n, n_positive, CAST(n - n_positive AS DOUBLE) / n AS zero_share,
    s.a AS shape, s.b AS scale FROM stats t LEFT JOIN shapes s USING ({keys})),
cdf AS (
  SELECT acc.series, acc.month_start, acc.accumulated, shape, scale, zero_share,
    CASE WHEN shape IS NULL OR accumulated IS NULL THEN NULL WHEN accumulated <= 0 THEN zero_share / 2
      ELSE zero_share + (1 - zero_share) * list_sum(list_transform(range(0, 3000),
        lambda k: exp(-accumulated/scale + (shape + k) * ln(accumulated/scale)
          - lgamma(shape + k + 1)))) END AS p0
  FROM acc LEFT JOIN fit ON {join}),
tail AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN
  least(greatest(p0, 1e-4), 1 - 1e-4) END AS p FROM cdf),
q AS (SELECT *, p - 0.5e0 AS d, 0.180625e0 - (p - 0.5e0) * (p - 0.5e0) AS c,
  sqrt(-ln(least(p, 1 - p))) - 1.6e0 AS r FROM tail),
z AS (SELECT *, CASE WHEN abs(d) <= 0.425e0 THEN d * {_ratio_sql(special.CENTRE, "c")}
  ELSE sign(d) * {_ratio_sql(special.FLANK, "r")} END AS spi FROM q)"""


RAIN_ACC = f"{a.RAIN_SQL}, {MONTHS.format(t='rain')}, {ACCUMULATED}"
BY_MONTH = _fit_sql("series, month", "fit.series = acc.series AND fit.month = acc.month")
POOLED = _fit_sql("series", "fit.series = acc.series")


@query(
    "gamma_params",
    f"""WITH RECURSIVE {RAIN_ACC}, {BY_MONTH}
    SELECT series, month, n, n_positive, round(zero_share, 6) AS zero_share,
      round(shape, 6) AS shape, round(scale, 6) AS scale FROM fit""",
)
def gamma_params(spark, sf):
    sums = spi.accumulate(spi.monthly_totals(a.rain(spark, sf)), 3)
    fit = spi.gamma_parameters(sums.withColumn("month", F.month("month_start")))
    return rounded(fit, 6, "shape", "scale", "zero_share")


def _index(spark, sf, **how):
    months = spi.monthly_totals(a.rain(spark, sf))
    return rounded(
        spi.spi(months, 3, **how).select("series", "month_start", "accumulated", "spi"), 6, "spi"
    )


@query(
    "spi3",
    f"""WITH RECURSIVE {RAIN_ACC}, {BY_MONTH}
    SELECT series, month_start, accumulated, round(spi, 6) AS spi FROM z""",
)
def spi3(spark, sf):
    return _index(spark, sf)


@query(
    "spi3_pooled",
    f"""WITH RECURSIVE {RAIN_ACC}, {POOLED}
    SELECT series, month_start, accumulated, round(spi, 6) AS spi FROM z""",
)
def spi3_pooled(spark, sf):
    return _index(spark, sf, by_month=False)


_SEASON = "month(month_start) IN (12, 1, 2, 3, 4)"
_POOLED_TOO = re.sub(r"\b(stats|usable|newton|shapes|fit|cdf|tail|q|z)\b", r"\1_pooled", POOLED)


@query(
    "spi_audit",
    f"""WITH RECURSIVE {RAIN_ACC}, {BY_MONTH}, {_POOLED_TOO}, both_ AS (
      SELECT z.series, z.month_start, z.spi AS m, y.spi AS p FROM z JOIN z_pooled y
        ON y.series = z.series AND y.month_start = z.month_start
      WHERE z.spi IS NOT NULL AND y.spi IS NOT NULL)
    SELECT series, count(*) AS months,
      round(avg(m) FILTER (WHERE {_SEASON}), 4) AS dry_mean_by_month,
      round(avg(p) FILTER (WHERE {_SEASON}), 4) AS dry_mean_pooled,
      round(avg(m) FILTER (WHERE NOT {_SEASON}), 4) AS wet_mean_by_month,
      round(avg(p) FILTER (WHERE NOT {_SEASON}), 4) AS wet_mean_pooled,
      count(*) FILTER (WHERE m <= -1) AS drought_by_month,
      count(*) FILTER (WHERE p <= -1) AS drought_pooled,
      count(*) FILTER (WHERE m <= -1 AND p <= -1) AS drought_both,
      round(corr(m, p), 4) AS correlation FROM both_ GROUP BY 1""",
)
def spi_audit(spark, sf):
    df = spi.spi_audit(spi.monthly_totals(a.rain(spark, sf)))
    return rounded(df, 4, *(c for c in df.columns if "mean" in c or c == "correlation"))


WARM_SQL = a._dense_sql(
    "warm",
    """SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date,
       sum(l_quantity) / count(*) AS value FROM lineitem GROUP BY 1, 2""",
)


def warm(spark, sf):
    """Mean quantity per return flag and day, as the temperature of the rain series."""
    days = a.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("date")
    )
    return calendar.densify(days.agg((F.sum("l_quantity") / F.count("*")).alias("value")))


_ONE_MONTH = re.sub(
    r"\b(acc|stats|usable|newton|shapes|fit|cdf|tail|q|z)\b", r"\1_one",
    ACCUMULATED.replace("> 3", "> 1").replace("= 3", "= 1").replace("2 PRECEDING", "0 PRECEDING") + ", " + BY_MONTH,
)


@query(
    "derived_indices",
    f"""WITH RECURSIVE {RAIN_ACC}, {BY_MONTH}, {_ONE_MONTH}, {WARM_SQL}, {NORMALS.format(t='warm')}, streak AS (
      SELECT *, max(CASE WHEN value IS NULL OR value >= 1 THEN date END) OVER (
          PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS brk,
        min(date) OVER (PARTITION BY series) - 1 AS start FROM rain)
    SELECT d.series AS district, d.date, round(o.spi, 6) AS spi_1m, round(t.spi, 6) AS spi_3m,
      round(w.value - n.normal, 6) AS temp_anomaly, CASE WHEN d.value IS NOT NULL
        THEN CAST(date_diff('day', coalesce(brk, start), d.date) AS INTEGER) END AS dry_days
    FROM streak d LEFT JOIN warm w ON w.series = d.series AND w.date = d.date
    LEFT JOIN normals n ON n.series = d.series AND n.month = month(d.date)
    LEFT JOIN z_one o ON o.series = d.series AND o.month_start = date_trunc('month', d.date) - INTERVAL 1 MONTH
    LEFT JOIN z t ON t.series = d.series AND t.month_start = date_trunc('month', d.date) - INTERVAL 1 MONTH""",
)
def derived_indices(spark, sf):
    made = indices.derived_indices(a.rain(spark, sf), warm(spark, sf))
    return rounded(made, 6, "spi_1m", "spi_3m", "temp_anomaly")


@query(
    "index_corr",
    f"""WITH {a.RAIN_SQL}, m AS (
      SELECT series, date, value, avg(value) OVER (PARTITION BY series ORDER BY date
        ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM rain)
    SELECT series, count(*) AS common, round(corr(value, smooth), 6) AS correlation
    FROM m WHERE value IS NOT NULL GROUP BY 1""",
)
def index_corr(spark, sf):
    daily = a.rain(spark, sf)
    smooth = windows.moving_average(daily, 5)
    df = audits.index_correlation(daily, smooth, ("series", "date"), "value", "smooth")
    return rounded(df, 6, "correlation")


@query(
    "normal_panel",
    f"""WITH {a.REGIONS_SQL}, {NORMALS.format(t='regions')}, m AS (
      SELECT series, CAST(date_trunc('month', date) AS DATE) AS month_start,
        CAST(month(min(date)) AS INTEGER) AS month, avg(value) AS mean, count(value) AS days
      FROM regions GROUP BY 1, 2)
    SELECT m.series, month_start, m.month, days, round(mean, 6) AS mean,
      round(normal, 6) AS normal, round(mean - normal, 6) AS departure
    FROM m LEFT JOIN normals n ON n.series = m.series AND n.month = m.month""",
)
def normal_panel(spark, sf):
    daily = a.regions(spark, sf)
    monthly = daily.groupBy("series", F.trunc("date", "month").alias("month_start")).agg(
        F.month(F.min("date")).alias("month"),
        F.avg("value").alias("mean"),
        F.count("value").alias("days"),
    )
    panel = monthly.join(spi.climatology(daily), ["series", "month"], "left").withColumn(
        "departure", F.col("mean") - F.col("normal")
    )
    return rounded(panel, 6, "mean", "normal", "departure")


# --- spectra ------------------------------------------------------------------------------

COMPLETE = f"""{a.RAIN_SQL}, filled AS (
      SELECT *, avg(value) OVER (PARTITION BY series ORDER BY date
        ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS fill FROM rain), facts AS (
      SELECT series, date_diff('day', min(date), max(date)) + 1 AS n, avg(coalesce(value, fill)) AS mean, min(date) AS start,
        date_diff('day', min(date), max(date)) + 1 - count(coalesce(value, fill)) AS missing
      FROM filled GROUP BY 1),
    ready AS (
      SELECT f.series, date_diff('day', start, date) AS t, n, missing, coalesce(value, fill) - mean AS v
      FROM filled f JOIN facts ON facts.series = f.series)"""
SPECTRA = f"""{COMPLETE}, spectra AS (
      SELECT r.series, k, n, k * 1e0 / n AS frequency, max(missing) AS missing,
        CASE WHEN max(missing) = 0 THEN sqrt(pow(sum(v * cos(2 * pi() * k * t / n)), 2)
          + pow(sum(v * sin(2 * pi() * k * t / n)), 2)) * 2 / n END AS magnitude
      FROM ready r JOIN (SELECT series, unnest(range(1, n // 2 + 1)) AS k FROM facts) b
        ON b.series = r.series GROUP BY 1, 2, 3)"""
NEAREST = """pick AS (
      SELECT series, target, arg_min(k, abs(frequency - f) * 1e6 + k * 1e-9) AS k
      FROM spectra, (VALUES ('annual', 1/365.25e0), ('semiannual', 2/365.25e0)) t(target, f)
      GROUP BY 1, 2)"""


def _complete(spark, sf):
    filled = windows.impute_moving_mean(a.rain(spark, sf))
    return filled.select("series", "date", F.col("filled").alias("value"))


CYCLES = {"annual": spectrum.ANNUAL, "semiannual": spectrum.SEMIANNUAL}


@query(
    "spectrum_bins",
    f"""WITH {SPECTRA}, {NEAREST}
    SELECT s.series, p.target, CAST(s.k AS INTEGER) AS k, n, round(n / (s.k * 1e0), 6) AS period,
      round(magnitude, 6) AS magnitude, missing
    FROM spectra s JOIN pick p ON p.series = s.series AND p.k = s.k""",
)
def spectrum_bins(spark, sf):
    df = spectrum.spectrum_at(_complete(spark, sf), CYCLES, on_gap="null")
    return rounded(df, 6, "period", "magnitude")


@query(
    "spectrum_full",
    f"""WITH {SPECTRA} SELECT series, CAST(k AS INTEGER) AS k, n, round(frequency, 9) AS frequency,
      round(magnitude, 6) AS magnitude, missing FROM spectra""",
)
def spectrum_full(spark, sf):
    df = spectrum.spectrum(_complete(spark, sf), on_gap="null").where("k > 0")
    return rounded(rounded(df, 9, "frequency"), 6, "magnitude")


@query(
    "nearest_bin",
    f"""WITH {SPECTRA}, {NEAREST}
    SELECT s.series, CAST(s.k AS INTEGER) AS k, round(1 / frequency, 6) AS period,
      round(magnitude, 6) AS magnitude, missing
    FROM spectra s JOIN pick p ON p.series = s.series AND p.k = s.k WHERE target = 'annual'""",
)
def nearest_bin(spark, sf):
    df = spectrum.spectrum_at(_complete(spark, sf), {"annual": spectrum.ANNUAL}, on_gap="null")
    return rounded(df.drop("target", "n"), 6, "period", "magnitude")


@query(
    "seasonal_ratio",
    f"""WITH {SPECTRA}, {NEAREST}, am AS (
      SELECT s.series, max(CASE WHEN target = 'annual' THEN magnitude END) AS annual,
        max(CASE WHEN target = 'semiannual' THEN magnitude END) AS semiannual
      FROM spectra s JOIN pick p ON p.series = s.series AND p.k = s.k GROUP BY 1)
    SELECT series, round(annual, 6) AS annual, round(semiannual, 6) AS semiannual,
      round(semiannual / nullif(annual, 0), 5) AS ratio FROM am""",
)
def seasonal_ratio(spark, sf):
    df = spectrum.seasonal_ratio(
        spectrum.spectrum_at(_complete(spark, sf), CYCLES, on_gap="null")
    )
    return rounded(rounded(df, 6, "annual", "semiannual"), 5, "ratio")


@query(
    "spectral_peaks",
    f"""WITH RECURSIVE {SPECTRA}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY magnitude DESC, k) AS r
      FROM spectra WHERE missing = 0), greedy AS (
      SELECT series, 0 AS r, CAST([] AS BIGINT[]) AS chosen FROM facts WHERE missing = 0
      UNION ALL
      SELECT g.series, g.r + 1, CASE WHEN len(g.chosen) < 5
          AND len(list_filter(g.chosen, lambda c: abs(c - x.k) < 3)) = 0
        THEN list_append(g.chosen, x.k) ELSE g.chosen END
      FROM greedy g JOIN ranked x ON x.series = g.series AND x.r = g.r + 1 WHERE g.r < 60),
    final AS (SELECT series, unnest(chosen) AS k, generate_subscripts(chosen, 1) AS rank
      FROM greedy WHERE r = 60)
    SELECT f.series, CAST(f.rank AS INTEGER) AS rank, CAST(f.k AS INTEGER) AS k,
      round(1 / frequency, 6) AS period, round(magnitude, 6) AS magnitude, missing
    FROM final f JOIN spectra s ON s.series = f.series AND s.k = f.k
    UNION ALL SELECT series, NULL, NULL, NULL, NULL, missing FROM facts WHERE missing > 0""",
)
def spectral_peaks(spark, sf):
    spectra = spectrum.spectrum(_complete(spark, sf), on_gap="null")
    return rounded(spectrum.spectral_peaks(spectra), 6, "period", "magnitude")


@query(
    "bimodality",
    f"""WITH {SPECTRA}, {NEAREST}, am AS (
      SELECT s.series, max(CASE WHEN target = 'annual' THEN magnitude END) AS annual,
        max(CASE WHEN target = 'semiannual' THEN magnitude END) AS semiannual
      FROM spectra s JOIN pick p ON p.series = s.series AND p.k = s.k GROUP BY 1),
    curve AS (
      SELECT series, t, n, CASE WHEN t % 365 BETWEEN 121 AND 334
        THEN 10 * pow(greatest(sin(pi() * ((t % 365) - 121) / 213e0), 0), 0.35e0) ELSE 0e0 END AS c
      FROM ready), cm AS (SELECT series, avg(c) AS m FROM curve GROUP BY 1), nul AS (
      SELECT c.series, target,
        sqrt(pow(sum((c - m) * cos(2 * pi() * k * t / n)), 2)
          + pow(sum((c - m) * sin(2 * pi() * k * t / n)), 2)) * 2 / n AS magnitude
      FROM curve c JOIN cm ON cm.series = c.series JOIN pick p ON p.series = c.series
      GROUP BY c.series, target, n), nr AS (
      SELECT series, max(CASE WHEN target = 'semiannual' THEN magnitude END)
        / max(CASE WHEN target = 'annual' THEN magnitude END) AS null_ratio FROM nul GROUP BY 1),
    dom AS (SELECT series, arg_max(k, magnitude) AS k FROM spectra WHERE missing = 0 GROUP BY 1)
    SELECT am.series, round(annual, 6) AS annual, round(semiannual, 6) AS semiannual,
      round(semiannual / annual, 5) AS ratio, round(null_ratio, 5) AS null_ratio,
      CAST(dom.k AS INTEGER) AS dominant_k, dom.k = p.k AS annual_dominates,
      semiannual / annual > 1.5e0 * null_ratio AS bimodal
    FROM am JOIN nr ON nr.series = am.series LEFT JOIN dom ON dom.series = am.series
    JOIN pick p ON p.series = am.series AND p.target = 'annual'""",
)
def bimodality(spark, sf):
    df = spectrum.bimodality(_complete(spark, sf), on_gap="null")
    return rounded(rounded(df, 6, "annual", "semiannual"), 5, "ratio", "null_ratio")


@query(
    "homogeneity",
    f"""WITH {SPECTRA}, {NEAREST}, am AS (
      SELECT s.series, max(CASE WHEN target = 'semiannual' THEN magnitude END)
        / max(CASE WHEN target = 'annual' THEN magnitude END) AS ratio
      FROM spectra s JOIN pick p ON p.series = s.series AND p.k = s.k GROUP BY 1)
    SELECT round(min(ratio), 5) AS lowest, round(max(ratio), 5) AS highest,
      round(max(ratio) / min(ratio), 4) AS times FROM am""",
)
def homogeneity(spark, sf):
    ratios = spectrum.seasonal_ratio(
        spectrum.spectrum_at(_complete(spark, sf), CYCLES, on_gap="null")
    )
    return rounded(rounded(spectrum.homogeneity(ratios), 5, "lowest", "highest"), 4, "times")
