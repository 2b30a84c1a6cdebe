"""Calendars and ordered operators, against hand values and brute force on short blocks."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from climrisk.functions.kernels import smoothing_matrix
from climrisk.operators import blocks, calendar, windows
from climrisk.operators.blocks import carried, running_sum
from tests.conftest import EPOCH

D = datetime.date


def noisy(n, seed, gap=0.25):
    r = random.Random(seed)
    return [None if r.random() < gap else float(r.randint(0, 9)) for _ in range(n)]


@pytest.mark.parametrize("block", [3, 7, 2048])
def test_densify_equals_left_join(spark, daily, block):
    data = {"a": noisy(60, 1, 0.7), "b": noisy(60, 2, 0.9), "empty": [None] * 60}
    rows = daily(data).where("value IS NOT NULL")
    members = spark.createDataFrame([(s,) for s in [*data, "ghost"]], "series string")
    lo, hi = EPOCH - datetime.timedelta(days=4), EPOCH + datetime.timedelta(days=70)
    got = calendar.densify(rows, lo, hi, members=members, block_days=block)
    want = calendar.calendar(members, lo, hi).join(rows, ["series", "date"], "left")
    assert got.count() == 4 * 75
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_densify_keeps_duplicates_and_drops_unknown_series(spark, daily):
    rows = daily(a=[1, 2]).unionByName(daily(a=[5])).unionByName(daily(x=[9]))
    members = spark.createDataFrame([("a",)], "series string")
    got = calendar.densify(rows, EPOCH, EPOCH + datetime.timedelta(days=2), members=members)
    assert sorted((r.date, r.value) for r in got.collect() if r.value is not None) == [
        (EPOCH, 1.0),
        (EPOCH, 5.0),
        (EPOCH + datetime.timedelta(days=1), 2.0),
    ]
    assert got.count() == 4


def test_densify_keeps_missing_days_null_and_counts_zero(daily):
    rows = daily(a=[1, None, 3]).where("value IS NOT NULL")
    got = [r.value for r in calendar.densify(rows).orderBy("date").collect()]
    assert got == [1.0, None, 3.0]
    zero = calendar.densify_counts(rows.withColumnRenamed("value", "n"), "n")
    assert [r.n for r in zero.orderBy("date").collect()] == [1.0, 0.0, 3.0]


def test_range_read_is_inclusive_and_checks_order(daily):
    df = daily(a=[1, 2, 3, 4])
    got = calendar.series_range(df, "a", D(1995, 1, 2), D(1995, 1, 3))
    assert got.count() == 2
    assert calendar.series_range(df, "nobody", D(1995, 1, 2), D(1995, 1, 3)).count() == 0
    with pytest.raises(ValueError):
        calendar.series_range(df, "a", D(1995, 1, 3), D(1995, 1, 2))


def test_tiles_are_contiguous_and_clamp_leap_day(spark):
    df = spark.createDataFrame(
        [("x", D(2000, 2, 29), D(2040, 6, 1)), ("y", D(1991, 1, 1), D(1991, 1, 1))],
        "id string, start_date date, end_date date",
    )
    got = [
        (r.id, r.tile_start, r.tile_end)
        for r in calendar.range_tiles(df).orderBy("id", "tile").collect()
    ]
    assert got == [
        ("x", D(2000, 2, 29), D(2019, 2, 28)),
        ("x", D(2019, 3, 1), D(2038, 3, 1)),
        ("x", D(2038, 3, 2), D(2040, 6, 1)),
        ("y", D(1991, 1, 1), D(1991, 1, 1)),
    ]


def test_overlapping_tiles_are_refused(daily):
    with pytest.raises(ValueError, match="overlap"):
        calendar.union_tiles([daily(a=[1, 2]), daily(a=[1])])
    assert calendar.union_tiles([daily(a=[1, 2]), daily(b=[1])]).count() == 3


@pytest.mark.parametrize("block", [4, 5, 2048])
def test_rolling_sum_matches_brute_force(daily, column, block):
    data = {"a": noisy(50, 3), "b": noisy(50, 4)}
    got = column(windows.rolling_sum(daily(data), 3, block_days=block), "total")
    for name, v in data.items():
        want = [
            sum(v[i - 2 : i + 1]) if i >= 2 and None not in v[i - 2 : i + 1] else None
            for i in range(50)
        ]
        assert got[name] == want


def test_rolling_sum_treats_absent_rows_as_gaps(daily, column):
    rows = daily(a=[1, None, 3, 4, 5]).where("value IS NOT NULL")
    assert column(windows.rolling_sum(rows, 2), "total")["a"] == [None, None, 7.0, 9.0]
    with pytest.raises(ValueError):
        windows.rolling_sum(rows, 0)


@pytest.mark.parametrize("block", [5, 2048])
def test_moving_average(daily, column, block):
    v = [None, 2, 4, None, 9]
    got = column(windows.moving_average(daily(a=v), 3, block_days=block), "smooth")["a"]
    assert got == [None, 3.0, 3.0, None, 9.0]


def local_fit(run, window, order):
    """Least squares by numpy on each window, as the definition states it."""
    n, h, out = len(run), window // 2, []
    if n < window:
        return list(run)
    for i in range(n):
        first = min(max(i - h, 0), n - window)
        x = np.arange(window)
        out.append(
            float(np.polyval(np.polyfit(x, run[first : first + window], order), i - first))
        )
    return out


@pytest.mark.parametrize("window,order", [(5, 2), (7, 2), (7, 3)])
@pytest.mark.parametrize("block", [9, 2048])
def test_smoothing_matches_polynomial_fits(daily, column, window, order, block):
    v = noisy(70, 5, 0.06)
    got = column(windows.smooth(daily(a=v), window, order, block_days=block), "smooth")["a"]
    want, i = [None] * len(v), 0
    while i < len(v):
        if v[i] is None:
            i += 1
            continue
        j = i
        while j < len(v) and v[j] is not None:
            j += 1
        want[i:j] = local_fit(v[i:j], window, order)
        i = j
    for a, b in zip(got, want):
        assert (a is None) == (b is None)
        assert a is None or a == pytest.approx(b, abs=1e-9)


def test_smoothing_golden_cases(daily, column):
    peak = [0.0] * 10 + [100.0] + [0.0] * 10
    assert column(windows.smooth(daily(a=peak), 5), "smooth")["a"][10] == pytest.approx(1700 / 35)
    gaps = [1, 2, None, 4, 5, None, 7, 8, 9]
    got = column(windows.smooth(daily(a=gaps), 3), "smooth")["a"]
    assert [i for i, x in enumerate(got) if x is None] == [2, 5]
    assert got[6:] == pytest.approx([7, 8, 9])
    short = [1, 9, 1, None] + [5.0] * 8
    assert column(windows.smooth(daily(a=short), 7), "smooth")["a"][:3] == [1.0, 9.0, 1.0]
    apart = [10.0] * 9 + [None] + [0.0] * 9
    got = column(windows.smooth(daily(a=apart), 5), "smooth")["a"]
    assert got[8] == pytest.approx(10) and got[10] == pytest.approx(0)
    assert smoothing_matrix(7, 2)[3][0] == pytest.approx(-2 / 21)


def test_smoothing_refuses_bad_windows_and_rain(daily):
    df = daily(a=[1, 2, 3])
    for window, order in ((4, 2), (3, 3), (3, 0)):
        with pytest.raises(ValueError):
            windows.smooth(df, window, order)
    with pytest.raises(ValueError, match="never smoothed"):
        windows.smooth(df, variable="precip_mm")


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_runs(daily, block):
    data = {"a": noisy(60, 6, 0.4), "full": [1.0] * 20, "none": [None, None]}
    got = sorted(
        (r.series, (r.run_start - EPOCH).days, (r.run_end - EPOCH).days, r.days)
        for r in windows.runs(daily(data), block_days=block).collect()
    )
    want = []
    for name, v in data.items():
        i = 0
        while i < len(v):
            if v[i] is None:
                i += 1
                continue
            j = i
            while j < len(v) and v[j] is not None:
                j += 1
            want.append((name, i, j, j - i))
            i = j
    assert got == sorted(want)


@pytest.mark.parametrize("block", [2, 5, 2048])
def test_dry_streak(daily, column, block):
    v = [0, 0, 5, 0, 0.5, None, 0, 0, 0, 2, 0, 0]
    got = column(windows.dry_streak(daily(a=v), block_days=block), "dry_days")["a"]
    assert got == [1, 2, 0, 1, 2, None, 1, 2, 3, 0, 1, 2]


@pytest.mark.parametrize("block", [2, 6, 2048])
def test_linear_imputation(daily, column, block):
    v = [None, 1, None, None, 4, None, None, None, None, 9, None]
    out = windows.impute_linear(daily(a=v), 3, block_days=block)
    assert column(out, "filled")["a"] == [None, 1, 2, 3, 4, None, None, None, None, 9, None]
    assert column(out, "imputed")["a"] == [False, False, True, True] + [False] * 7
    assert column(out, "imputation_method")["a"][2] == "interpolacion_lineal"


def test_imputation_tasks_follow_the_rows(daily, column, monkeypatch):
    v = [1, None, None, 4, *noisy(60, 5, 0.7)]
    df = daily(a=v, b=v[::-1])
    whole = column(windows.impute_linear(df, 3, block_days=8), "filled")
    monkeypatch.setattr(blocks, "TASK_ROWS", 16)
    out = windows.impute_linear(df, 3, block_days=8, rows=128)
    assert column(out, "filled") == whole
    # 128 rows of 16 a task, where the session has 4 partitions.
    assert "RepartitionByExpression" in (plan := out._jdf.queryExecution().logical().toString()) and ", 8" in plan


@pytest.mark.parametrize("block", [4, 2048])
def test_carry_and_running_sum_cross_blocks(daily, column, block):
    v = noisy(40, 7, 0.8)
    df = daily(a=v)
    both = carried(df, {"p": F.col("value")}, {"n": F.col("value")}, block_days=block)
    got_p, got_n = column(both, "p")["a"], column(both, "n")["a"]
    for i in range(40):
        seen = [x for x in v[: i + 1] if x is not None]
        later = [x for x in v[i:] if x is not None]
        assert got_p[i] == (seen[-1] if seen else None)
        assert got_n[i] == (later[0] if later else None)
    sums = column(running_sum(df, {"s": F.col("value")}, block_days=block), "s")["a"]
    assert sums == [sum(x for x in v[: i + 1] if x is not None) for i in range(40)]


def test_resample_keeps_exactly_half(daily):
    df = daily(a=[1, None, None, None, 1, 2, None, None, 8])
    for how, want in (("mean", 1.5), ("sum", 3.0), ("max", 2.0), ("min", 1.0)):
        got = [r.value for r in windows.resample(df, 4, how).orderBy("block").collect()]
        assert got == [None, want, 8.0]
    with pytest.raises(ValueError):
        windows.resample(df, 0, "mean")
    with pytest.raises(ValueError):
        windows.resample(df, 2, "median")


def test_resample_counts_absent_rows_as_missing(daily):
    df = daily(a=[3.0, None, 3.0, None, None, 3.0, None, None, None, None, 4.0])
    for rows in (df, df.where("value IS NOT NULL")):
        got = windows.resample(rows, 10, "mean").orderBy("block").collect()
        assert [(r.block, r.present, r.value) for r in got] == [(0, 3, None), (1, 1, 4.0)]


def test_smoothing_takes_absent_rows_as_gaps(daily, column):
    df = daily(a=[float(i * i % 11) for i in range(9)] + [None] + [float(i) for i in range(10)])
    whole = windows.smooth(df, 5, 2)
    sparse = windows.smooth(df.where("value IS NOT NULL"), 5, 2)
    kept = [v for v in column(whole, "smooth")["a"] if v is not None]
    assert column(sparse, "smooth")["a"] == pytest.approx(kept, abs=1e-12)


def test_leaks_are_found_per_feature(daily):
    out = windows.lagged_features(daily(a=list(range(10))), lags=(2, -3), sums=(3,), means=(), audit=True)
    got = {r.feature: (r.rows, r.violations, r.latest_offset_days) for r in windows.leak_audit(out).collect()}
    assert got == {"lag_2": (10, 0, -2), "ahead_3": (10, 7, 3), "sum_3": (10, 0, 0)}


def test_features_never_look_ahead(daily, column):
    v = [1, 2, 3, None, 5, 6, 7, 8]
    out = windows.lagged_features(daily(a=v), lags=(1,), sums=(3,), means=(2,))
    assert column(out, "lag_1")["a"] == [None, 1, 2, 3, None, 5, 6, 7]
    assert column(out, "sum_3")["a"] == [None, None, 6, None, None, None, 18, 21]
    assert column(out, "mean_2")["a"] == [1, 1.5, 2.5, 3, 5, 5.5, 6.5, 7.5]
    row = windows.leak_audit(out).first()
    assert (row.rows, row.violations) == (8, 0)
    late = out.withColumn("touched", F.date_add("date", 1))
    assert windows.leak_audit(late).first().violations == 8


def test_outliers_are_marked_not_dropped(daily):
    out = windows.outlier_flags(daily(a=[1, 2, 2, 3, 2, 99, None, -5]), lowest=0)
    rows = out.collect()
    assert len(rows) == 8
    assert sorted(r.value for r in rows if r.outlier) == [-5.0, 99.0]
    assert [r.value for r in rows if r.impossible] == [-5.0]
