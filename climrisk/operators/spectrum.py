"""Amplitude spectra of gap-free daily series and their reading.

Bins are numbered k = 1 .. n // 2; bin 0 is the removed mean. Amplitudes are 2 / n times the
transform, so a yearly wave of 10 mm comes out as 10. Series enter unsmoothed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climrisk.functions import checks

# Length of a year in days; the two cycles that matter.
YEAR_DAYS = 365.25
ANNUAL, SEMIANNUAL = 1 / YEAR_DAYS, 2 / YEAR_DAYS
# Rainy season of the one-peak comparison curve, and the decision factor.
SEASON_START, SEASON_END, SEASON_PEAK, SEASON_POWER = 121, 334, 10.0, 0.35
BIMODAL_FACTOR = 1.5


def gap_report(df: DataFrame, *, value: str = "value", series: str = "series") -> DataFrame:
    """Length and missing days per series; only complete ones can be transformed."""
    return df.groupBy(series).agg(
        F.count("*").alias("n"), (F.count("*") - F.count(value)).alias("missing")
    )


def series_facts(
    df: DataFrame,
    *,
    on_gap: str = "error",
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Calendar length n, missing days, start and mean of every series; `_sound`: it can be transformed.

    A series with a gap, or of fewer than two days, fails the job (`error`) or stays without
    magnitudes (`null`); it is never filled here. The failure is raised inside the plan, so nothing
    is counted ahead of time. Days without a row and days without a value are missing alike.
    """
    checks.one_of("on_gap", on_gap, ("error", "null"))
    facts = df.groupBy(series).agg(
        F.min(date).alias("_start"),
        (F.datediff(F.max(date), F.min(date)) + 1).cast("long").alias("n"),
        F.count("*").alias("_rows"),
        F.count(value).alias("_values"),
        F.avg(value).alias("_mean"),
    )
    missing = F.col("n") - F.col("_values")
    sound = (missing == 0) & (F.col("_rows") == F.col("n")) & (F.col("n") >= 2)
    if on_gap == "error":
        text = F.concat(
            F.lit("spectrum needs a gap-free series of at least 2 values: "),
            F.col(series).cast("string"),
            F.lit(" lacks "),
            missing.cast("string"),
        )
        sound = F.when(sound, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return facts.select(series, "n", missing.alias("missing"), "_start", "_mean", sound.alias("_sound"))


def _departures(df: DataFrame, facts: DataFrame, value: str, series: str, date: str) -> DataFrame:
    """Position t, length n and departure v from the mean, for the series that can be transformed."""
    return df.join(facts.where("_sound"), series).select(
        series,
        F.datediff(date, "_start").cast("long").alias("t"),
        "n",
        (F.col(value) - F.col("_mean")).alias("v"),
    )


def _turned(re: Column, im: Column, part: Column, whole: Column) -> tuple[Column, Column]:
    """A complex number turned back by part / whole of a circle; whole numbers keep the angle exact."""
    angle = -2 * math.pi * (part % whole) / whole
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def _transform(z: DataFrame, key: str, last: Column) -> DataFrame:
    """Discrete Fourier transform in two steps: key, n, k, re, im for k from 0 to `last`.

    `z`: key, n, rows (a divisor of n), t, re, im; positions without a row count as zero. With
    n = rows * columns, t = columns * a + b and k = p + rows * q, the first step sums over a for every
    (key, b, p), the second one, after a turn by p * b / n, over b for every (key, p, q). A step's sums
    need one shuffle by (key, b) or (key, p), so one long series spreads over many tasks.
    """
    rows, columns = F.col("rows"), F.floor(F.col("n") / F.col("rows"))
    parts = z.withColumns({"_a": F.floor(F.col("t") / columns), "_b": F.col("t") % columns}).repartition(key, "_b")
    inner = parts.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)))
    re, im = _turned(F.col("re"), F.col("im"), F.col("_p") * F.col("_a"), rows)
    inner = inner.groupBy(key, "n", "rows", "_b", "_p").agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))
    re, im = _turned(F.col("_re"), F.col("_im"), F.col("_p") * F.col("_b"), F.col("n"))
    outer = inner.select(key, "n", "rows", "_b", "_p", re.alias("re"), im.alias("im")).where(F.col("_p") <= last).repartition(key, "_p")
    most = F.floor((last - F.col("_p")) / rows)
    outer = outer.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), most)))
    re, im = _turned(F.col("re"), F.col("im"), F.col("_q") * F.col("_b"), columns)
    sums = outer.groupBy(key, "n", "rows", "_p", "_q").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return sums.select(key, "n", (F.col("_p") + rows * F.col("_q")).alias("k"), "re", "im")


def _split(n: Column) -> Column:
    """Largest divisor of n up to its root."""
    return F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n))), lambda d: n % d == 0))


#: A length whose larger factor is over this many times its root is transformed by way of a power of two.
UNEVEN = 32


def _by_chirp(z: DataFrame, key: str) -> DataFrame:
    """The transform of lengths without a good split, as a convolution with a chirp.

    With w(t) = exp(-i pi t^2 / n), X(k) = w(k) * sum of x(t) w(t) / w(k - t): one transform of x w, one
    of 1 / w for every length, and one back, all of a power of two over twice the length.
    """
    n = F.col("n")
    power = F.ceil(F.log2((2 * n).cast("double")))
    size = F.pow(F.lit(2.0), power).cast("long")
    root = _root(size)
    square = lambda t: t * t

    re, im = _turned(F.col("re"), F.col("im"), square(F.col("t")), 2 * n)
    signal = z.select(key, F.col("n").alias("_n"), "t", re.alias("re"), im.alias("im"), size.alias("n"), root.alias("rows"))
    lengths = z.select("n").distinct()
    chirp = lengths.select("n", F.explode(F.sequence(1 - n, n - 1)).alias("_t"))
    re, im = _turned(F.lit(1.0), F.lit(0.0), square(F.col("_t")), 2 * n)
    chirp = chirp.select(n.alias("_n"), F.pmod("_t", size).alias("t"), re.alias("re"), (-im).alias("im"), size.alias("n"), root.alias("rows"))
    known = F.col("n") - 1
    one = _transform(signal.drop("_n"), key, known)
    other = _transform(chirp, "_n", known).select("_n", "k", F.col("re").alias("_cr"), F.col("im").alias("_ci"))
    own = z.select(key, F.col("n").alias("_n")).distinct()
    product = one.join(own, key).join(other, ["_n", "k"])
    # The transform back is the conjugate of the transform of the conjugate.
    back = product.select(
        key,
        "n",
        _root(F.col("n")).alias("rows"),
        F.col("k").alias("t"),
        (F.col("re") * F.col("_cr") - F.col("im") * F.col("_ci")).alias("re"),
        (-(F.col("re") * F.col("_ci") + F.col("im") * F.col("_cr"))).alias("im"),
    )
    found = _transform(back, key, known).join(own, key).where(F.col("k") <= F.floor(F.col("_n") / 2))
    re, im = _turned(F.col("re") / F.col("n"), -F.col("im") / F.col("n"), square(F.col("k")), 2 * F.col("_n"))
    return found.select(key, F.col("_n").alias("n"), "k", re.alias("re"), im.alias("im"))


def _root(size: Column) -> Column:
    """The power of two next below or at the root of a power of two."""
    return F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double")) / 2 + 1e-9)).cast("long")


def spectrum(
    df: DataFrame,
    rate: float = 1.0,
    *,
    on_gap: str = "error",
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """series, k, n, frequency, magnitude, missing: all bins of every series, from 0 to n // 2.

    The transform runs as sums over rows, see `_transform`; no task holds a whole series. With
    `on_gap="null"` a series that can't be transformed has its bins with a NULL magnitude and the
    number of days it lacks.
    """
    checks.positive("sampling rate", rate)
    facts = series_facts(df, on_gap=on_gap, value=value, series=series, date=date)
    ready = _departures(df, facts, value, series, date).select(
        series, "n", "t", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"), _split(F.col("n")).alias("rows")
    )
    even = F.col("n") <= UNEVEN * F.col("rows") * F.sqrt("n")
    direct = _transform(ready.where(even), series, F.floor(F.col("n") / 2))
    found = direct.unionByName(_by_chirp(ready.where(~even).drop("rows"), series))
    whole = found.select(series, "n", "k", (F.hypot("re", "im") * 2 / F.col("n")).alias("magnitude"), F.lit(0).cast("long").alias("missing"))
    bins = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2)))
    gapped = facts.where(~F.col("_sound")).select(series, "n", bins.alias("k"), F.lit(None).cast("double").alias("magnitude"), "missing")
    return whole.unionByName(gapped).select(
        series, F.col("k").cast("int").alias("k"), "n", (F.col("k") * rate / F.col("n")).alias("frequency"), "magnitude", "missing"
    )


def nearest_bin_number(n: Column, frequency: float, rate: float = 1.0) -> Column:
    """Bin whose frequency lies closest, never bin 0; a tie goes to the lower bin."""
    below = F.floor(n * frequency / rate)
    low = F.greatest(F.lit(1), F.least(below, F.floor(n / 2)))
    high = F.greatest(F.lit(1), F.least(below + 1, F.floor(n / 2)))
    away = lambda k: F.abs(k * rate / n - frequency)
    return F.when(away(high) < away(low), high).otherwise(low).cast("int")


def spectrum_at(
    df: DataFrame,
    targets: dict[str, float],
    rate: float = 1.0,
    *,
    on_gap: str = "error",
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Amplitude at the bins nearest to a few target frequencies, as plain sums.

    The sums combine map-side, so no series is gathered anywhere. With `on_gap="null"` a series that
    can't be transformed has its bins with a NULL magnitude and the number of days it lacks.
    """
    checks.positive("sampling rate", rate)
    facts = series_facts(df, on_gap=on_gap, value=value, series=series, date=date)
    wanted = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(name).alias("target"),
                    nearest_bin_number(F.col("n"), f, rate).alias("k"),
                )
                for name, f in targets.items()
            )
        )
    )
    bins = facts.select(series, "n", "missing", wanted.alias("_w")).select(series, "n", "missing", "_w.*")
    re, im = _turned(F.col("v"), F.lit(0.0), F.col("k") * F.col("t"), F.col("n"))
    sums = (
        _departures(df, facts, value, series, date)
        .select("*", wanted.alias("_w"))
        .select(series, "t", "n", "v", "_w.*")
        .groupBy(series, "target")
        .agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))
    )
    return bins.join(sums, [series, "target"], "left").select(
        series,
        "target",
        "k",
        "n",
        (F.col("n") / (F.col("k") * rate)).alias("period"),
        (F.hypot("_re", "_im") * 2 / F.col("n")).alias("magnitude"),
        "missing",
    )


def period(frequency: Column) -> Column:
    return F.when(frequency != 0, 1 / frequency)


def nearest_bin(spectra: DataFrame, frequency: float, *, series: str = "series") -> DataFrame:
    """The bin closest to a frequency, its period and magnitude, read from full spectra."""
    away = F.struct(F.abs(F.col("frequency") - frequency), F.col("k"))
    best = F.min_by(F.struct("k", "frequency", "magnitude"), away)
    return (
        spectra.where("k > 0")
        .groupBy(series)
        .agg(best.alias("b"))
        .select(series, "b.k", period(F.col("b.frequency")).alias("period"), "b.magnitude")
    )


def seasonal_ratio(amplitudes: DataFrame, *, series: str = "series") -> DataFrame:
    """Semiannual over annual amplitude; NULL, not zero, when there is no annual cycle."""
    pick = lambda name: F.max(F.when(F.col("target") == name, F.col("magnitude")))
    return (
        amplitudes.groupBy(series)
        .agg(pick("annual").alias("annual"), pick("semiannual").alias("semiannual"))
        .withColumn("ratio", F.col("semiannual") / F.nullif(F.col("annual"), F.lit(0.0)))
    )


def spectral_peaks(
    spectra: DataFrame, how_many: int = 5, separation: int = 3, *, series: str = "series"
) -> DataFrame:
    """The highest bins at least `separation` bins apart, taken greedily; ties go low.

    A series without magnitudes comes back as one row with a NULL rank and what it lacks.

    A chosen bin rules out at most 2 * separation - 1 bins, so how_many * (2 * separation - 1)
    of the highest bins always hold the answer and only those are kept per series.
    """
    checks.window_at_least(separation)
    checks.window_at_least(how_many)
    enough = how_many * (2 * separation - 1)
    order = Window.partitionBy(series).orderBy(F.desc("magnitude"), F.asc("k"))
    top = (
        spectra.where("k > 0 AND magnitude IS NOT NULL")
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= enough)
        .groupBy(series)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("_r", "k", "frequency", "magnitude"))
            ).alias("_all")
        )
    )
    empty = F.filter("_all", lambda _: F.lit(False))

    def take(chosen, bin_):
        apart = F.forall(chosen, lambda c: F.abs(c["k"] - bin_["k"]) >= separation)
        room = F.size(chosen) < how_many
        return F.when(apart & room, F.concat(chosen, F.array(bin_))).otherwise(chosen)

    none = F.lit(None)
    gapped = spectra.where("k > 0 AND magnitude IS NULL").groupBy(series).agg((F.max("missing") if "missing" in spectra.columns else F.lit(None).cast("long")).alias("missing"))
    gapped = gapped.select(
        series, none.cast("int").alias("rank"), none.cast("int").alias("k"), none.cast("double").alias("period"), none.cast("double").alias("magnitude"), "missing"
    )
    peaks = (
        top.select(series, F.posexplode(F.aggregate("_all", empty, take)).alias("p", "b"))
        .select(
            series,
            (F.col("p") + 1).alias("rank"),
            "b.k",
            period(F.col("b.frequency")).alias("period"),
            "b.magnitude",
            F.lit(0).cast("long").alias("missing"),
        )
    )
    return peaks.unionByName(gapped)


def one_season_curve(day: Column) -> Column:
    """Rain of a single plateau season without a mid-season pause, by day position."""
    d = day % int(YEAR_DAYS)
    share = (d - SEASON_START) / (SEASON_END - SEASON_START)
    wave = F.pow(F.greatest(F.sin(math.pi * share), F.lit(0.0)), F.lit(SEASON_POWER))
    return F.when(d.between(SEASON_START, SEASON_END), SEASON_PEAK * wave).otherwise(0.0)


def bimodality(
    df: DataFrame,
    *,
    on_gap: str = "error",
    value: str = "value",
    series: str = "series",
    date: str = "date",
) -> DataFrame:
    """Is the half-year cycle more than the harmonic of one season's shape?

    The comparison ratio comes from the one-season curve over the same number of days; a series
    is bimodal when its ratio exceeds it by the decision factor. With `on_gap="null"` a series that
    can't be transformed comes back with NULL answers.
    """
    cycles = {"annual": ANNUAL, "semiannual": SEMIANNUAL}
    opts = {"on_gap": on_gap, "value": value, "series": series, "date": date}
    seen = seasonal_ratio(spectrum_at(df, cycles, **opts), series=series)
    starts = df.groupBy(series).agg(F.min(date).alias("_start"))
    curve = df.join(starts, series).select(
        series, date, one_season_curve(F.datediff(date, "_start")).alias("_curve")
    )
    null = seasonal_ratio(
        spectrum_at(curve, cycles, **(opts | {"value": "_curve", "on_gap": "null"})), series=series
    ).select(series, F.col("ratio").alias("null_ratio"))
    top = (
        spectrum(df, **opts)
        .where("k > 0 AND magnitude IS NOT NULL")
        .groupBy(series)
        .agg(
            F.max_by(F.struct("k", "n"), F.struct(F.col("magnitude"), -F.col("k"))).alias("d")
        )
        .select(
            series,
            F.col("d.k").alias("dominant_k"),
            (F.col("d.k") == nearest_bin_number(F.col("d.n"), ANNUAL)).alias("annual_dominates"),
        )
    )
    return (
        seen.join(null, series, "left")
        .join(top, series, "left")
        .withColumn("bimodal", F.col("ratio") > BIMODAL_FACTOR * F.col("null_ratio"))
    )


def homogeneity(ratios: DataFrame) -> DataFrame:
    """Spread of the ratio between series."""
    return ratios.agg(
        F.min("ratio").alias("lowest"),
        F.max("ratio").alias("highest"),
        (F.max("ratio") / F.nullif(F.min("ratio"), F.lit(0.0))).alias("times"),
    )
