"""Data audits: keys, ranges, references, names, profiles, completeness, quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climrisk.schemas import IMPUTATION_METHODS, LEVELS, MEASURES

SENTINEL_LIMIT = -900


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass. A NULL verdict passes."""
    counts = df.agg(*(F.count_if(~ok).alias(name) for name, ok in rules.items()))
    pairs = F.explode(
        F.array(
            *(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules)
        )
    )
    return counts.select(pairs.alias("r")).select("r.*")


def measurement_rules(first_day, last_day) -> dict[str, Column]:
    """Range, ordering, window and vocabulary rules of a daily measurement."""
    c = F.col
    return {
        "rain_not_negative": c("precip_mm") >= 0,
        "wind_not_negative": c("wind_ms") >= 0,
        "radiation_not_negative": c("radiation_mj_m2") >= 0,
        "humidity_in_percent": c("humidity_pct").between(0, 100),
        "min_below_max": c("temp_min_c") <= c("temp_max_c"),
        "date_in_window": c("date").between(F.lit(first_day), F.lit(last_day)),
        "known_method": c("imputation_method").isin(*IMPUTATION_METHODS),
        "method_matches_flag": c("imputed") == (c("imputation_method") != IMPUTATION_METHODS[0]),
    }


def missing_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child values without a parent row, with how many rows use them."""
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    return used.join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def code_difference(have: DataFrame, want: DataFrame, key: str = "code") -> DataFrame:
    """Codes on one side only, marked as missing or extra."""
    h, w = have.select(key).distinct(), want.select(key).distinct()
    missing = w.join(h, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = h.join(w, key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def shared_keys(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def disagreeing_rows(a: DataFrame, b: DataFrame, keys, value: str = "value") -> DataFrame:
    """Keys of two overlapping requests whose values differ; NULL equals NULL."""
    other = b.select(*keys, F.col(value).alias("_other"))
    return (
        a.join(other, list(keys))
        .where(~F.col(value).eqNullSafe(F.col("_other")))
        .drop("_other")
    )


def name_rules(
    code_pattern: str = r"^\d{5}$",
    prefix: str = "",
    *,
    code: str = "code",
    canton: str = "canton_code",
    name: str = "name",
) -> dict[str, Column]:
    c = F.col
    return {
        "code_pattern": c(code).rlike(code_pattern),
        "code_matches_canton": F.substring(code, 1, 3).cast("int") == c(canton).cast("int"),
        "code_prefix": c(code).startswith(prefix),
        "name_trimmed": c(name) == F.trim(name),
        "name_not_blank": F.length(F.trim(name)) > 0,
        "name_intact": ~c(name).rlike("�|Ã|\\?"),
        "population_not_filler": c("population") != 0,
    }


def repeated_names(df: DataFrame, parent: str, name: str = "name") -> DataFrame:
    """Names used twice inside one parent."""
    return df.groupBy(parent, name).agg(F.count("*").alias("uses")).where("uses > 1")


def completeness(df: DataFrame, *, series: str = "series", date: str = "date") -> DataFrame:
    """Rows, first and last day and calendar length per series; equal counts mean no gap."""
    span = F.datediff(F.max(date), F.min(date)) + 1
    return df.groupBy(series).agg(
        F.count("*").alias("rows"),
        F.min(date).alias("first_day"),
        F.max(date).alias("last_day"),
        span.alias("calendar_days"),
        (F.count("*") == span).alias("complete"),
    )


def window_bounds(per_series: DataFrame) -> DataFrame:
    """Extent of the whole table, read from the per-series summary."""
    return per_series.agg(
        F.sum("rows").alias("rows"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.count_if(~F.col("complete")).alias("incomplete_series"),
    )


def null_profile(df: DataFrame, columns=MEASURES) -> DataFrame:
    """NULLs per column, rows holding a fill sentinel, and a warning when nothing is missing."""
    sentinel = F.lit(False)
    for name in columns:
        sentinel = sentinel | F.coalesce(F.col(name) <= SENTINEL_LIMIT, F.lit(False))
    nulls = {name: F.count_if(F.col(name).isNull()) for name in columns}
    found = df.agg(
        F.count("*").alias("rows"),
        F.count_if(sentinel).alias("sentinel_rows"),
        *(n.alias(f"null_{name}") for name, n in nulls.items()),
    )
    total = sum((F.col(f"null_{name}") for name in columns), F.lit(0))
    return found.withColumn("suspiciously_full", (F.col("rows") > 0) & (total == 0))


def source_mix(df: DataFrame, keys=("rain_source", "other_source")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *keys)


def spatial_variation(
    df: DataFrame, columns, *, date: str = "date", digits: int = 4
) -> DataFrame:
    """Per variable: days on which series differ, their share and the widest daily range.

    Two distinct values exist exactly when minimum and maximum differ, so the days are reduced
    with mergeable aggregates instead of sets of values.
    """
    daily = df.groupBy(date).agg(
        *(
            (F.round(F.max(c), digits) - F.round(F.min(c), digits)).alias(f"_{c}")
            for c in columns
        )
    )
    sums = daily.agg(
        F.count("*").alias("days"),
        *(F.count_if(F.col(f"_{c}") > 0).alias(f"_n_{c}") for c in columns),
        *(F.max(f"_{c}").alias(f"_r_{c}") for c in columns),
    )
    rows = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(c).alias("variable"),
                    F.col("days"),
                    F.col(f"_n_{c}").alias("days_differing"),
                    (F.col(f"_n_{c}") / F.col("days")).alias("share"),
                    F.col(f"_r_{c}").alias("widest_range"),
                )
                for c in columns
            )
        )
    )
    return sums.select(rows.alias("r")).select("r.*")


def series_totals(df: DataFrame, *, value: str = "value", series: str = "series") -> DataFrame:
    """Total per series, largest first, with the spread between largest and smallest."""
    totals = df.groupBy(series).agg(F.sum(value).alias("total"))
    ends = totals.agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    return totals.withColumn("spread", (hi - lo) / F.nullif(lo, F.lit(0.0))).orderBy(
        F.desc("total"), series
    )


def quality_report(
    dense: DataFrame, columns, source: str, *, series: str = "series", date: str = "date"
) -> DataFrame:
    """Expected and present values, share missing and main filling method per variable.

    The main method is the one of most days; of equals, the first by name.
    """
    method = (
        F.mode("imputation_method", True) if "imputation_method" in dense.columns
        else F.lit(IMPUTATION_METHODS[0])
    )
    facts = dense.groupBy(series).agg(
        F.count("*").alias("expected"),
        F.min(date).alias("period_start"),
        F.max(date).alias("period_end"),
        method.alias("imputation_method"),
        *(F.count(c).alias(f"_{c}") for c in columns),
    )
    rows = F.explode(
        F.array(
            *(
                F.struct(F.lit(c).alias("variable"), F.col(f"_{c}").alias("present"))
                for c in columns
            )
        )
    )
    return facts.select(
        series, "expected", "period_start", "period_end", "imputation_method", rows.alias("r")
    ).select(
        series,
        F.lit(source).alias("source"),
        "r.variable",
        "period_start",
        "period_end",
        "expected",
        "r.present",
        ((F.col("expected") - F.col("r.present")) * 100 / F.col("expected")).alias("pct_missing"),
        "imputation_method",
    )


def provenance(
    df: DataFrame, *, series: str = "district", date: str = "date"
) -> DataFrame:
    """Per series: rows loaded, NULL rain, NULL temperature, window, last ingestion."""
    return df.groupBy(series).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("precip_mm").isNull()).alias("null_rain"),
        F.count_if(F.col("temp_mean_c").isNull()).alias("null_temp"),
        F.min(date).alias("first_day"),
        F.max(date).alias("last_day"),
        F.max("downloaded_at").alias("last_ingestion"),
    )


def risk_rules() -> dict[str, Column]:
    """A level needs a probability and the reverse; both stay in their range."""
    c = F.col
    return {
        "probability_in_range": c("probability").between(0, 1),
        "known_level": c("level").isin(*LEVELS),
        "level_and_probability_together": c("level").isNull() == c("probability").isNull(),
    }


def detection_rules() -> dict[str, Column]:
    c = F.col
    return {
        "confidence_in_percent": c("confidence").between(0, 100),
        "latitude": c("lat").between(-90, 90),
        "longitude": c("lon").between(-180, 180),
    }


def change_log(old: DataFrame, new: DataFrame, keys, columns) -> DataFrame:
    """Added, removed and changed rows between two snapshots."""
    flat = lambda df, side: df.select(
        *keys, F.struct(*columns).alias(side), F.lit(True).alias(f"_{side}")
    )
    both = flat(old, "before").join(flat(new, "after"), list(keys), "full_outer")
    kind = (
        F.when(F.col("_before").isNull(), "added")
        .when(F.col("_after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    return (
        both.withColumn("change", kind)
        .where(F.col("change").isNotNull())
        .select(*keys, "change", "before", "after")
    )


def filter_effect(
    raw: DataFrame,
    smoothed: str,
    *,
    value: str = "value",
    series: str = "series",
    wet: float = 1.0,
) -> DataFrame:
    """What smoothing would do to rain: percentile shift, lost extremes, invented wet days.

    Percentiles run over wet days of the measured series, extremes over each side's own P99.
    """
    v, s = F.col(value), F.col(smoothed)
    both = raw.where(v.isNotNull() & s.isNotNull())
    is_wet = v >= wet
    limits = both.where(is_wet).groupBy(series).agg(
        *(
            F.percentile(c, p / 100).alias(f"p{p}_{n}")
            for n, c in (("raw", v), ("smooth", s))
            for p in (95, 99)
        )
    )
    over_raw = is_wet & (v > F.col("p99_raw"))
    over_smooth = is_wet & (s > F.col("p99_smooth"))
    return (
        both.join(limits, series)
        .groupBy(series, "p95_raw", "p95_smooth", "p99_raw", "p99_smooth")
        .agg(
            F.count("*").alias("days"),
            F.count_if(over_raw).alias("extremes_raw"),
            F.count_if(over_raw & over_smooth).alias("extremes_kept"),
            F.count_if(is_wet & (s > F.col("p99_raw"))).alias("over_raw_limit"),
            F.count_if(s < 0).alias("negative_days"),
            F.min(s).alias("lowest"),
            F.count_if(v == 0).alias("dry_days"),
            F.count_if((v == 0) & (s >= wet)).alias("dry_turned_wet"),
            F.sum(v).alias("mass_raw"),
            F.sum(s).alias("mass_smooth"),
        )
        .withColumn(
            "p99_shift_pct", (F.col("p99_smooth") - F.col("p99_raw")) / F.col("p99_raw") * 100
        )
    )


def filter_sweep(
    daily: DataFrame, sizes=(3, 5, 7, 11), order: int = 2, *, value: str = "value", **where
) -> DataFrame:
    """The same audit for several smoothing windows, smoothed values kept to nine decimals.

    With three points a parabola passes through all of them: window 3 must change nothing.
    """
    from climrisk.operators.windows import smooth

    table = None
    for size in sizes:
        out = smooth(daily, size, order, "_smooth", value=value, **where)
        row = filter_effect(
            out.withColumn("_smooth", F.round("_smooth", 9)),
            "_smooth",
            value=value,
            series=where.get("series", "series"),
        ).withColumn("window", F.lit(size))
        table = row if table is None else table.unionByName(row)
    return table


def index_correlation(
    a: DataFrame, b: DataFrame, keys, left: str, right: str, *, series: str = "series"
) -> DataFrame:
    """Correlation of two index columns over their common positions."""
    return (
        a.select(*keys, left)
        .join(b.select(*keys, right), list(keys))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .groupBy(series)
        .agg(F.count("*").alias("common"), F.corr(left, right).alias("correlation"))
    )


def redundant_features(df: DataFrame, columns, limit: float = 0.95) -> DataFrame:
    """Feature pairs whose correlation exceeds the limit, in one pass over the table."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    found = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("r")
                )
                for a, b in pairs
            )
        )
    )
    return found.select(rows.alias("p")).select("p.*").withColumn(
        "redundant", F.abs("r") > limit
    )


def top_rows(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: str, order, n: int) -> DataFrame:
    ranked = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= n)
