"""Historical event catalogues: mapping, rules, coverage, contrast with estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climrisk.operators.blocks import running_sum
from climrisk.schemas import EVENTS, LEVELS
from climrisk.sources.tables import materialise

# Hazard-archive types that map to our events.
DIRECT_TYPES = {
    "FLOOD": "lluvia_intensa",
    "RAIN": "lluvia_intensa",
    "SPATE": "lluvia_intensa",
    "DROUGHT": "sequia",
    "FORESTFIRE": "incendio",
}
CONDITIONAL_TYPE, CONDITIONAL_EVENT = "LANDSLIDE", "lluvia_intensa"
RAIN_WORDS = r"(?i)lluvia|llueve|temporal|rain"
MIN_EVENTS = 12


def map_categories(
    df: DataFrame,
    *,
    kind: str = "kind",
    text: str = "description",
    rain_words: str = RAIN_WORDS,
) -> DataFrame:
    """Archive type to event. A landslide counts as rain only when its text says so.

    Types outside the vocabulary keep a NULL event and stay in the table to be counted.
    """
    event = F.when(
        (F.col(kind) == CONDITIONAL_TYPE) & F.col(text).rlike(rain_words), CONDITIONAL_EVENT
    )
    for source, target in DIRECT_TYPES.items():
        event = event.when(F.col(kind) == source, target)
    return df.withColumn("event", event)


def catalog_errors(
    df: DataFrame, known_codes: DataFrame, today=None, *, code: str = "district"
) -> DataFrame:
    """Rows with the list of rules they break; an empty list marks a valid row.

    Dates that could not be read break a rule of their own where their texts came along.
    """
    unreadable = {
        when: F.col(f"{when}_unreadable").isNotNull() if f"{when}_unreadable" in df.columns else F.lit(False)
        for when in ("start", "end")
    }
    day = F.lit(today).cast("date") if today is not None else F.current_date()
    known = known_codes.select(F.col("code").alias(code), F.lit(True).alias("_known")).distinct()
    c = F.col
    problems = F.array_compact(
        F.array(
            F.when(c("_known").isNull(), "unknown district"),
            F.when(~F.coalesce(c("event").isin(*EVENTS), F.lit(False)), "unknown event"),
            F.when(unreadable["start"], "start unreadable").when(c("start_date").isNull(), "start missing"),
            F.when(unreadable["end"], "end unreadable"),
            F.when(c("end_date") < c("start_date"), "end before start"),
            F.when(c("start_date") > day, "start in the future"),
            F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "source missing"),
            F.when(c("severity").isNotNull() & ~c("severity").isin(*LEVELS), "unknown severity"),
        )
    )
    return df.join(known, code, "left").withColumn("errors", problems).drop("_known")


def split_catalog(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows."""
    valid = F.size("errors") == 0
    return checked.where(valid).drop("errors"), checked.where(~valid)


def events_by_type(df: DataFrame, event: str | None = None) -> DataFrame:
    """Events of one type; None means all."""
    return df if event is None else df.where(F.col("event") == event)


def frequencies(df: DataFrame, column: str, vocabulary) -> DataFrame:
    """Rows per value of a closed vocabulary, values without rows included as zero."""
    counts = df.agg(*(F.count_if(F.col(column) == v).alias(v) for v in vocabulary))
    rows = F.explode(
        F.array(
            *(F.struct(F.lit(v).alias("value"), F.col(f"`{v}`").alias("rows")) for v in vocabulary)
        )
    )
    return counts.select(rows.alias("r")).select("r.*")


def district_frequencies(df: DataFrame, districts: DataFrame, code: str = "district") -> DataFrame:
    """Rows per known district, districts without events included as zero."""
    counts = df.groupBy(code).agg(F.count("*").alias("rows"))
    return (
        districts.select(F.col("code").alias(code))
        .join(counts, code, "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
    )


def coverage_summary(df: DataFrame, minimum: int = MIN_EVENTS) -> DataFrame:
    """Rows, rows without severity, distinct events (start, type), and whether they suffice."""
    distinct = df.select("start_date", "event").distinct().agg(F.count("*").alias("n"))
    n = distinct.select("n").scalar()
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.col("severity").isNull()).alias("no_severity")
    ).select("rows", "no_severity", n.alias("distinct_events"), (n >= minimum).alias("enough"))


def contrast(
    events: DataFrame,
    daily_levels: DataFrame,
    *,
    series: str = "district",
    date: str = "date",
    level: str = "level",
) -> DataFrame:
    """Days of each event span by estimated level; an open event runs to the last known day.

    `daily_levels` is dense per district. Running totals turn a span into a difference of two
    days, so a span of any length costs two key lookups and is never expanded into days. The totals
    are written down once, so the plan of the levels runs once and not for every lookup.
    """
    c = F.col
    totals = materialise(
        running_sum(
        daily_levels,
        {
            "_high": (c(level) == LEVELS[2]).cast("bigint"),
            "_known": c(level).isNotNull().cast("bigint"),
            "_days": F.lit(1).cast("bigint"),
        },
        series=series,
        date=date,
    ).select(series, date, "_high", "_known", "_days"))
    spans = totals.groupBy(series).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    clipped = (
        events.join(spans, series, "left")
        .withColumn("_from", F.greatest("start_date", "_lo"))
        .withColumn("_to", F.least(F.coalesce("end_date", "_hi"), "_hi"))
        .withColumn("_before", F.date_sub("_from", 1))
    )
    at = lambda key, tag: totals.select(
        series, c(date).alias(key), *(c(n).alias(f"{n}{tag}") for n in ("_high", "_known", "_days"))
    )
    joined = clipped.join(at("_to", "_b"), [series, "_to"], "left").join(
        at("_before", "_a"), [series, "_before"], "left"
    )
    inside = c("_from") <= c("_to")

    def between(name):
        upper, lower = c(f"{name}_b"), F.coalesce(c(f"{name}_a"), F.lit(0))
        return F.when(inside, upper - lower).otherwise(0)

    days, known, high = between("_days"), between("_known"), between("_high")
    return joined.select(
        *events.columns,
        days.alias("span_days"),
        high.alias("high_days"),
        (known - high).alias("lower_days"),
        (days - known).alias("days_without_estimate"),
        F.when(high > 0, "hit").when(known > 0, "miss").otherwise("no estimate").alias("outcome"),
    )


def normalise_name(name):
    """Lower case, accents off, single spaces."""
    plain = F.translate(F.lower(F.trim(name)), "áéíóúüñ", "aeiouun")
    return F.regexp_replace(plain, r"\s+", " ")


def place_candidates(gazetteer: DataFrame, *, code: str = "code", name: str = "name") -> DataFrame:
    """Every (name, code) pair with how many codes its name has; a name is not a key."""
    named = gazetteer.select(normalise_name(name).alias("place"), F.col(code)).distinct()
    counts = named.groupBy("place").agg(
        F.count("*").alias("candidates"), F.min(code).alias("only_code")
    )
    return named.join(counts, "place")


def resolve_places(
    reports: DataFrame,
    gazetteer: DataFrame,
    *,
    place: str = "place_name",
    declared: str = "declared_code",
    code: str = "code",
    name: str = "name",
) -> DataFrame:
    """Reports with the code to use: the declared one, else the only candidate, else NULL."""
    counts = (
        gazetteer.select(normalise_name(name).alias("_place"), F.col(code).alias("_code"))
        .groupBy("_place")
        .agg(F.count_distinct("_code").alias("candidates"), F.min("_code").alias("_only"))
    )
    only = F.when(F.col("candidates") == 1, F.col("_only"))
    return (
        reports.withColumn("_place", normalise_name(place))
        .join(counts, "_place", "left")
        .withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        .withColumn("resolved_code", F.coalesce(F.col(declared), only))
        .withColumn(
            "how",
            F.when(F.col(declared).isNotNull(), "declared")
            .when(F.col("candidates") == 1, "only candidate")
            .when(F.col("candidates") > 1, "ambiguous")
            .otherwise("unknown"),
        )
        .drop("_place", "_only")
    )
