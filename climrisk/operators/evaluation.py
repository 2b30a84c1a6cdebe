"""Time-ordered evaluation: expanding folds, confusion counts, macro scores, paired test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climrisk.functions import checks, kernels
from climrisk.operators.baselines import NotTrained
from climrisk.schemas import LEVELS

TIE_BUCKETS = 1024


def date_positions(rows: DataFrame, date: str = "date") -> DataFrame:
    """How many rows lie strictly before each date, and the total, in three small levels.

    Rows collapse to one count per date first; years are summed in one short window (a row
    per year), dates inside their own year.
    """
    per_date = rows.groupBy(date).agg(F.count("*").alias("_c")).withColumn("_y", F.year(date))
    before = Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_y").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    years = (
        per_date.groupBy("_y")
        .agg(F.sum("_c").alias("_yc"))
        .withColumn("_years", F.coalesce(F.sum("_yc").over(before), F.lit(0)))
        .withColumn("total", F.sum("_yc").over(whole))
    )
    inside = Window.partitionBy("_y").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    return per_date.join(years, "_y").select(
        date,
        F.col("_c").alias("rows_on_date"),
        (F.col("_years") + F.coalesce(F.sum("_c").over(inside), F.lit(0))).alias("rows_before"),
        "total",
    )


def expanding_folds(
    rows: DataFrame,
    folds: int,
    *,
    date: str = "date",
    series: str | None = "series",
    snap_to_date: bool = True,
) -> DataFrame:
    """Rows with the fold that tests them: 0 for the first training stretch, then 1 .. folds.

    Fold c trains on every row with fold < c and tests the rows with fold = c; the last fold
    runs to the end. With n rows the cuts sit at multiples of n // (folds + 1). Snapping moves a
    cut to the start of the date it falls in, so no date is split between training and test.
    Without it, rows of a cut date are ordered by a hash bucket of the series and the series.
    """
    checks.window_at_least(folds)
    places = date_positions(rows, date)
    step = F.floor(F.col("total") / (folds + 1))
    enough = F.when(
        F.col("total") < folds + 1,
        F.raise_error(F.lit(f"{folds} folds need at least {folds + 1} rows")).cast("int"),
    )
    fold_of = lambda place: F.least(F.floor(place / step), F.lit(folds)).cast("int")
    if snap_to_date:
        # The date holding a cut position belongs wholly to the fold after the cut.
        last_row = F.col("rows_before") + F.col("rows_on_date") - 1
        tags = places.select(date, F.coalesce(enough, fold_of(last_row)).alias("fold"))
        return rows.join(tags, date)
    if series is None:
        raise ValueError("exact cuts need a column that orders the rows of one date")
    bucket = F.pmod(F.xxhash64(series), F.lit(TIE_BUCKETS)).alias("_b")
    tagged = rows.withColumn("_b", bucket)
    earlier = Window.partitionBy(date).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        tagged.groupBy(date, "_b")
        .agg(F.count("*").alias("_c"))
        .withColumn("_skip", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        .drop("_c")
    )
    inside = Window.partitionBy(date, "_b").orderBy(series)
    return (
        tagged.withColumn("_i", F.row_number().over(inside) - 1)
        .join(buckets, [date, "_b"])
        .join(places, date)
        .withColumn(
            "fold",
            F.coalesce(enough, fold_of(F.col("rows_before") + F.col("_skip") + F.col("_i"))),
        )
        .drop("_b", "_i", "_skip", "rows_before", "rows_on_date", "total")
    )


def fold_summary(folded: DataFrame, folds: int, date: str = "date") -> DataFrame:
    """Size and date range of the training and test part of each fold."""
    per = folded.groupBy("fold").agg(
        F.count("*").alias("_n"), F.min(date).alias("_lo"), F.max(date).alias("_hi")
    )
    wide = per.withColumn(
        "number", F.explode(F.sequence(F.greatest(F.col("fold"), F.lit(1)), F.lit(folds)))
    )
    test = F.col("fold") == F.col("number")
    return wide.groupBy("number").agg(
        F.sum(F.when(~test, F.col("_n")).otherwise(0)).alias("train_rows"),
        F.max(F.when(~test, F.col("_hi"))).alias("train_end"),
        F.sum(F.when(test, F.col("_n")).otherwise(0)).alias("test_rows"),
        F.min(F.when(test, F.col("_lo"))).alias("test_start"),
        F.max(F.when(test, F.col("_hi"))).alias("test_end"),
    )


def confusion(
    scored: DataFrame,
    keys=(),
    *,
    actual: str = "label",
    predicted: str = "prediction",
) -> DataFrame:
    """All nine cells per group: rows are actual levels, columns predicted ones.

    Counting happens first and needs no join: empty cells come from the aggregate itself.
    """
    known = scored.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    cells = [(a, p) for a in LEVELS for p in LEVELS]
    counts = known.groupBy(*keys).agg(
        *(
            F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"_{a}_{p}")
            for a, p in cells
        )
    )
    rows = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(a).alias("actual"),
                    F.lit(p).alias("predicted"),
                    F.col(f"_{a}_{p}").alias("n"),
                )
                for a, p in cells
            )
        )
    ).alias("_c")
    return counts.select(*keys, rows).select(*keys, "_c.actual", "_c.predicted", "_c.n")


def confusion_matrix(cells: DataFrame, keys=()) -> DataFrame:
    """The nine cells as one 3 x 3 array, as stored with the metrics of a model."""
    at = lambda a, p: F.sum(
        F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n")).otherwise(0)
    )
    matrix = F.array(*(F.array(*(at(a, p) for p in LEVELS)) for a in LEVELS))
    return cells.groupBy(*keys).agg(matrix.alias("confusion"))


def macro_scores(cells: DataFrame, keys=()) -> DataFrame:
    """Macro precision, recall and F1 over the three levels; an empty class scores zero."""
    n, a, p = F.col("n"), F.col("actual"), F.col("predicted")
    total = lambda when: F.sum(F.when(when, n).otherwise(0))
    sums = cells.groupBy(*keys).agg(
        F.sum("n").alias("evaluated"),
        *(total((a == c) & (p == c)).alias(f"_tp_{c}") for c in LEVELS),
        *(total(a == c).alias(f"_real_{c}") for c in LEVELS),
        *(total(p == c).alias(f"_said_{c}") for c in LEVELS),
    )

    def share(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    def mean(of):
        return sum((of(c) for c in LEVELS), F.lit(0.0)) / len(LEVELS)

    tp, real, said = (lambda c, x=x: F.col(f"_{x}_{c}") for x in ("tp", "real", "said"))
    scored = F.when(F.col("evaluated") > 0, F.lit(1.0))
    return sums.select(
        *keys,
        "evaluated",
        (scored * mean(lambda c: share(tp(c), said(c)))).alias("macro_precision"),
        (scored * mean(lambda c: share(tp(c), real(c)))).alias("macro_recall"),
        (scored * mean(lambda c: share(2 * tp(c), real(c) + said(c)))).alias("macro_f1"),
        (
            F.when(F.col("evaluated") > 0, sum((tp(c) for c in LEVELS), F.lit(0)))
            / F.col("evaluated")
        ).alias("accuracy"),
    )


def mcnemar_counts(
    scored: DataFrame,
    keys=(),
    *,
    actual: str = "label",
    model: str = "prediction",
    baseline: str = "baseline",
) -> DataFrame:
    """Paired outcomes of two forecasts on the same rows, with the continuity-corrected statistic."""
    known = scored.where(
        F.col(actual).isNotNull() & F.col(model).isNotNull() & F.col(baseline).isNotNull()
    )
    hit, base = F.col(model) == F.col(actual), F.col(baseline) == F.col(actual)
    b, c = F.col("only_model"), F.col("only_baseline")
    return (
        known.groupBy(*keys)
        .agg(
            F.count_if(hit & base).alias("both"),
            F.count_if(hit & ~base).alias("only_model"),
            F.count_if(~hit & base).alias("only_baseline"),
            F.count_if(~hit & ~base).alias("neither"),
        )
        .withColumn(
            "statistic",
            F.when(
                b + c > 0,
                F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double"), 2) / (b + c),
            ),
        )
    )


def beats_baseline(
    model_f1: float | None,
    baseline_f1: float | None,
    only_model: int,
    only_baseline: int,
) -> tuple[bool, float]:
    """(model is better, p-value of the paired test). A missing score is an error; losing is not."""
    if model_f1 is None or baseline_f1 is None:
        raise ValueError("a macro F1 is missing: evaluate before comparing")
    discordant = only_model + only_baseline
    if discordant == 0:
        return model_f1 > baseline_f1, 1.0
    statistic = max(abs(only_model - only_baseline) - 1, 0) ** 2 / discordant
    return model_f1 > baseline_f1, kernels.chi2_one_df_tail(statistic)


def before_fold(folded: DataFrame, number: int, *, gap_days: int = 0, date: str = "date") -> DataFrame:
    """The rows that may train the model of a fold.

    A label that looks `gap_days` ahead would carry test days into the training rows before the
    cut; those rows train nothing. A fold without rows has no cut.
    """
    cut = folded.where(F.col("fold") == number).agg(F.min(date).alias("at")).first()["at"]
    past = F.col("fold") < number
    if cut is not None:
        past &= F.date_add(date, gap_days) < F.lit(cut)
    return folded.where(past)


def evaluate_expanding(make, folded: DataFrame, folds: int, *, gap_days: int = 0, date: str = "date") -> DataFrame:
    """Out-of-fold forecasts of exactly `folds` evaluations, each trained on the past only.

    Where nothing before a fold can train a model, the fold's rows come back with NULL forecasts.
    """
    scored = None
    for number in range(1, folds + 1):
        rows = folded.where(F.col("fold") == number)
        model = make().train(before_fold(folded, number, gap_days=gap_days, date=date))
        try:
            part = model.predict(rows)
        except NotTrained:
            none = F.lit(None)
            part = rows.withColumns({"prediction": none.cast("string"), "probability": none.cast("double")})
        scored = part if scored is None else scored.unionByName(part)
    return scored


def tail_probability(statistic) -> Column:
    """Chance of a chi-squared value (one degree of freedom) beyond the statistic; NULL stays 1."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.fillna(0.0).map(kernels.chi2_one_df_tail)

    return tail(statistic)


def model_table(
    metrics: DataFrame, baseline: str = "linea_base_climatologica", level: float = 0.05
) -> DataFrame:
    """Algorithms ranked by macro F1 within each event, next to the baseline's score.

    With the columns of the paired test (only_model, only_baseline, statistic) there is a p-value,
    and an algorithm beats the baseline by a higher score and a p-value under `level`. Without
    them nothing is known to beat it.
    """
    best = Window.partitionBy("event").orderBy(F.desc("macro_f1"), F.asc("algorithm"))
    own = Window.partitionBy("event")
    reference = F.max(F.when(F.col("algorithm") == baseline, F.col("macro_f1"))).over(own)
    p_value = tail_probability("statistic") if "statistic" in metrics.columns else F.lit(None).cast("double")
    return (
        metrics.withColumn("p_value", p_value)
        .withColumn("baseline_f1", reference)
        .withColumn("place", F.rank().over(best))
        .withColumn(
            "beats_baseline", (F.col("macro_f1") > F.col("baseline_f1")) & (F.col("p_value") < level)
        )
    )
