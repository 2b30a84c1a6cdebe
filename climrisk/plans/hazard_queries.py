"""Levels, detections windows, labels, baselines and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from climrisk.functions import levels
from climrisk.operators import evaluation, labels, spi, thresholds
from climrisk.operators.baselines import ClimatologicalBaseline, Persistence
from climrisk.operators.calendar import densify_counts
from climrisk.plans import adapters as a
from climrisk.plans import series_queries as s
from climrisk.plans.registry import query, rounded
from climrisk.sources.tables import materialise

LEVELED = f"""{a.RAIN_SQL}, {s.SUMS}, {s.ACC}, lev AS (
      SELECT s.series, s.date, s.value, s.total, p95_accumulated, p99_accumulated,
        CASE WHEN total IS NULL OR p95_accumulated IS NULL THEN NULL
          WHEN total <= p95_accumulated THEN 'bajo' WHEN total <= p99_accumulated THEN 'medio'
          ELSE 'alto' END AS level
      FROM sums s LEFT JOIN acc ON acc.series = s.series)"""
SEVERITY = "CASE {c} WHEN 'bajo' THEN 0 WHEN 'medio' THEN 1 WHEN 'alto' THEN 2 END"
NAME = "CASE {c} WHEN 0 THEN 'bajo' WHEN 1 THEN 'medio' WHEN 2 THEN 'alto' END"
LABELED = f"""{LEVELED}, lab AS (
      SELECT *, CASE WHEN count(level) OVER n7 = 7 THEN
        max({SEVERITY.format(c='level')}) OVER n7 END AS rank,
        'lluvia_intensa' AS event
      FROM lev WINDOW n7 AS (PARTITION BY series ORDER BY date
        ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
    labeled AS (SELECT *, {NAME.format(c='rank')} AS label FROM lab)"""


def leveled(spark, sf):
    return labels.rain_levels(a.rain(spark, sf))


def labeled(spark, sf):
    return labels.forward_label(leveled(spark, sf)).withColumn("event", F.lit("lluvia_intensa"))


@query(
    "level_rain",
    f"""WITH {LEVELED} SELECT series, date, value, total,
      round(p95_accumulated, 6) AS p95_accumulated, round(p99_accumulated, 6) AS p99_accumulated,
      level FROM lev""",
)
def level_rain(spark, sf):
    return rounded(leveled(spark, sf), 6, "p95_accumulated", "p99_accumulated")


@query(
    "level_drought",
    f"""WITH RECURSIVE {s.RAIN_ACC}, {s.BY_MONTH}
    SELECT series, month_start, round(spi, 6) AS spi, CASE WHEN spi > -1 THEN 'bajo'
      WHEN spi > -1.5e0 THEN 'medio' WHEN spi <= -1.5e0 THEN 'alto' END AS level FROM z""",
)
def level_drought(spark, sf):
    index = spi.spi(spi.monthly_totals(a.rain(spark, sf)), 3)
    return rounded(
        labels.drought_levels(index).select("series", "month_start", "spi", "level"), 6, "spi"
    )


@query("hotspot_count", f"WITH {a.FIRE_SQL} SELECT series, date, detections FROM fire")
def hotspot_count(spark, sf):
    return densify_counts(a.fire_counts(spark, sf), "detections")


WEEK = """week AS (SELECT *, CAST(sum(detections) OVER (PARTITION BY series ORDER BY date
        ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM fire)"""


def _week(spark, sf):
    return labels.trailing_counts(densify_counts(a.fire_counts(spark, sf), "detections"))


@query("hotspots_7d", f"WITH {a.FIRE_SQL}, {WEEK} SELECT series, date, detections, n FROM week")
def hotspots_7d(spark, sf):
    return _week(spark, sf)


P90 = """p90 AS (SELECT series, quantile_cont(CAST(n AS DOUBLE), 0.9) AS p90 FROM week GROUP BY 1)"""


@query(
    "fire_p90", f"WITH {a.FIRE_SQL}, {WEEK}, {P90} SELECT series, round(p90, 6) AS p90 FROM p90"
)
def fire_p90(spark, sf):
    return rounded(thresholds.count_threshold(_week(spark, sf)), 6, "p90")


@query(
    "level_fire",
    f"""WITH {a.FIRE_SQL}, {WEEK}, {P90} SELECT w.series, date, detections, n,
      round(p90, 6) AS p90, CASE WHEN n = 0 THEN 'bajo' WHEN n <= p90 THEN 'medio' ELSE 'alto' END
      AS level FROM week w JOIN p90 ON p90.series = w.series""",
)
def level_fire(spark, sf):
    week = _week(spark, sf)
    return rounded(labels.fire_levels(week, thresholds.count_threshold(week)), 6, "p90")


@query(
    "prob_to_level",
    f"WITH {a.RISKS_SQL} SELECT district, date, event, probability, level FROM leveled",
)
def prob_to_level(spark, sf):
    return a.risks(spark, sf).withColumn(
        "level", levels.level_from_probability(F.col("probability"))
    )


@query(
    "label_7d", f"WITH {LABELED} SELECT series, date, level, label FROM labeled"
)
def label_7d(spark, sf):
    return labeled(spark, sf).select("series", "date", "level", "label")


@query(
    "label_fire",
    f"""WITH {a.FIRE_SQL}, {WEEK}, {P90}, lev AS (
      SELECT w.series, date, CASE WHEN n = 0 THEN 0 WHEN n <= p90 THEN 1 ELSE 2 END AS r
      FROM week w JOIN p90 ON p90.series = w.series), lab AS (
      SELECT *, CASE WHEN count(r) OVER n7 = 7 THEN max(r) OVER n7 END AS m FROM lev
      WINDOW n7 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))
    SELECT series, date, {NAME.format(c='r')} AS level, {NAME.format(c='m')} AS label FROM lab""",
)
def label_fire(spark, sf):
    week = _week(spark, sf)
    leveled_days = labels.fire_levels(week, thresholds.count_threshold(week))
    return labels.forward_label(leveled_days.select("series", "date", "level"))


@query(
    "label_drought",
    f"""WITH RECURSIVE {s.RAIN_ACC}, {s.BY_MONTH}, monthly AS (
      SELECT series, month_start, CASE WHEN spi > -1 THEN 0 WHEN spi > -1.5e0 THEN 1
        WHEN spi <= -1.5e0 THEN 2 END AS r FROM z), lev AS (
      SELECT d.series, d.date, m.r FROM rain d LEFT JOIN monthly m ON m.series = d.series
        AND m.month_start = date_trunc('month', d.date) - INTERVAL 1 MONTH), lab AS (
      SELECT *, CASE WHEN count(r) OVER n7 = 7 THEN max(r) OVER n7 END AS m FROM lev
      WINDOW n7 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))
    SELECT series, date, {NAME.format(c='r')} AS level, {NAME.format(c='m')} AS label FROM lab""",
)
def label_drought(spark, sf):
    daily = a.rain(spark, sf)
    monthly = labels.drought_levels(spi.spi(spi.monthly_totals(daily), 3))
    return labels.forward_label(labels.levels_by_day(monthly, daily))


@query(
    "label_distribution",
    f"""WITH {LABELED} SELECT event, series, CAST(year(date) AS INTEGER) AS year,
      count(*) FILTER (WHERE label = 'bajo') AS bajo, count(*) FILTER (WHERE label = 'medio')
        AS medio, count(*) FILTER (WHERE label = 'alto') AS alto,
      count(*) FILTER (WHERE label IS NULL) AS without_label, count(*) AS days
    FROM labeled GROUP BY ROLLUP (event, series, CAST(year(date) AS INTEGER))""",
)
def label_distribution(spark, sf):
    return labels.label_distribution(labeled(spark, sf), subtotals=True)


# --- three hazards side by side ------------------------------------------------------------


def labeled_hazards(spark, sf):
    """Level and seven-day label of every hazard, with its name: rain, drought and fire."""
    daily = a.rain(spark, sf)
    monthly = labels.drought_levels(spi.spi(spi.monthly_totals(daily), 3))
    week = _week(spark, sf)
    leveled_days = {
        "lluvia_intensa": leveled(spark, sf),
        "sequia": labels.levels_by_day(monthly, daily),
        "incendio": labels.fire_levels(week, thresholds.count_threshold(week)),
    }
    table = None
    for event, days in leveled_days.items():
        one = labels.forward_label(days.select(F.col("series").cast("string"), "date", "level"))
        one = one.withColumn("event", F.lit(event))
        table = one if table is None else table.unionByName(one)
    return table


HAZARDS = f"""{s.RAIN_ACC}, {s.BY_MONTH}, {s.SUMS}, {s.ACC.replace("acc AS", "limits AS", 1)},
    {a.FIRE_SQL}, {WEEK}, {P90}, ranks AS (
      SELECT 'lluvia_intensa' AS event, s.series, s.date, CASE WHEN total IS NULL OR p95_accumulated IS NULL
        THEN NULL WHEN total <= p95_accumulated THEN 0 WHEN total <= p99_accumulated THEN 1 ELSE 2 END AS r
      FROM sums s LEFT JOIN limits ON limits.series = s.series
      UNION ALL SELECT 'sequia', d.series, d.date, CASE WHEN spi > -1 THEN 0 WHEN spi > -1.5e0 THEN 1
        WHEN spi <= -1.5e0 THEN 2 END FROM rain d LEFT JOIN z ON z.series = d.series
        AND z.month_start = date_trunc('month', d.date) - INTERVAL 1 MONTH
      UNION ALL SELECT 'incendio', CAST(w.series AS VARCHAR), date, CASE WHEN n = 0 THEN 0 WHEN n <= p90 THEN 1
        ELSE 2 END FROM week w JOIN p90 ON p90.series = w.series),
    hazards AS (SELECT *, CASE WHEN count(r) OVER n7 = 7 THEN max(r) OVER n7 END AS m FROM ranks
      WINDOW n7 AS (PARTITION BY event, series ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))"""


@query(
    "label_distribution_hazards",
    f"""WITH RECURSIVE {HAZARDS} SELECT event, series, CAST(year(date) AS INTEGER) AS year,
      count(*) FILTER (WHERE m = 0) AS bajo, count(*) FILTER (WHERE m = 1) AS medio,
      count(*) FILTER (WHERE m = 2) AS alto, count(*) FILTER (WHERE m IS NULL) AS without_label,
      count(*) AS days
    FROM hazards GROUP BY ROLLUP (event, series, CAST(year(date) AS INTEGER))""",
)
def label_distribution_hazards(spark, sf):
    return labels.label_distribution(labeled_hazards(spark, sf), subtotals=True)


@query(
    "hazard_persistence",
    f"""WITH RECURSIVE {HAZARDS}, known AS (SELECT event, m AS actual, r AS predicted FROM hazards
      WHERE m IS NOT NULL AND r IS NOT NULL)
    SELECT e AS event, {NAME.format(c='x')} AS actual, {NAME.format(c='y')} AS predicted, count(actual) AS n
    FROM (SELECT DISTINCT event AS e FROM known) CROSS JOIN (VALUES (0), (1), (2)) t(x)
      CROSS JOIN (VALUES (0), (1), (2)) u(y) LEFT JOIN known ON event = e AND actual = x AND predicted = y
    GROUP BY 1, 2, 3""",
)
def hazard_persistence(spark, sf):
    """Today's level against the week's: the nine cells of each hazard."""
    told = Persistence().train(None).predict(labeled_hazards(spark, sf))
    return evaluation.confusion(told, ["event"])


FOLDS, GAP_DAYS = 4, 7
MODES = f"""placed AS (
      SELECT date, CAST(least(floor((upto - 1) / floor(total / {FOLDS + 1}e0)), {FOLDS}) AS INTEGER) AS fold
      FROM (SELECT date, sum(count(*)) OVER (ORDER BY date) AS upto, sum(count(*)) OVER () AS total
        FROM labeled WHERE rank IS NOT NULL GROUP BY date)),
    judged_rows AS (SELECT l.*, fold FROM labeled l JOIN placed USING (date) WHERE rank IS NOT NULL),
    cut AS (SELECT fold AS k, min(date) AS cut_day FROM judged_rows WHERE fold > 0 GROUP BY 1),
    known AS (SELECT k, series, month(date) AS month, event, rank FROM judged_rows
      JOIN cut ON fold < k AND date + {GAP_DAYS} < cut_day),
    counted AS (SELECT k, series, month, event, rank, count(*) AS c FROM known GROUP BY ALL),
    modes AS (SELECT k, series, month, event, arg_max(rank, c * 10 + rank) AS mode,
      round(CAST(sum(CASE WHEN rank = 2 THEN c ELSE 0 END) AS DOUBLE) / sum(c), 6) AS probability
      FROM counted GROUP BY 1, 2, 3, 4),
    all_counted AS (SELECT k, event, rank, count(*) AS c FROM known GROUP BY ALL),
    all_modes AS (SELECT k, event, arg_max(rank, c * 10 + rank) AS mode,
      round(CAST(sum(CASE WHEN rank = 2 THEN c ELSE 0 END) AS DOUBLE) / sum(c), 6) AS probability
      FROM all_counted GROUP BY 1, 2),
    both_ AS (
      SELECT l.series, l.date, l.fold, l.level, l.label, {NAME.format(c='coalesce(m.mode, am.mode)')}
        AS baseline, coalesce(m.probability, am.probability) AS probability
      FROM judged_rows l LEFT JOIN modes m
        ON m.k = l.fold AND m.series = l.series AND m.month = month(l.date)
      LEFT JOIN all_modes am ON am.k = l.fold AND am.event = l.event WHERE l.fold > 0)"""


def folded(spark, sf):
    """Labelled rows with the fold that tests them."""
    return evaluation.expanding_folds(labeled(spark, sf).where("label IS NOT NULL"), FOLDS)


def persisted(spark, sf):
    """Rows of the test folds with the persistence forecast."""
    return Persistence().train(None).predict(folded(spark, sf).where("fold > 0"))


def climatology(spark, sf):
    """Out-of-fold forecasts: each fold from a baseline trained before it, labels' reach left out."""
    rows = materialise(folded(spark, sf))
    return evaluation.evaluate_expanding(ClimatologicalBaseline, rows, FOLDS, gap_days=GAP_DAYS)


def scored(spark, sf):
    """Test rows with the persistence forecast and the climatological one."""
    first = climatology(spark, sf).withColumnRenamed("prediction", "baseline")
    kept = first.withColumnRenamed("probability", "baseline_probability")
    return Persistence().train(None).predict(kept)


@query(
    "baseline_climatology",
    f"WITH {LABELED}, {MODES} SELECT series, date, fold, label, baseline AS prediction, probability FROM both_",
)
def baseline_climatology(spark, sf):
    out = climatology(spark, sf)
    return rounded(out.select("series", "date", "fold", "label", "prediction", "probability"), 6, "probability")


@query(
    "persistence",
    f"WITH {LABELED} SELECT series, date, label, level AS prediction FROM labeled",
)
def persistence(spark, sf):
    out = Persistence().train(None).predict(labeled(spark, sf))
    return out.select("series", "date", "label", "prediction")


CELLS = f"""levels(l) AS (VALUES ('bajo'), ('medio'), ('alto')),
    cells AS (
      SELECT s.series, x.l AS actual, y.l AS predicted, count(b.label) AS n
      FROM (SELECT DISTINCT series FROM both_ WHERE label IS NOT NULL AND level IS NOT NULL) s
      CROSS JOIN levels x CROSS JOIN levels y
      LEFT JOIN both_ b ON b.series = s.series AND b.label = x.l AND b.level = y.l GROUP BY ALL)"""


@query(
    "confusion",
    f"WITH {LABELED}, {MODES}, {CELLS} SELECT series, actual, predicted, n FROM cells",
)
def confusion(spark, sf):
    return evaluation.confusion(persisted(spark, sf), ["series"])


MACRO = """per AS (
      SELECT series, l, sum(CASE WHEN actual = l AND predicted = l THEN n ELSE 0 END) AS tp,
        sum(CASE WHEN actual = l THEN n ELSE 0 END) AS re,
        sum(CASE WHEN predicted = l THEN n ELSE 0 END) AS said
      FROM cells CROSS JOIN levels GROUP BY 1, 2)"""


@query(
    "macro_f1",
    f"""WITH {LABELED}, {MODES}, {CELLS}, {MACRO}
    SELECT series, CAST(sum(re) AS BIGINT) AS evaluated,
      round(avg(CASE WHEN said > 0 THEN CAST(tp AS DOUBLE) / said ELSE 0 END), 6)
        AS macro_precision,
      round(avg(CASE WHEN re > 0 THEN CAST(tp AS DOUBLE) / re ELSE 0 END), 6) AS macro_recall,
      round(avg(CASE WHEN re + said > 0 THEN 2e0 * tp / (re + said) ELSE 0 END), 6) AS macro_f1,
      round(CAST(sum(tp) AS DOUBLE) / sum(re), 6) AS accuracy
    FROM per GROUP BY 1""",
)
def macro_f1(spark, sf):
    df = evaluation.macro_scores(evaluation.confusion(persisted(spark, sf), ["series"]), ["series"])
    return rounded(df, 6, "macro_precision", "macro_recall", "macro_f1", "accuracy")


@query(
    "mcnemar_counts",
    f"""WITH {LABELED}, {MODES}, hits AS (
      SELECT series, level = label AS h, baseline = label AS b FROM both_
      WHERE label IS NOT NULL AND level IS NOT NULL AND baseline IS NOT NULL), c AS (
      SELECT series, count(*) FILTER (WHERE h AND b) AS both,
        count(*) FILTER (WHERE h AND NOT b) AS only_model,
        count(*) FILTER (WHERE NOT h AND b) AS only_baseline,
        count(*) FILTER (WHERE NOT h AND NOT b) AS neither FROM hits GROUP BY 1)
    SELECT *, CASE WHEN only_model + only_baseline > 0 THEN
      round(CAST(pow(greatest(abs(only_model - only_baseline) - 1, 0), 2) AS DOUBLE)
        / (only_model + only_baseline), 6) END AS statistic FROM c""",
)
def mcnemar_counts(spark, sf):
    return rounded(evaluation.mcnemar_counts(scored(spark, sf), ["series"]), 6, "statistic")


@query(
    "expanding_folds",
    f"""WITH {a.REGIONS_SQL}, seen AS (SELECT * FROM regions WHERE value IS NOT NULL), pos AS (
      SELECT date, count(*) AS c, sum(count(*)) OVER (ORDER BY date) AS upto,
        sum(count(*)) OVER () AS total FROM seen GROUP BY date),
    folded AS (SELECT date, c, CAST(least(floor((upto - 1) / floor(total / 5e0)), 4) AS INTEGER)
      AS fold FROM pos)
    SELECT CAST(k AS INTEGER) AS number,
      CAST(sum(CASE WHEN fold < k THEN c ELSE 0 END) AS BIGINT) AS train_rows,
      max(CASE WHEN fold < k THEN date END) AS train_end,
      CAST(sum(CASE WHEN fold = k THEN c ELSE 0 END) AS BIGINT) AS test_rows,
      min(CASE WHEN fold = k THEN date END) AS test_start,
      max(CASE WHEN fold = k THEN date END) AS test_end
    FROM folded CROSS JOIN (SELECT unnest(range(1, 5)) AS k) GROUP BY k""",
)
def expanding_folds(spark, sf):
    seen = a.regions(spark, sf).where("value IS NOT NULL")
    return evaluation.fold_summary(evaluation.expanding_folds(seen, 4), 4)


@query(
    "model_table",
    f"""WITH {LABELED}, {MODES}, long AS (
      SELECT 'persistencia' AS algorithm, series AS event, label, level AS p, baseline FROM both_
      UNION ALL SELECT 'linea_base_climatologica', series, label, baseline, baseline FROM both_),
    judged AS (SELECT * FROM long WHERE label IS NOT NULL AND p IS NOT NULL),
    levels(l) AS (VALUES ('bajo'), ('medio'), ('alto')), per AS (
      SELECT algorithm, event, l, count(*) FILTER (WHERE label = l AND p = l) AS tp,
        count(*) FILTER (WHERE label = l) + count(*) FILTER (WHERE p = l) AS den
      FROM judged CROSS JOIN levels GROUP BY 1, 2, 3), f AS (
      SELECT algorithm, event, round(avg(CASE WHEN den > 0 THEN 2e0 * tp / den ELSE 0 END), 6)
        AS macro_f1 FROM per GROUP BY 1, 2),
    pairs AS (SELECT algorithm, event, count(*) FILTER (WHERE p = label AND baseline <> label) AS b,
        count(*) FILTER (WHERE p <> label AND baseline = label) AS c FROM judged GROUP BY 1, 2),
    tested AS (SELECT *, CASE WHEN b + c > 0
        THEN CAST(pow(greatest(abs(b - c) - 1, 0), 2) AS DOUBLE) / (b + c) ELSE 0 END AS x FROM pairs),
    -- The tail of the normal curve beyond sqrt(x), both sides, by Simpson's rule over 4000 steps.
    tail AS (SELECT algorithm, event, b, c, greatest(1 - 2 * list_sum(list_transform(range(0, 4001), lambda i:
        (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * exp(-0.5e0 * pow(sqrt(x) * i / 4000, 2)))) * sqrt(x) / 12000 / sqrt(2 * pi()), 0) AS p_value FROM tested),
    w AS (
      SELECT f.*, b AS only_model, c AS only_baseline, round(p_value, 6) AS p_value,
        max(CASE WHEN algorithm = 'linea_base_climatologica' THEN macro_f1 END) OVER (
          PARTITION BY event) AS baseline_f1,
        CAST(rank() OVER (PARTITION BY event ORDER BY macro_f1 DESC, algorithm) AS INTEGER)
          AS place FROM f JOIN tail USING (algorithm, event))
    SELECT algorithm, event, macro_f1, baseline_f1, place, only_model, only_baseline, p_value,
      macro_f1 > baseline_f1 AND p_value < 0.05 AS beats_baseline FROM w""",
)
def model_table(spark, sf):
    both = scored(spark, sf)
    long = both.select(
        F.col("series").alias("event"),
        "label",
        "baseline",
        F.explode(
            F.array(
                F.struct(F.lit("persistencia").alias("a"), F.col("prediction").alias("p")),
                F.struct(
                    F.lit("linea_base_climatologica").alias("a"), F.col("baseline").alias("p")
                ),
            )
        ).alias("m"),
    ).select("event", "label", "baseline", F.col("m.a").alias("algorithm"), F.col("m.p").alias("prediction"))
    keys = ["algorithm", "event"]
    scores = evaluation.macro_scores(evaluation.confusion(long, keys), keys)
    pairs = evaluation.mcnemar_counts(long, keys).select(*keys, "only_model", "only_baseline", "statistic")
    metrics = rounded(scores.select(*keys, "macro_f1"), 6, "macro_f1").join(pairs, keys)
    return rounded(evaluation.model_table(metrics).drop("statistic"), 6, "p_value")
