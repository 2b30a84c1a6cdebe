"""Forecasts as risk rows: contents, version ids, publishing."""

import datetime

import pytest
from pyspark.sql import functions as F

from climrisk.operators import forecasts, models, risk
from climrisk.schemas import MODEL_METRICS, RISK, conformance

D = datetime.date
FEATURES = ["x"]


@pytest.fixture(scope="module")
def rows(spark):
    """The level follows x; every tenth day has no x."""
    out = []
    for i in range(240):
        level = ("bajo", "medio", "alto")[i % 3]
        x = None if i % 10 == 9 else float(i % 3 * 10)
        out.append(("d1" if i % 2 else "d2", D(2020, 1, 1) + datetime.timedelta(days=i), x, level))
    return spark.createDataFrame(out, "series string, date date, x double, label string")


@pytest.fixture(scope="module")
def trained(rows):
    training = rows.where("date < '2020-06-01'")
    model = models.logistic_regression(FEATURES).train(training)
    return model, training, rows.where("date >= '2020-06-01'"), forecasts.model_version(model.algorithm, "sequia", training)


def test_risk_rows_have_a_model_behind_every_level(trained):
    model, _, test, version = trained
    out = forecasts.risk_rows(model, test, "sequia", version)
    assert conformance(out, RISK) == []
    got = out.collect()
    assert len(got) == test.count()
    lacking = [r for r in got if r.level is None]
    assert len(lacking) == test.where("x IS NULL").count() > 0
    assert all(r[3:] == (None,) * 5 for r in lacking)
    for r in got:
        if r.level is not None:
            assert r.model_version == version and 0 <= r.probability <= 1
            assert [e.variable for e in r.explanation] == FEATURES
    high = [r.probability for r in got if r.level == "alto"]
    low = [r.probability for r in got if r.level == "bajo"]
    assert min(high) > max(low)


def test_untrained_models_give_rows_without_a_level(rows):
    model = models.logistic_regression(FEATURES).train(rows.where("false"))
    out = forecasts.risk_rows(model, rows, "sequia", "v")
    assert out.count() == 240 and out.where("level IS NOT NULL OR model_version IS NOT NULL").isEmpty()
    forecasts.check_risks(out)


def test_version_ids_depend_on_rows_and_settings_only(trained):
    model, training, _, version = trained
    name = lambda df, *more: forecasts.model_version(model.algorithm, "sequia", df, *more)
    assert name(training.repartition(7)) == version
    assert name(training.where("date < '2020-05-31'")) != version
    assert name(training, "regParam=1") != version


def test_registry_rows_tell_whether_the_baseline_is_beaten(trained):
    model, training, test, version = trained
    row = forecasts.judge(model, test, training, "sequia", version)
    assert conformance(row, MODEL_METRICS) == []
    one = row.first()
    # Levels turn every three days, so months tell a climatology nothing.
    assert one.macro_f1 == 1.0 and one.beats_baseline is True
    assert sum(map(sum, one.confusion)) == test.where("x IS NOT NULL").count()
    nothing = forecasts.judge(model, test.where("x IS NULL"), training, "sequia", version)
    assert nothing.where("beats_baseline IS NOT NULL").isEmpty()


def test_published_rows_are_read_by_completion_and_legend(spark, trained, tmp_path):
    model, training, test, version = trained
    root = str(tmp_path / "out")
    made = forecasts.risk_rows(model, test, "sequia", version)
    metrics = forecasts.judge(model, test, training, "sequia", version)
    assert forecasts.publish(spark, root, made, metrics) == test.count()
    forecasts.publish(spark, root, made, metrics)
    stored = forecasts.published(spark, root)
    assert stored.count() == test.count() and forecasts.registry(spark, root).count() == 1
    day = test.where("x IS NOT NULL").agg(F.max("date")).first()[0]
    codes = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "code string")
    legend = risk.legend_counts(risk.complete_risks(codes, stored, day, "sequia")).first()
    assert legend.bajo + legend.medio + legend.alto == 1 and legend.without_estimate == 2


def test_refused_deliveries_leave_the_risks_alone(spark, trained, tmp_path):
    model, training, test, version = trained
    root = str(tmp_path / "out")
    metrics = forecasts.judge(model, test, training, "sequia", version)
    made = forecasts.risk_rows(model, test, "sequia", version)
    for wrong in (
        made.withColumn("probability", F.lit(1.5)),
        made.withColumn("event", F.lit("granizo")),
        made.withColumn("level", F.lit("extremo")),
        made.withColumn("model_version", F.lit(None).cast("string")),
    ):
        with pytest.raises(ValueError, match="risk rows"):
            forecasts.publish(spark, root, wrong, metrics)
    with pytest.raises(ValueError, match="without metrics"):
        forecasts.publish(spark, root, forecasts.risk_rows(model, test, "sequia", "unheard of"), metrics)
    with pytest.raises(FileNotFoundError):
        forecasts.published(spark, root)


def test_the_baseline_keeps_a_column_named_month(rows):
    from climrisk.operators.baselines import ClimatologicalBaseline

    known = rows.withColumns({"event": F.lit("sequia"), "month": F.lit(-1.0)})
    out = ClimatologicalBaseline().train(known).predict(known)
    assert out.where("month = -1.0 AND prediction IS NOT NULL").count() == 240
