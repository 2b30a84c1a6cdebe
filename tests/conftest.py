import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"
EPOCH = datetime.date(1995, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "America/Panama")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def daily(spark):
    """Builds (series, date, value) rows from plain lists; None is an unmeasured day."""

    def build(series=None, start=EPOCH, **more):
        rows = []
        for name, values in {**(series or {}), **more}.items():
            for i, v in enumerate(values):
                rows.append(
                    (name, start + datetime.timedelta(days=i), None if v is None else float(v))
                )
        return spark.createDataFrame(rows, "series string, date date, value double")

    return build


@pytest.fixture(scope="session")
def column():
    """Values of one output column in date order, per series."""

    def read(df, name, order="date", series="series"):
        out = {}
        for r in df.orderBy(order).collect():
            out.setdefault(r[series], []).append(r[name])
        return out

    return read
