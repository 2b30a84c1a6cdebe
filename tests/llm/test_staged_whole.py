"""Tables between steps hold every row that was written to them, or their reading fails."""

import pathlib

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from climrisk.llm.common import staged


def parts(df):
    return [pathlib.Path(f.removeprefix("file:")) for f in df.inputFiles()]


def test_every_row_is_read_back(spark):
    rows = [(None, None, []), (1, "", [None]), (1, "", [None]), (2, "a\nb", ["x", ""]), (2, None, None)]
    df = spark.createDataFrame(rows, "a long, `b c` string, d array<string>").repartition(3)
    for tidy in (False, True):
        got = staged(df, tidy=tidy)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    assert staged(df.where("false")).count() == 0


@pytest.mark.parametrize(("setting", "spoil"), [("ignoreMissingFiles", lambda p: p.unlink()), ("ignoreCorruptFiles", lambda p: p.write_bytes(b"spoiled" * 100))])
def test_a_lost_part_is_no_smaller_table(spark, setting, spoil):
    spark.conf.set(f"spark.sql.files.{setting}", "true")
    try:
        df = staged(spark.range(0, 1000, 1, 4))
        first = parts(df)[0]
        (first.parent / f".{first.name}.crc").unlink(missing_ok=True)
        spoil(first)
        with pytest.raises((PySparkException, Py4JJavaError)):
            df.selectExpr("sum(id)").collect()
    finally:
        spark.conf.unset(f"spark.sql.files.{setting}")
