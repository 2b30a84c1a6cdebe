"""Keyed tables on files: small versioned tables, year partitions, snapshots, digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climrisk.operators.merge import latest_by_key


def working_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for intermediate tables, if any."""
    return spark.conf.get("spark.checkpoint.dir", None)


def materialise(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder, so later jobs start there.

    It survives lost executors and is removed when the session ends. Only where no shared folder is
    set, as in tests, a temporary one takes its place.
    """
    spark = df.sparkSession
    folder = working_folder(spark)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="climrisk-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_by_year(
    df: DataFrame, path: str, date: str = "date", *, replace: str = "dynamic"
) -> None:
    """Partitioned by year, so a range read only opens the years it needs.

    Rows are rebalanced by year: large years split over many tasks of even size, small ones
    share a task, so neither one writer nor many small files appear. `dynamic` replaces only the
    years written, `static` the whole table.
    """
    (
        df.withColumn("year", F.year(date))
        .hint("rebalance", "year")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", replace)
        .partitionBy("year")
        .parquet(path)
    )


def upsert_whole(
    spark: SparkSession, path: str, new: DataFrame, keys, order: str = "updated_at"
) -> None:
    """Upsert of a small keyed table (territory, metrics, reports) as a new version.

    Versions are folders; readers take the highest, so a failed write is never seen.
    """
    versions = _versions(spark, path)
    existing = spark.read.parquet(f"{path}/v{versions[-1]:08d}") if versions else None
    merged = latest_by_key(existing, new, keys, order)
    merged.write.parquet(f"{path}/v{(versions[-1] + 1 if versions else 1):08d}")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{versions[-1]:08d}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not table_exists(spark, path):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v") and fs.exists(marker):
            done.append(int(name[1:]))
    return sorted(done)


def _as_text(df: DataFrame):
    """One text per row, columns in name order, each after its length; NULL is `N` without one.

    Doubles keep the shortest text that reads back as the same number.
    """
    texts = []
    for f in sorted(df.schema, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
            c = F.when(F.col(f"`{f.name}`").isNotNull(), c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        text = c.cast("string")
        texts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    return F.concat(*texts)


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free content digest: row count, and the sums of the four quarters of each row's SHA-256.

    Equal rows give equal digests on any cluster, whatever the order or partitioning; repeated
    rows count. A sum holds 10**18 rows.
    """
    whole = F.sha2(_as_text(df), 256)
    sums = [
        F.coalesce(F.sum(F.conv(F.substring(whole, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")).cast("string")
        for i in range(4)
    ]
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *sums).alias("digest"))


def write_snapshot(spark: SparkSession, df: DataFrame, root: str, date: str = "date") -> dict:
    """Stores a table under its own digest and returns the manifest row, also written beside.

    A table that is stored already isn't written again, after its rows were compared.
    """
    draft = f"{root.rstrip('/')}/_draft/{uuid.uuid4().hex}"
    try:
        write_by_year(df, draft, date)
        return _keep_snapshot(spark, spark.read.parquet(draft).select(*df.columns), root, date)
    finally:
        _remove(spark, draft)


def _keep_snapshot(spark: SparkSession, stored: DataFrame, root: str, date: str) -> dict:
    facts = table_digest(stored).first()
    ends = stored.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).first()
    manifest = {
        "digest": facts["digest"],
        "rows": facts["rows"],
        "first_day": ends["lo"],
        "last_day": ends["hi"],
        "path": f"{root.rstrip('/')}/{facts['digest']}",
    }
    if not table_exists(spark, f"{manifest['path']}/_SUCCESS"):
        write_by_year(stored, manifest["path"], date, replace="static")
        spark.createDataFrame([manifest]).write.mode("append").json(f"{root}/_manifest")
        return manifest
    there = spark.read.parquet(manifest["path"]).select(*stored.columns)
    if not (stored.exceptAll(there).isEmpty() and there.exceptAll(stored).isEmpty()):
        raise ValueError(f"other rows are stored under {manifest['path']}")
    return manifest
