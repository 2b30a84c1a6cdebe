"""Year-partitioned tables in versions: a load of any number of years is seen whole or not at all.

A load writes the years it touches into a folder of its own, `data/commit=<id>/year=<year>`, and never
changes a folder that is there. A manifest names the folder of every year in force, and how far each
stream of batches has been taken in; manifests are numbered, and the highest one is the table. The only
step that readers can notice is the rename that puts the next manifest into place.
"""

from __future__ import annotations

import json
import operator
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climrisk.operators.merge import latest_by_key
from climrisk.sources.tables import materialise

#: Seconds after which a claim without its manifest counts as left behind by a writer that died.
STALE_SECONDS = 600


class WriteConflict(RuntimeError):
    """Another load took the next version first; nothing was changed."""


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, in order."""
    return sorted(int(n[1:-5]) for n in _names(spark, f"{path}/manifest") if n.startswith("v") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version consists of; without a number the newest, for a table not written yet an empty one."""
    known = versions(spark, path)
    if version is None:
        version = known[-1] if known else 0
    if version == 0:
        return {"version": 0, "schema": None, "years": {}, "batches": {}}
    if version not in known:
        raise FileNotFoundError(f"{path} has no version {version}")
    fs, file = _at(spark, f"{path}/manifest/v{version:010d}.json")
    stream = fs.open(file)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _years(spark: SparkSession, path: str, state: dict, years=None) -> DataFrame:
    schema = T.StructType.fromJson(state["schema"])
    folders = [f"{path}/data/commit={c}/year={y}" for y, c in sorted(state["years"].items()) if years is None or int(y) in years]
    if not folders:
        return spark.createDataFrame([], schema.add("year", T.IntegerType()))
    whole = T.StructType([*schema.fields, T.StructField("commit", T.StringType()), T.StructField("year", T.IntegerType())])
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*folders).drop("commit")


def read_years(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, with `year`; a filter on it opens only the years it needs."""
    state = manifest(spark, path, version)
    if state["schema"] is None:
        raise FileNotFoundError(path)
    return _years(spark, path, state)


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Makes `state` the version after the one it was made from, or raises WriteConflict.

    The claim, a file that only one writer can create, settles who comes next; the rename shows the result.
    """
    name = f"{path}/manifest/v{state['version']:010d}"
    fs, final = _at(spark, f"{name}.json")
    _, claim = _at(spark, f"{name}.claim")
    if fs.exists(claim) and not fs.exists(final) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_SECONDS:
        fs.delete(claim, False)
    if not fs.createNewFile(claim):
        raise WriteConflict(f"version {state['version']} of {path} is taken")
    _, draft = _at(spark, f"{name}.draft")
    try:
        if fs.exists(final):
            raise WriteConflict(f"version {state['version']} of {path} is taken")
        stream = fs.create(draft, True)
        stream.write(json.dumps(state).encode())
        stream.close()
        if not fs.rename(draft, final):
            raise WriteConflict(f"version {state['version']} of {path} could not be put into place")
    finally:
        fs.delete(claim, False)


def upsert_by_year(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys,
    *,
    date: str = "date",
    order: str = "downloaded_at",
    validate: Callable[[DataFrame], None] | None = None,
    batch: tuple[str, int] | None = None,
) -> int:
    """Idempotent load: last write wins per key; returns the rows delivered.

    All years of the delivery become visible together, after `validate` has seen the merged rows; whatever
    fails before leaves the table as it was. Years that the delivery does not touch are neither read nor
    written, the others are written once. `batch` names a stream and the number of its batch: one that the
    table has taken in already changes nothing and counts 0. A delivery with a NULL key or date is refused:
    such a row belongs to no year and meets no other row. An empty one makes no version unless it is a batch.
    """
    state = manifest(spark, path)
    if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
        return 0
    new = materialise(new)
    commit = uuid.uuid4().hex
    folder, required = f"{path}/data/commit={commit}", [date, *([keys] if isinstance(keys, str) else keys)]
    columns, done = new.columns, False
    try:
        facts = new.groupBy(F.year(date).alias("year")).agg(
            F.count("*").alias("n"), F.count_if(reduce(operator.or_, [F.col(c).isNull() for c in required])).alias("lacking")
        ).collect()
        if any(f["lacking"] for f in facts):
            raise ValueError(f"a delivered row has a NULL among {required}")
        touched = {f["year"] for f in facts}
        if touched:
            old = {y for y in touched if str(y) in state["years"]}
            existing = _years(spark, path, state, old).select(*columns) if old else None
            merged = latest_by_key(existing, new, keys, order).withColumn("year", F.year(date))
            merged.hint("rebalance", "year").write.partitionBy("year").parquet(folder)
            schema = T.StructType([T.StructField(f.name, f.dataType) for f in new.schema])
            state = state | {"schema": schema.jsonValue(), "years": state["years"] | {str(y): commit for y in touched}}
            if validate is not None:
                validate(_years(spark, path, state, touched).select(*columns))
        if touched or batch is not None:
            if state["schema"] is None:
                state = state | {"schema": new.schema.jsonValue()}
            batches = state["batches"] | ({batch[0]: batch[1]} if batch is not None else {})
            _commit(spark, path, state | {"version": state["version"] + 1, "batches": batches})
        done = True
        return sum(f["n"] for f in facts)
    finally:
        # What failed after the rename has been committed all the same.
        if not done and commit not in manifest(spark, path)["years"].values():
            fs, left = _at(spark, folder)
            fs.delete(left, True)


def clear_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all but the newest `keep` versions and the folders no other version names; returns how many versions went.

    To be called while nothing writes to the table: a load under way has folders that no manifest names yet.
    """
    if keep < 1:
        raise ValueError("at least one version has to stay")
    known = versions(spark, path)
    gone, stay = known[:-keep], known[-keep:]
    named = {c for v in stay for c in manifest(spark, path, v)["years"].values()}
    for v in gone:
        fs, file = _at(spark, f"{path}/manifest/v{v:010d}.json")
        fs.delete(file, False)
    for name in _names(spark, f"{path}/data"):
        if name.removeprefix("commit=") not in named:
            fs, folder = _at(spark, f"{path}/data/{name}")
            fs.delete(folder, True)
    return len(gone)
