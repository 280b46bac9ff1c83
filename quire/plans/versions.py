"""A keyed table in versions: a change rewrites only the buckets of the keys it touches, and appears whole or not at all.

A version is a small file that names a folder of data for each bucket. A change writes new folders beside the old ones and then
creates the next version's file, which fails if another change has created it first. So readers always see one version, a job
that fails leaves the table as it was, and old versions can be read until ``forget`` takes what they alone hold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__q_bucket"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _publish(spark: SparkSession, folder: str, version: int, known: dict) -> None:
    """Writes a version's file; an error if it is there already."""
    path, files = _path(spark, f"{folder}/versions/{version:012}.json")
    out = files.create(path, False)
    try:
        out.write(bytearray(json.dumps(known, sort_keys=True).encode()))
    finally:
        out.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that can be read, oldest first."""
    path, files = _path(spark, f"{folder}/versions")
    return sorted(int(s.getPath().getName().split(".")[0]) for s in files.listStatus(path)) if files.exists(path) else []


def _known(spark: SparkSession, folder: str, version: int | None) -> tuple[int, dict]:
    have = versions(spark, folder)
    if not have or (version is not None and version not in have):
        raise ValueError(f"no such version of {folder}")
    version = have[-1] if version is None else version
    path, files = _path(spark, f"{folder}/versions/{version:012}.json")
    stream = files.open(path)
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _written(df: DataFrame, folder: str, key: str, buckets: int) -> dict[str, str]:
    """``df`` written by bucket into a folder of its own: the folder of each bucket that has rows."""
    spark, name = df.sparkSession, f"data/{uuid.uuid4().hex}"
    dealt = df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)))
    # A key's rows may be many: they are spread over tasks, not gathered by bucket.
    dealt.repartition(BUCKET, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy(BUCKET).parquet(f"{folder}/{name}")
    path, files = _path(spark, f"{folder}/{name}")
    found = [s.getPath().getName() for s in files.listStatus(path)]
    return {f.split("=")[1]: f"{name}/{f}" for f in found if f.startswith(f"{BUCKET}=")}


def create(df: DataFrame, folder: str, key: str, buckets: int = 64) -> int:
    """The first version of a table, whose rows are dealt into ``buckets`` by ``key``; an error if there is one already. Returns its number."""
    spark = df.sparkSession
    if versions(spark, folder):
        raise ValueError(f"{folder} has a table already")
    known = {"key": key, "buckets": buckets, "schema": df.schema.json(), "data": _written(df, folder, key, buckets)}
    _publish(spark, folder, 1, known)
    return 1


def _read(spark: SparkSession, folder: str, known: dict, buckets: list[str] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(known["schema"]))
    paths = [f"{folder}/{p}" for b, p in sorted(known["data"].items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as it is, or as it was in a version."""
    return _read(spark, folder, _known(spark, folder, version)[1])


def change(incoming: DataFrame, folder: str, merged: Callable[[DataFrame, DataFrame], DataFrame], attempts: int = 5) -> int:
    """The table with ``incoming`` merged in; returns the new version's number.

    ``merged(existing, incoming)`` gets the rows of the touched buckets (all rows of every key that ``incoming`` names, and of keys
    that share their buckets) and must keep those that it doesn't change. If another change is published meanwhile, it is merged again on
    top of that one. Nothing to merge makes no version.
    """
    spark = incoming.sparkSession
    for _ in range(attempts):
        version, known = _known(spark, folder, None)
        key, buckets = known["key"], known["buckets"]
        touched = {str(r[0]) for r in incoming.select(F.pmod(F.xxhash64(key), F.lit(buckets))).distinct().collect()}  # no more than there are buckets
        if not touched:
            return version
        new = _written(merged(_read(spark, folder, known, sorted(touched)), incoming), folder, key, buckets)
        if set(new) - touched:
            raise ValueError("a merge made rows of keys that the change does not name")
        data = {b: p for b, p in known["data"].items() if b not in touched} | new
        try:
            _publish(spark, folder, version + 1, known | {"data": data})
            return version + 1
        except Exception:
            if version + 1 not in versions(spark, folder):
                raise
    raise RuntimeError(f"{attempts} other changes of {folder} came first")


def forget(spark: SparkSession, folder: str, before: int) -> int:
    """Takes versions older than ``before`` away with the data that no other version names; returns how many folders went.

    The last version stays. Only for a table that no job is changing.
    """
    have = versions(spark, folder)
    old, kept = [v for v in have[:-1] if v < before], [v for v in have if v >= before or v == have[-1]]
    needed = {p.split("/")[1] for v in kept for p in _known(spark, folder, v)[1]["data"].values()}
    gone = 0
    for v in old:
        path, files = _path(spark, f"{folder}/versions/{v:012}.json")
        files.delete(path, False)
    path, files = _path(spark, f"{folder}/data")
    for s in files.listStatus(path):
        if s.getPath().getName() not in needed:
            files.delete(s.getPath(), True)
            gone += 1
    return gone
