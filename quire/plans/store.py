"""Tables written once and read by several steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes of a table that may be sent to every task.
SMALL = 32 << 20


def folder(spark: SparkSession) -> str:
    """A new folder's name in ``spark.checkpoint.dir``, which all executors share; only where that is unset, in a local session, a
    folder of this machine is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` written as Parquet and read again, so that what follows does not compute it twice."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes of ``df``; no job runs. Enormous where Spark can't tell."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def source_bytes(df: DataFrame) -> int:
    """Estimated bytes of all that ``df`` is made from: unlike ``plan_bytes``, which multiplies the sides of a join, fit to divide work by."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is surely small; else as it is, and Spark joins it as it sees fit.

    Spark's estimate of what an aggregate leaves is the size of its input. So where the estimate is too large, ``df`` is written first and its
    files tell: the few names of a large table must not send that table's partner to as many tasks as there are names.
    """
    if plan_bytes(df) > SMALL:
        df = materialize(df, "small")
    return F.broadcast(df) if plan_bytes(df) <= SMALL else df
