"""Sorted tables with a sparse index, for lookups that open only the files that can hold a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.store import source_bytes

#: Estimated bytes of the sources of a file; an index of words is several times as large, and a task sorts it in memory.
FILE_BYTES = 16 << 20


def write_sorted(df: DataFrame, order: list[str], folder: str, files: int | None = None) -> None:
    """``df`` in files that are sorted by ``order`` and cut its first column into ranges, and an index of them.

    The index has a row for each file: its name and its first and last value of the first column. A value that fills several files is
    in each of them. Null values are kept, but a lookup does not find them.
    """
    size = source_bytes(df)
    files = files or max(1, -(-size // FILE_BYTES) if size < 1 << 60 else 64)
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/data")
    # Read back, not kept from the job: what a task that was run again has left is not in it.
    rows = df.sparkSession.read.parquet(f"{folder}/data").select(F.col("_metadata.file_name").alias("file"), F.col(order[0]).alias("value"))
    rows.groupBy("file").agg(F.min("value").alias("first"), F.max("value").alias("last")).where("first IS NOT NULL").sort("first").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")


def looked_up(spark: SparkSession, folder: str, column: str, *values: object) -> DataFrame:
    """The rows of a sorted table whose first sorted column, ``column``, has one of ``values``: other files are not opened.

    The driver learns the names of the files that can hold them, no more.
    """
    index = spark.read.parquet(f"{folder}/index")
    holds: Column = F.lit(False)
    for v in values:
        holds = holds | ((F.col("first") <= F.lit(v)) & (F.col("last") >= F.lit(v)))
    names = [r["file"] for r in index.where(holds).select("file").collect()]
    if not names:
        return spark.read.parquet(f"{folder}/data").limit(0)
    return spark.read.schema(spark.read.parquet(f"{folder}/data").schema).parquet(*[f"{folder}/data/{n}" for n in names]).where(F.col(column).isin(*values))
