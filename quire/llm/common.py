"""Helpers that the training-data operators share: the shared folder, sizes, hot keys, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts a null id after every other one.
NULL_ID = np.iinfo(np.int64).max


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor see.

    It lies in ``spark.checkpoint.dir``; only where that is unset (a local test session) a folder of this machine is
    made and remembered in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    # With the scheme of the file system that Spark itself would use, so that whoever else opens it finds the same folder.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


#: Tasks that may write a table of any size, and one of a few columns of numbers.
FILES, FEW = 40, 12
#: More tasks than any stage has.
MOST_FILES = 1 << 22


def materialize(df: DataFrame, name: str = "part", files: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: the lineage ends here, and no executor's loss matters.

    ``files``: the most tasks that write it, so that a small table is not dealt over every shuffle partition.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df = df.coalesce(min(files, MOST_FILES)) if files else df
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and no later plan reads; others are left alone."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def files_for(rows: int, per: int = 50_000, least: int = FILES) -> int:
    """Tasks to write ``rows`` rows: ``least``, or what holds about ``per`` rows in each."""
    return max(least, rows // per)


def compact(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, made from the table ``source`` row by row, in one task for each 2 MB of it at most (or ``FILES``)."""
    return df.coalesce(min(MOST_FILES, max(FILES, plan_bytes(source) >> 21)))


def with_place(df: DataFrame, column: str) -> DataFrame:
    """``df`` and ``column``, which sorts its rows as they were written, if it is read from files that Spark wrote.

    Spark numbers a table's files by the tasks that wrote them, but reads them by size. Rows of files of other names are sorted by number in
    their file, and rows that come from no file as they come.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("int")
    try:
        return df.withColumn(column, F.struct(number(r"^part-(\d+)").alias("task"), number(r"-c(\d+)\.").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return df.withColumn(column, F.struct(F.lit(0).alias("task"), F.lit(0).alias("file"), F.monotonically_increasing_id().alias("row")))


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes of ``df`` (file sizes for a scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized(df: DataFrame) -> DataFrame:
    """``df``, or where Spark can't tell its size (it comes from an RDD), the same rows written in the shared folder."""
    return df if plan_bytes(df) < 1 << 60 else materialize(df, "sized")


def parts_for(df: DataFrame, target: int) -> int:
    """Partitions that hold about ``target`` estimated bytes each, never fewer than the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_FILES, math.ceil(plan_bytes(df) / target)))


def hot_lookup(big: DataFrame, small: DataFrame, key: str, count: str, most: int = 1024) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per ``key``; ``count`` = the key's rows in ``big``) that no hot key unbalances.

    A key is hot if it holds more than 1/``most`` of all rows, so there are fewer than ``most`` hot keys and their rows of
    ``small`` may be broadcast; rows of the other keys meet in a shuffle join.
    """
    total = small.agg(F.sum(count).alias("__q_total"))
    marked = small.crossJoin(F.broadcast(total)).withColumn("__q_hot", F.col(count) * most > F.col("__q_total")).drop("__q_total")
    hot = marked.where("__q_hot").drop("__q_hot")
    cold = marked.where("NOT __q_hot").drop("__q_hot")
    keys = F.broadcast(hot.select(key))
    return big.join(F.broadcast(hot), key).unionByName(big.join(keys, key, "left_anti").join(cold, key))


def words_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text``; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def release() -> None:
    """Gives memory that arrays have left unused back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


_HELD: dict[str, dict] = {}


def held(owner: str | None = None) -> dict:
    """What a worker remembers from task to task for one operator (``owner``).

    Workers live on between stages, so what this one remembers for other operators is dropped when a task of another begins.
    """
    others = [name for name in _HELD if name != owner]
    for name in others:
        del _HELD[name]
    if others:
        gc.collect()
        release()
    return _HELD.setdefault(owner, {}) if owner else {}


def released(f):
    """``f``, a function on a task's table or on two, with ``release`` after it. Spark counts the arguments."""

    def one(table):
        held()
        try:
            return f(table)
        finally:
            release()

    def two(table, other):
        held()
        try:
            return f(table, other)
        finally:
            release()

    return two if f.__code__.co_argcount == 2 else one


# ---------------------------------------------------------------- hashes in numpy

_RNG = np.random.default_rng(20240607)
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_ODD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def rolling(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values of ``tokens`` (uint64), by doubling; ``len(tokens) - k + 1`` values."""
    if len(tokens) < k:
        return np.empty(0, np.uint64)
    out, have, cur, span, power, rest = None, 0, tokens, 1, _ODD, k
    while True:
        if rest & 1:
            if out is None:
                out, have = cur, span
            else:
                n = min(len(out), len(cur) - have)
                out = out[:n] * np.uint64(power) + cur[have : have + n]
                have += span
        rest >>= 1
        if not rest:
            return mix(out[: len(tokens) - k + 1])
        n = len(cur) - span
        cur = cur[:n] * np.uint64(power) + cur[span : span + n]
        span, power = span * 2, power * power & MASK


IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in a byte buffer."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~IS_SEP[buf], [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes alone."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = ends - starts
    total = int(n.sum())
    within = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    flat = BYTE_HASH[buf[within + np.repeat(starts, n)]]
    most = int(n.max())
    powers = np.empty(most, np.uint64)
    p = 1
    for i in range(min(most, 64)):
        powers[i] = p
        p = p * _ODD & MASK
    done = min(most, 64)
    while done < most:  # the powers of a long word, by doubling
        take = min(done, most - done)
        powers[done : done + take] = powers[:take] * np.uint64(pow(_ODD, done, 1 << 64))
        done += take
    flat *= powers[within]
    return mix(np.add.reduceat(flat, np.cumsum(n) - n) + n.astype(np.uint64))
