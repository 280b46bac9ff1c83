"""Versioned history of dimension rows: each key's days painted in an array, then run-length encoded.

Of the changes of a key that start on one day only the last-arrived base change and the last-arrived correction of each
length can matter, so changes are reduced to those before they meet: a key has at most a few rows for each day of the calendar,
whatever the number of its changes. A key's array has one cell for each day that a change can touch; the last cell stands for
all days to come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import compact

DAYS, SPAN = 365, 3
UPDATE, DELETE, CORRECTION = 0, 1, 2


def paint(start: np.ndarray, kind: np.ndarray, arrived: np.ndarray, days: int, span: int) -> np.ndarray:
    """For each day 0 .. ``days + span - 1`` the number of the change in force, or -1. ``arrived`` ranks the changes by arrival.

    The base is filled by start; corrections are painted over it in order of arrival.
    """
    cells = np.full(days + span, -1)
    base = np.flatnonzero(kind != CORRECTION)
    for i in base[np.lexsort((arrived[base], start[base]))].tolist():
        cells[start[i] :] = i
    over = np.flatnonzero(kind == CORRECTION)
    for i in over[np.argsort(arrived[over], kind="stable")].tolist():
        cells[start[i] : start[i] + span] = i
    return cells


def runs(cells: np.ndarray, kind: list[int], value: list) -> Iterator[tuple[int, int | None, object]]:
    """Maximal runs of present days with equal value as first day, day after (none: endless) and value."""
    edges = np.concatenate(([0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)])).tolist()
    begin = held = None
    for a, b in zip(edges, edges[1:], strict=False):
        c = int(cells[a])
        present = c >= 0 and kind[c] != DELETE
        if begin is not None and not (present and value[c] == held):
            yield begin, a, held
            begin = None
        if present and begin is None:
            begin, held = a, value[c]
    if begin is not None:
        yield begin, None, held


def versions(changes: DataFrame, key: str = "doc_id", start: str = "start", kind: str = "kind", value: str = "value", arrival: tuple[str, ...] = ("arrived",), days: int = DAYS, span: int = SPAN) -> DataFrame:
    """``key``, ``version``, ``valid_from``, ``valid_to`` and ``value`` of each key's history.

    ``changes``: a key (long), the day it starts on (0 to ``days - 1``), its kind (``UPDATE``, ``DELETE`` or ``CORRECTION``, which holds
    for ``span`` days from its start) and a value (a string, or null); ``arrival`` names the columns that order changes by
    arrival, ties go to the correction, then the
    delete, then the larger value (null is smallest). A day takes the last-arrived correction that covers it, else the
    base change with the latest start not after it, ties to the last-arrived. After a delete, and where nothing is in force, there
    is no version; a null value is a version. Equal values that follow each other are one. ``valid_to`` is exclusive, null if
    endless. Changes with a null key, kind or day, or a day outside the calendar, concern no day and are ignored; repeated
    changes count once. A key with deletes only, and an empty table, give no row; other columns are ignored.
    """
    rows = changes.select(F.col(key).cast("long").alias("__q_key"), F.col(start).cast("int").alias("__q_start"), F.col(kind).cast("int").alias("__q_kind"), F.struct(*[F.col(c).alias(f"a{i}") for i, c in enumerate(arrival)], F.col(kind).cast("int").alias("k"), F.col(value).cast("string").alias("v")).alias("__q_what"))
    rows = rows.where(F.col("__q_key").isNotNull() & F.col("__q_start").between(0, days - 1) & F.col("__q_kind").isin(UPDATE, DELETE, CORRECTION))
    # The last arrived of each key, day and layer: combined before it is sent, so a hot key is some rows of each task.
    last = rows.groupBy("__q_key", "__q_start", (F.col("__q_kind") == CORRECTION).alias("__q_over")).agg(F.max("__q_what").alias("__q_what"))
    # At most two rows a day of the calendar for each key.
    whole = compact(last.groupBy("__q_key").agg(F.array_sort(F.collect_list(F.struct("__q_what", "__q_start"))).alias("l")), changes)
    lists = whole.select("__q_key", F.transform("l", lambda x: x["__q_start"]).alias("s"), F.transform("l", lambda x: x["__q_what"]["k"]).alias("k"), F.transform("l", lambda x: x["__q_what"]["v"]).alias("v"))

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, kinds, values = (batch.column(i) for i in range(4))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                s, k = (np.asarray(x[i].values, np.int64) for x in (starts, kinds))
                cells = paint(s, k, np.arange(len(s)), days, span)  # lists are in order of arrival
                no = keys[i].as_py()
                out += [(no, j, a, b, v) for j, (a, b, v) in enumerate(runs(cells, k.tolist(), values[i].as_py()), 1)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds_of = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_of, strict=True)], names=["__q_key", "version", "valid_from", "valid_to", "value"])

    return lists.mapInArrow(histories, "__q_key long, version int, valid_from long, valid_to long, value string").withColumnRenamed("__q_key", key)


def changes_of(docs: DataFrame, each: int = 2, group: int = 5) -> DataFrame:
    """``each`` changes of every document: ``doc_id`` (concerned), ``start``, ``kind``, ``value``, ``h``, ``made_by`` and ``j``.

    Digits of a hash of id and number decide day, kind and arrival. A null id makes no change.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("made_by"), "lang", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("j"))
    rows = rows.withColumn("h", F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("made_by").cast("string"), F.col("j").cast("string")), 256), 1, 12), 16, 10).cast("long"))
    digit = F.call_function("div", F.col("h"), F.lit(1000)) % 10
    kind = F.when(digit < 2, DELETE).when(digit < 5, CORRECTION).otherwise(UPDATE)
    return rows.select((F.col("made_by") - F.pmod("made_by", F.lit(group))).alias("doc_id"), (F.col("h") % DAYS).cast("int").alias("start"), kind.alias("kind"), F.col("lang").alias("value"), "h", "made_by", "j")


def op12_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return versions(changes_of(docs), arrival=("h", "made_by", "j"))
