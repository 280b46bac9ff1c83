"""Running values over ranges of a key: what a window over the whole key would give, without the whole key in one task.

Rows are dealt over parts of their order, each part gives one row for each key with what it hands on, and the parts of a key are
added up in a table of that size. A part's rows then need what came before the part and their own part only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.plans.store import materialize, source_bytes

#: Estimated bytes of a part.
PART_BYTES = 16 << 20
PART = "__q_part"


def carried(rows: DataFrame, keys: list[str], order: list[str], part: str = PART, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """``rows`` with, for each name in ``last``, the last value that is not null among the key's rows up to this one, and for each in ``total`` the sum.

    ``part`` must not fall as ``order`` rises within a key; rows that are equal in ``order`` come in any order. With
    ``inclusive`` false the row itself doesn't count. Null keys are a key.
    """
    last, total = last or {}, total or {}
    value = lambda n: f"__q_v_{n}"
    before_row = (Window.unboundedPreceding, 0 if inclusive else -1)
    near = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(*before_row)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumns({value(n): c for n, c in {**last, **total}.items()})
    place = F.struct(*[F.col(c) for c in order])
    ends = dealt.groupBy(*keys, part).agg(*[F.max_by(value(n), F.when(F.col(value(n)).isNotNull(), place)).alias(n) for n in last], *[F.sum(value(n)).alias(n) for n in total])
    handed = {n: F.last(n, ignorenulls=True).over(before) for n in last} | {n: F.sum(n).over(before) for n in total}
    carry = ends.select(*[F.col(k).alias(f"__q_k{i}") for i, k in enumerate([*keys, part])], *[c.alias(f"__q_b_{n}") for n, c in handed.items()])
    same = [F.col(k).eqNullSafe(F.col(f"__q_k{i}")) for i, k in enumerate([*keys, part])]
    own = {f"__q_n_{n}": F.last(value(n), ignorenulls=True).over(near) for n in last} | {f"__q_n_{n}": F.sum(value(n)).over(near) for n in total}
    joined = dealt.join(carry, same).withColumns(own)
    out = {n: F.coalesce(f"__q_n_{n}", f"__q_b_{n}") for n in last} | {n: F.coalesce(f"__q_n_{n}", F.lit(0)) + F.coalesce(f"__q_b_{n}", F.lit(0)) for n in total}
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def sorted_place(cuts: Column, x: Column) -> Column:
    """How many of ``cuts`` (ascending) are below ``x``, by halving: as many steps as the array's size has bits."""

    def halve(a: Column, _: Column, c: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(c, mid) < x, F.lit(False))
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(a["hi"]).alias("hi"))

    start = lambda c: F.struct(F.lit(0).alias("lo"), F.size(c).alias("hi"))
    return let(cuts, lambda c: F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(c) + 2)).cast("int")), start(c), lambda a, s: halve(a, s, c), lambda a: a["lo"]))


def in_parts(rows: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``PART``: the range of ``order`` (a number or time) in which a row lies, cut at quantiles of the whole table.

    As many parts as the table's estimated size asks for, from 4 GB on in proportion to its root; a table of one part is not
    read for it. A null is in part 0.
    """
    if parts is None:
        size = source_bytes(rows)
        units = size // PART_BYTES if size < 1 << 60 else 64  # a size that Spark can't tell
        parts = max(1, min(units, 16 * math.isqrt(units)))
    if parts == 1:
        return rows.withColumn(PART, F.lit(0))
    kind = dict(rows.dtypes)[order]
    x = F.col(order).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(order).cast("double")
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = rows.select(x.alias("x")).agg(F.percentile_approx("x", shares, F.lit(max(10_000, 10 * parts))).alias("__q_c"))
    dealt = rows.crossJoin(F.broadcast(cuts))  # one row, of one number a part
    return dealt.withColumn(PART, F.when(x.isNull(), 0).otherwise(F.coalesce(sorted_place(F.col("__q_c"), x), F.lit(0)))).drop("__q_c")



def sorted_parts(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``PART``, for an order of any types: the sorted range in which Spark puts a row, written so that it stays the same."""
    size = source_bytes(rows)
    parts = max(1, size // PART_BYTES) if size < 1 << 60 else 64
    return materialize(rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), "parts")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number within ``keys`` from 1, in ``order``; a key's rows are numbered in many tasks."""
    named = rows.withColumns({f"__q_o{i}": c for i, c in enumerate(order)})
    places = [f"__q_o{i}" for i in range(len(order))]
    dealt = sorted_parts(named, [F.col(c) for c in [*keys, *places]])
    return carried(dealt, keys, places, total={name: F.lit(1).cast("long")}).drop(PART, *places)
