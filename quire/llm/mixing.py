"""Mixing sources to target weights by Pfair scheduling, as DataFrame operations only.

Block i of a source with weight w, of a total W, is released at slot floor(i * W / w) and due by slot ceil((i + 1) * W / w).
On one line of slots, taking the released block with the earliest deadline meets every deadline, so after any number of
slots each source has its share to within less than one block. Weights are whole numbers, so releases and deadlines are
exact for as many slots as there are. A block has ``BLOCK`` rows in a corpus of any size.

The line is worked off in stretches of ``STRETCH`` slots, one job each; a stretch hands its sources' states on to the next, so the
order is that of one line and no task holds more than a stretch. A document's place follows from its number within its
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import FEW, files_for, materialize

#: Rows of a block, and slots of a stretch of the schedule.
BLOCK, STRETCH = 8, 1 << 16
#: Parts in which weights that are not whole numbers are counted.
PARTS = 1 << 40
#: Slots of a schedule that are gathered before they are added to it.
RUN = 256
#: Rows that are numbered within one task, about.
RANGE = 2_000
SEED = 29


def _div(a: Column, b: Column) -> Column:
    """Whole part of a quotient of longs that are not negative, in whole numbers."""
    return F.call_function("div", a, b)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def source_key(source: Column) -> Column:
    """A source's key, never null: ``=`` and the name; empty for the null source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_sizes(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """``__q_source`` (``source_key``; null sources are one source of their own) and ``n``, its rows."""
    return docs.groupBy(source_key(F.col(source_col)).alias("__q_source")).agg(F.count("*").alias("n"))


def whole_weights(weights: DataFrame) -> DataFrame:
    """``__q_source`` and ``weight`` as whole numbers in the same proportions; sources without a positive weight go.

    Whole numbers that sum to less than ``PARTS`` stay; others are rounded to parts of ``PARTS`` in all, at least one each.
    """
    whole = Window.partitionBy()
    some = weights.where("weight > 0 AND weight < double('infinity')").withColumn("t", F.sum("weight").over(whole))
    exact = F.min((F.col("weight") == F.floor("weight")).cast("int")).over(whole) == 1
    some = some.withColumn("w", F.when(exact & (F.col("t") < PARTS), F.col("weight").cast("long")).otherwise(F.greatest(F.lit(1), F.round(F.col("weight") / F.col("t") * PARTS).cast("long"))))
    return some.select("__q_source", F.col("w").alias("weight"))


def admitted(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """Of each source with rows and a positive weight: ``n``, ``weight`` and ``m``, the rows that the targets admit.

    The first source of which the weights ask for more than it has ends the mix; all others give their share up to there.
    """
    rows = sizes.join(whole_weights(weights), "__q_source")
    first = F.min(F.struct((F.col("n") / F.col("weight")).alias("x"), "n", "weight")).over(Window.partitionBy())
    share = _div(F.col("weight").cast("decimal(20,0)") * first["n"], first["weight"].cast("decimal(20,0)")).cast("long")
    return rows.select("__q_source", "n", "weight", F.least("n", share).alias("m"))


def schedule(parts: DataFrame, size: int, stretch: int = STRETCH) -> DataFrame:
    """The slots of each part of ``parts`` (``part``, ``__q_source``, ``weight``, ``rows``) in blocks of ``size`` rows.

    Returns ``part``, ``slot``, ``__q_source``, ``i`` (the source's block) and ``before`` (rows in the part's slots before).

    Earliest deadline first among released blocks; equal deadlines go to the first source in order of name. A source
    without a block left leaves the schedule; a slot for which no block is released takes the one that is due first.
    ``stretch`` changes no result.
    """
    each = parts.where("rows > 0").withColumn("blocks", _div(F.col("rows") + size - 1, F.lit(size)))
    each = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("__q_source", "weight", "blocks", "rows"))).alias("o"))
    each = each.withColumn("w", F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x["weight"])).withColumn("t", F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x["blocks"]))

    def block(x: Column, k: Column, release: Column, over: Column) -> Column:
        """What a source's block ``k`` is judged by: its deadline and its release, k * W / w as a whole part and what is left ``over``."""
        due = release + _div(over + F.col("w") + x["weight"] - 1, x["weight"])
        return F.struct(F.when(k < x["blocks"], due).otherwise(F.lit(1 << 62)).alias("due"), release.alias("release"), over.alias("over"), k.alias("k"))

    def following(x: Column, b: Column) -> Column:
        release = lambda v: F.least(b["release"] + _div(v, x["weight"]), F.lit(1 << 61))  # noqa: E731  no slot is later
        return let(b["over"] + F.col("w"), lambda v: block(x, b["k"] + 1, release(v), v % x["weight"]))

    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<i:int,k:bigint,before:bigint>>")

    def chosen(state: Column, t: Column) -> Column:
        rank = lambda x, i: F.struct(((x["release"] > t) | (x["due"] == 1 << 62)).alias("late"), x["due"].alias("due"), i.alias("i"), x["k"].alias("k"))
        return F.array_min(F.transform(state, rank))

    def step(acc: Column, t: Column) -> Column:
        def taken(c: Column) -> Column:
            after = F.transform(acc["state"], lambda x, i: F.when(i == c["i"], following(F.get("o", i), x)).otherwise(x))
            slot = F.struct(c["i"].alias("i"), c["k"].alias("k"), acc["before"].alias("before"))
            rows = F.least(F.lit(size).cast("long"), F.get("o", c["i"])["rows"] - c["k"] * size)
            return F.struct(after.alias("state"), (acc["before"] + rows).alias("before"), F.concat(acc["run"], F.array(slot)).alias("run"))

        return let(chosen(acc["state"], t), taken)

    end = F.least(F.col("at") + stretch, F.col("t"))

    def run(acc: Column, start: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), acc["before"].alias("before"), none.alias("run"))
        slots = F.sequence(start, F.least(start + RUN, end) - 1)
        return let(F.aggregate(slots, begin, step), lambda r: F.struct(r["state"].alias("state"), r["before"].alias("before"), F.concat(acc["runs"], F.array(r["run"])).alias("runs")))

    begin = F.struct("state", "before", F.array().cast("array<array<struct<i:int,k:bigint,before:bigint>>>").alias("runs"))
    starts = F.sequence(F.col("at"), end - 1, F.lit(RUN).cast("long"))
    each = each.withColumns({"at": zero, "state": F.transform("o", lambda x: block(x, zero, zero, zero)), "before": zero})
    done = []
    for at in range(0, each.agg(F.max("t")).first()[0] or 0, stretch):
        worked = each.where(F.col("t") > at).select("part", "o", "w", "t", "at", F.aggregate(starts, begin, run).alias("r"))
        done.append(materialize(worked.select("part", "o", "w", "t", "at", F.flatten("r.runs").alias("order"), "r.state", "r.before"), "stretch"))
        each = done[-1].withColumn("at", F.col("at") + stretch)
    paths = [d.written_to for d in done]
    slots = (parts.sparkSession.read.schema(done[0].schema).parquet(*paths) if done else each.withColumn("order", none)).select("part", "o", "at", F.posexplode("order").alias("slot", "e"))
    return slots.select("part", (F.col("at") + F.col("slot")).alias("slot"), F.get("o", F.col("e.i"))["__q_source"].alias("__q_source"), F.col("e.k").alias("i"), F.col("e.before").alias("before"))


def numbered(rows: DataFrame, order: list[Column], ranges: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with ``__q_source``) numbered by ``__q_range`` and ``__q_k``, and the table of ranges.

    ``__q_k`` is the row's number within its range, from 0, in order of a hash; of each source and range the table has
    ``__q_n``, its rows, and ``__q_first``, the source's rows in the ranges before. So no task holds a source, and a source of any
    size is spread evenly.
    """
    rows = rows.withColumn("__q_h", F.xxhash64(F.lit(SEED), *order))
    rows = rows.withColumn("__q_range", F.floor((F.shiftright("__q_h", 32) + F.lit(1 << 31)) * ranges / F.lit(1 << 32)).cast("long"))
    sizes = rows.groupBy("__q_source", "__q_range").agg(F.count("*").alias("__q_n"))
    before = Window.partitionBy("__q_source").orderBy("__q_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__q_source", "__q_range").orderBy("__q_h", *order)
    return rows.withColumn("__q_k", F.row_number().over(within) - 1).drop("__q_h"), sizes.withColumn("__q_first", F.coalesce(F.sum("__q_n").over(before), F.lit(0)))


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, slots: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """``docs`` with ``mix_position``, ``mix_block`` and ``in_mix``; columns of these names are replaced.

    ``weights`` has a source column first and ``weight`` (positive numbers; the sources' sizes if none is given). Rows of a
    source, in order of a hash of their columns, fill blocks of ``block`` rows (more where a caller asks for about ``slots``
    blocks), the last one perhaps in part; the schedule places the blocks. ``mix_position`` numbers the rows and ``mix_block`` the
    blocks from 0, without gaps. ``in_mix`` marks all rows that the targets admit: the rows of the first source that its
    weight uses up, and of every other source its share of as many; with the default weights, all rows. After any number
    of blocks of the mix each source is within less than one block of its share. The other rows follow by the same
    rule with ``in_mix`` false: no row is dropped. Null sources are a source; a source without a positive, finite weight has null
    positions. Rows that are equal in all columns are interchangeable. An empty table gives an empty one.
    """
    base = docs.drop("mix_position", "mix_block", "in_mix")
    sizes = materialize(source_sizes(base, source_col), "sizes", FEW)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    block = max(block, -(-total // slots)) if slots else block
    if weights is None:
        weights = sizes.select("__q_source", F.col("n").cast("double").alias("weight"))
    else:
        weights = weights.select(source_key(F.col(weights.columns[0])).alias("__q_source"), F.col("weight").cast("double"))
    shares = materialize(admitted(sizes, weights), "shares", FEW)
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("m").alias("rows")), F.struct(F.lit(1).alias("part"), (F.col("n") - F.col("m")).alias("rows")))
    parts = shares.select("__q_source", "weight", F.explode(parts).alias("e")).select("__q_source", "weight", "e.part", "e.rows")
    ends = F.broadcast(parts.where("part = 0").agg(F.sum("rows").alias("r"), F.sum(_div(F.col("rows") + block - 1, F.lit(block))).alias("b")))
    after = lambda c: F.when(F.col("part") == 1, F.coalesce(c, F.lit(0))).otherwise(0)  # noqa: E731  part 1 follows part 0
    known = F.broadcast(shares.select("__q_source", F.col("m").alias("__q_m"), _div(F.col("m") + block - 1, F.lit(block)).alias("__q_blocks")))
    places = schedule(parts, block, stretch).crossJoin(ends).join(known, "__q_source")
    places = places.select("__q_source", (F.col("i") + after(F.col("__q_blocks"))).alias("__q_j"), (F.col("slot") + after(F.col("b"))).cast("long").alias("mix_block"), (F.col("before") + after(F.col("r"))).cast("long").alias("__q_before"))

    def of_block(k: Column) -> Column:
        """A source's block that holds its row ``k``: the blocks of part 1 follow those of part 0."""
        return F.when(k < F.col("__q_m"), _div(k, F.lit(block))).otherwise(F.col("__q_blocks") + _div(k - F.col("__q_m"), F.lit(block)))

    order = [F.col(id_col).cast("string"), *[F.col(f"`{c}`").cast("string") for c, kind in base.dtypes if c != id_col and kind in ("string", "bigint", "int", "double", "boolean")]]
    rows, ranges = numbered(base.withColumn("__q_source", source_key(F.col(source_col))), order, max(1, total // RANGE))
    # Each range gets the places of its few blocks, so places travel to the rows' ranges and the rows stay where they were numbered.
    ranges = ranges.join(known, "__q_source", "left").withColumn("__q_low", of_block(F.col("__q_first")))
    wanted = ranges.where("__q_m IS NOT NULL").select("__q_source", "__q_range", F.explode(F.sequence("__q_low", of_block(F.col("__q_first") + F.col("__q_n") - 1))).alias("__q_j"))
    found = wanted.join(places.hint("merge"), ["__q_source", "__q_j"]).groupBy("__q_source", "__q_range").agg(F.array_sort(F.collect_list(F.struct("__q_j", "mix_block", "__q_before"))).alias("__q_places"))
    ranges = ranges.join(found.hint("merge"), ["__q_source", "__q_range"], "left").drop("__q_n")
    ranges = materialize(ranges, "ranges", files_for(total // RANGE, 1_000, FEW))

    out = rows.join(ranges.hint("merge"), ["__q_source", "__q_range"]).withColumn("__q_k", F.col("__q_k") + F.col("__q_first"))
    place = F.get("__q_places", (of_block(F.col("__q_k")) - F.col("__q_low")).cast("int"))
    within = F.when(F.col("__q_k") < F.col("__q_m"), F.col("__q_k")).otherwise(F.col("__q_k") - F.col("__q_m")) % block
    out = out.withColumns({"mix_position": (place["__q_before"] + within).cast("long"), "mix_block": place["mix_block"], "in_mix": F.coalesce(F.col("__q_k") < F.col("__q_m"), F.lit(False))})
    return out.select(*base.columns, "mix_position", "mix_block", "in_mix")


def root_weights(docs: DataFrame, source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """A target for each source of ``docs``: the root of its characters, so that large sources don't drown small ones. At least 1."""
    size = F.greatest(F.lit(1.0), F.sum(F.coalesce(F.col(size_col), F.lit(0)).cast("double")))
    return docs.groupBy(F.col(source_col)).agg(F.sqrt(size).alias("weight"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source"), root_weights(docs)).select("doc_id", "source", "mix_position", "mix_block", "in_mix")
