"""A reader's own relations: history, bookmarks, notes, and backups of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ranges import numbered

HISTORY = 10
STORE = "notes MAP<STRING,STRING>, bookmarks ARRAY<STRING>"


def recent(events: DataFrame, user: str, key: str, ts: str, tie: str, most: int = HISTORY) -> DataFrame:
    """Each user's ``most`` latest different keys, newest first. Repeats are folded before any ranking."""
    last = events.groupBy(user, key).agg(F.max(F.struct(ts, tie)).alias("last"))
    order = Window.partitionBy(user).orderBy(F.desc("last"), key)
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(user, key, F.col(f"last.{ts}").alias(ts), "rank")


def toggled(events: DataFrame, *key: str) -> DataFrame:
    """Keys that were toggled an odd number of times."""
    return events.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select(*key)


def merge_notes(existing: DataFrame, incoming: DataFrame, key: str = "ref", text: str = "text") -> DataFrame:
    """All keys of both; the incoming text wins."""
    new = incoming.select(F.col(key), F.col(text).alias("__q_new"), F.lit(True).alias("__q_in"))
    return existing.join(new, key, "full").select(key, F.when(F.col("__q_in"), F.col("__q_new")).otherwise(F.col(text)).alias(text))


def merge_bookmarks(existing: DataFrame, incoming: DataFrame, key: str = "ref", seq: str = "seq") -> DataFrame:
    """All bookmarks once, existing ones first, each where it first stood."""
    both = existing.select(key, F.struct(F.lit(0).alias("side"), F.col(seq).alias("seq")).alias("at")).unionAll(incoming.select(key, F.struct(F.lit(1).alias("side"), F.col(seq).alias("seq")).alias("at")))
    return both.groupBy(key).agg(F.min("at").alias("at")).select(key, F.col("at.side").alias("side"), F.col("at.seq").alias("seq"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``existing`` whose key is not replaced, and those of ``incoming`` after them."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def ordered_union(existing: DataFrame, present: DataFrame, key: str, order: str) -> DataFrame:
    """What is still present in its old order, then what is new in order of name."""
    old = existing.join(present.select(key), key, "left_semi").select(key, F.lit(0).alias("side"), F.col(order).cast("long").alias("place"))
    new = present.join(existing.select(key), key, "left_anti").select(key, F.lit(1).alias("side"), F.lit(0).cast("long").alias("place"))
    return old.unionAll(new.distinct())


def filter_notes(notes: DataFrame, query: str, shown_ref: str | None = None) -> DataFrame:
    """Notes that are not blank and hold the query in their text or key, or in the reference as shown."""
    q = query.strip().lower()
    hit = F.contains(F.lower("text"), F.lit(q)) | F.contains(F.lower("ref"), F.lit(q))
    if shown_ref:
        hit = hit | F.contains(F.lower(shown_ref), F.lit(q))
    return notes.where((F.trim("text") != "") & hit)


def of_chapter(rows: DataFrame, work: str, chapter: str, key: str = "ref") -> DataFrame:
    """Notes or bookmarks of one chapter: those whose reference begins with it."""
    return rows.where(F.startswith(key, F.lit(f"{work}:{chapter}:")))


def matching_bookmarks(marks: DataFrame, query: str, *fields: str) -> DataFrame:
    """Bookmarks that hold the query in one of ``fields`` (the verse's text, the reference as shown or as stored), whatever the case."""
    q = F.lit(query.strip().lower())
    return marks.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), q), F.lit(False)) for f in fields]))


def listed(rows: DataFrame, key: str = "ref") -> DataFrame:
    """References in a reader's order: by work, by chapter as text, by verse as a number; sorted over the cluster."""
    return rows.sort(*reader_order(key))


def reader_order(key: str = "ref") -> list[Column]:
    """What a reader's references are sorted by."""
    parts = F.split(key, ":")
    return [F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.element_at(parts, -1).try_cast("long"), F.col(key)]


def places(rows: DataFrame, key: str = "ref") -> DataFrame:
    """``rows`` with ``work`` and ``place``, their number from 1 within the work in a reader's order; a large work is numbered in many tasks."""
    work, *rest = reader_order(key)
    return numbered(rows.withColumn("work", work), ["work"], rest, "place")


def replaced(stores: DataFrame, incoming: DataFrame, keys: list[str], user: str = "user_id") -> DataFrame:
    """Users' stores after an import that replaces: each of ``keys`` is the incoming one, null where the import lacks it.

    Users without an import keep their stores.
    """
    new = incoming.select(F.col(user), *[F.col(k).alias(f"__q_{k}") for k in keys], F.lit(True).alias("__q_in"))
    rows = stores.join(new, user, "full")
    return rows.select(user, *[F.when(F.col("__q_in"), F.col(f"__q_{k}")).otherwise(F.col(k)).alias(k) for k in keys])


def migrated(stores: DataFrame, json: str = "store", old: str = "old_notes") -> DataFrame:
    """Stores of an older form: a user without a readable store who has notes under the old key gets a store of them.

    The old notes are a JSON object of texts; a store that can be read wins, and what can't be read on either side is left out.
    """
    notes = F.from_json(old, "map<string,string>")
    known = F.from_json(json, STORE)
    made = F.to_json(F.struct(notes.alias("notes"), F.array().cast("array<string>").alias("bookmarks")))
    readable = known.isNotNull() & (known["notes"].isNotNull() | known["bookmarks"].isNotNull())
    return stores.withColumn(json, F.when(readable, F.col(json)).when(notes.isNotNull(), made)).drop(old)


def backup(notes: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """A user's store as JSON: a row for each user, as large as what that user wrote."""
    n = notes.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", "text")))).alias("notes"))
    b = bookmarks.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ref"))), lambda x: x["ref"]).alias("bookmarks"))
    store = F.to_json(F.struct(F.coalesce("notes", F.create_map().cast("map<string,string>")).alias("notes"), F.coalesce("bookmarks", F.array().cast("array<string>")).alias("bookmarks")))
    return n.join(b, "user_id", "full").select("user_id", store.alias("store"))


def restore(stores: DataFrame, json: str = "store") -> DataFrame:
    """Stores read back; what can't be read is an empty store."""
    parsed = F.from_json(json, STORE)
    empty = F.struct(F.create_map().cast("map<string,string>").alias("notes"), F.array().cast("array<string>").alias("bookmarks"))
    kept = F.struct(F.coalesce(parsed["notes"], empty["notes"]).alias("notes"), F.coalesce(parsed["bookmarks"], empty["bookmarks"]).alias("bookmarks"))
    return stores.withColumn(json, kept)
