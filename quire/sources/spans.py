"""Printed pages as spans of text with position and font: reading order and verses, without a decoder of any file format.

A span is ``(doc, p, t, s, f, x, y)``: page, text, size, flags, place. Decoding stays outside; what a decoder gives is one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import let
from quire.operators.corpus import pieces, scan, word_parts
from quire.operators.ranges import carried, in_parts
from quire.plans.store import small

SUPERSCRIPT, BOLD = 1, 16


def reading_order(spans: DataFrame, bounds: DataFrame, middle: float) -> DataFrame:
    """``spans`` with ``place``: page, zone, column, line and position from left, as one struct that sorts in reading order.

    ``bounds`` (``doc``, ``p``, ``ys``: heights of full-width heads, ascending) cuts a page into zones; within a zone the left
    column comes first. All from the row and a small table: nothing is sorted until someone asks.
    """
    rows = spans.join(bounds, ["doc", "p"], "left")
    zone = F.size(F.filter(F.coalesce("ys", F.array().cast("array<double>")), lambda b: b <= F.col("y")))
    return rows.withColumn("place", F.struct("p", zone.alias("zone"), (F.col("x") >= middle).cast("int").alias("column"), F.round("y", 0).alias("line"), "x")).drop("ys")


def without_notes(spans: DataFrame, smallest: float) -> DataFrame:
    """Spans that are no footnotes: larger than ``smallest`` and not superscript."""
    return spans.where((F.col("s") >= smallest) & (F.col("f").bitwiseAND(SUPERSCRIPT) == 0))


def plausible(numbers: Column, most: int = 200, jump: int = 10) -> Column:
    """The verse number in force at each element of an array of numbers (null for text).

    A number is a verse's if it is at most ``most``, and from the last one to ``jump`` above it.
    """
    fits = lambda now, n: F.coalesce((n <= most) & n.between(now, now + jump), F.lit(False))
    return scan(numbers, F.lit(0), "int", lambda now, n: F.when(fits(now, n), n).otherwise(now))


def verses_in(spans: DataFrame, keys: list[str], most: int = 200, jump: int = 10) -> DataFrame:
    """``keys``, ``verse`` and ``text``: the spans of a group (a page, a chapter) in reading order, cut at bold numbers that are plausible."""
    rows = spans.withColumn("n", F.when(F.col("f").bitwiseAND(BOLD) > 0, F.trim("t").try_cast("int")))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.trim("t").alias("t"), "n"))).alias("l"))

    def cut(x: Column) -> Column:
        """Pieces that begin with a number which changes or repeats the one in force, as its number and the text after it."""
        begins = F.transform(x["l"], lambda e, i: F.coalesce(e["n"] == F.get(x["v"], i), F.lit(False)))
        pairs = F.zip_with(F.zip_with(x["l"], x["v"], lambda e, v: F.struct(v.alias("v"), e["t"].alias("t"))), begins, lambda e, s: F.struct(e["v"].alias("v"), F.when(~s, e["t"]).alias("t")))
        return pieces(pairs, begins, lambda part: F.struct(F.get(part, F.lit(0))["v"].alias("v"), F.array_join(F.transform(part, lambda e: e["t"]), " ").alias("t")))

    found = lists.withColumn("v", plausible(F.transform("l", lambda x: x["n"]), most, jump))
    parts = found.select(*keys, F.posexplode(let(F.struct("l", "v"), cut)).alias("i", "x"))
    joined = parts.where("x.t <> ''").groupBy(*keys, F.col("x.v").alias("verse")).agg(F.array_sort(F.collect_list(F.struct("i", "x.t"))).alias("l"))
    return joined.select(*keys, "verse", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def page_verses(spans: DataFrame, most: int = 200, jump: int = 10) -> DataFrame:
    """``doc``, ``p``, ``verse``, ``text`` of each page."""
    return verses_in(spans, ["doc", "p"], most, jump)


def span_chapters(spans: DataFrame, titles: DataFrame, title_size: float, by_volume: bool = False, head: str = r"^(?:CHAPTER|SECTION|PSALM)\s+(\d+)$") -> DataFrame:
    """Chapters of printed volumes: ``work_id``, ``book_id``, ``chapter_id``, ``chapter_num``, ``name`` and ``sections``.

    ``spans`` are in reading order by ``place``; ``titles`` (``title``, ``work_id``, ``book_id``) is the small table of book titles,
    matched without case in spans of ``title_size`` or larger. A book goes on to the next title, a chapter to the next
    head or title. What stands before the first title or head belongs to none. Several works may come from one volume, and
    volumes of one book are put together, unless they are kept apart ``by_volume`` (with a column ``doc``).
    """
    known = small(titles.select(F.upper(F.trim("title")).alias("__q_title"), "work_id", "book_id"))
    rows = spans.withColumn("__q_title", F.when(F.col("s") >= title_size, F.upper(F.trim("t")))).join(known, "__q_title", "left").drop("__q_title")
    # Dealt once by volume, in parts of some megabytes; all that follows groups by volume too.
    rows = rows.withColumn("number", F.regexp_extract(F.trim("t"), head, 1).try_cast("int")).repartition(word_parts(spans), "doc")
    volume = Window.partitionBy("doc").orderBy("place")
    rows = rows.withColumn("nth", F.count("book_id").over(volume))
    book = Window.partitionBy("doc", "nth").orderBy("place")
    rows = rows.select("doc", "nth", "place", "t", "f", "number", F.first("work_id").over(book).alias("work_id"), F.first("book_id").over(book).alias("book_id"), F.last("number", ignorenulls=True).over(book).alias("chapter_num"), F.col("book_id").alias("title"))
    body = rows.where("nth > 0 AND chapter_num IS NOT NULL AND number IS NULL AND title IS NULL")
    found = verses_in(body, ["doc", "work_id", "book_id", "chapter_num"])
    keys = [*(["doc"] if by_volume else []), "work_id", "book_id", "chapter_num"]
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("verse", "doc", "text"))).alias("v"))
    section = F.struct(F.greatest(F.get("v", F.lit(0))["verse"], F.lit(1)).alias("startVerse"), F.transform("v", lambda x: x["text"]).alias("verses"))
    return lists.select(*keys[:-3], "work_id", "book_id", F.concat_ws("-", "book_id", "chapter_num").alias("chapter_id"), "chapter_num", F.lit(None).cast("string").alias("name"), F.array(section).alias("sections"))


def volume_manifest(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """The books of the works of printed volumes in the order of ``titles`` (``ord``), as ``quire.plans.build.manifests`` takes them."""
    counts = chapters.groupBy("work_id", "book_id").agg(F.count("*").alias("chapters"), F.min("chapter_num").cast("long").alias("start"))
    books = titles.select("work_id", "book_id", F.col("ord").alias("book_ord"), F.col("title").alias("name"))
    return counts.join(small(books), ["work_id", "book_id"]).select("work_id", "book_ord", "book_id", "name", F.lit(None).cast("string").alias("abbrev"), "chapters", "start", F.lit(None).cast("array<string>").alias("names"))


def filled_pages(titles: DataFrame, headers: DataFrame) -> DataFrame:
    """The book of each page: the title pass, else the header pass, else the book of the page before."""
    both = titles.withColumnRenamed("book", "a").join(headers.withColumnRenamed("book", "b"), ["doc", "p"], "full").withColumn("book", F.coalesce("a", "b"))
    return carried(in_parts(both, "p"), ["doc"], ["p"], last={"book": F.col("book")}).select("doc", "p", "book")
