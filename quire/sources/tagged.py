"""The tagged text format: a corpus as lines, and back.

``WORK: id | title``, ``TRANSLATION: id | name | year``, ``BOOK: id | name``, ``START: n``, ``CHAPTER: name``, ``> intro``,
``@ n`` (number of the next verse), ``SECTION:`` with ``@ n``, and verses, one a line. Translations are written too, so that
a round trip keeps them. Lines of verses that look like tags can't be told from them, and blank verses vanish.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LICENCE = "This structured text is licensed under CC BY-SA 4.0"
ROWS = (
    "work_id string, title string, book_ord int, book_id string, book_name string, start int, chapter_ord int, chapter_id string, "
    "name string, intro string, sections array<struct<startVerse:int,verses:array<string>>>"
)


def chapter_lines(name: Column, intro: Column, sections: Column) -> Column:
    """The lines of a chapter: its head, intro, and sections; a number is written where counting does not give it."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("lines"))

    def tag(a: Column, s: Column, first: Column) -> Column:
        n = s["startVerse"]
        head = F.when(first & (n != 1), F.concat(F.lit("@ "), n)).when(first, F.lit(None).cast("string"))
        later = F.when(n == 1, F.lit("SECTION: @")).when(n != a["next"], F.concat(F.lit("SECTION: @ "), n)).otherwise(F.lit("SECTION:"))
        return F.when(first, head).otherwise(later)

    numbered = F.transform(sections, lambda s, i: F.struct(s["startVerse"].alias("startVerse"), s["verses"].alias("verses"), i.alias("i")))
    step = lambda a, s: F.struct((s["startVerse"] + F.size(s["verses"])).alias("next"), F.concat(a["lines"], F.array_compact(F.array(tag(a, s, s["i"] == 0))), s["verses"]).alias("lines"))
    body = F.aggregate(numbered, start, step, lambda a: a["lines"])
    head = F.concat(F.lit("CHAPTER:"), F.when(name.isNotNull() & (name != ""), F.concat(F.lit(" "), name)).otherwise(F.lit("")))
    return F.concat(F.array(head), F.array_compact(F.array(F.when(intro.isNotNull() & (intro != ""), F.concat(F.lit("> "), intro)))), body)


def render(rows: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """``work_id``, ``book_ord``, ``chapter_ord``, ``line_no``, ``line``: every line with its place.

    ``rows`` has the columns ``ROWS``. Lines sort by (work_id, book_ord, chapter_ord, line_no); heads of works and books
    come before their chapters as chapter -1 and book -1. A work of any size is many rows.
    """
    chapters = rows.select("work_id", "book_ord", "chapter_ord", F.posexplode(chapter_lines(F.col("name"), F.col("intro"), F.col("sections"))).alias("line_no", "line"))
    begin = F.when(F.coalesce("start", F.lit(1)) != 1, F.concat(F.lit("START: "), "start"))
    book = F.array_compact(F.array(F.concat(F.lit("BOOK: "), "book_id", F.lit(" | "), "book_name"), begin))
    books = rows.select("work_id", "book_ord", "book_id", "book_name", "start").distinct().select("work_id", "book_ord", F.lit(-1).alias("chapter_ord"), F.posexplode(book).alias("line_no", "line"))
    works = rows.select("work_id", "title").distinct()
    if translations is not None:
        listed = translations.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("TRANSLATION: "), "id", F.lit(" | "), "name", F.lit(" | "), "year").alias("l")))).alias("t"))
        works = works.join(listed, "work_id", "left").withColumn("t", F.coalesce(F.transform("t", lambda x: x["l"]), F.array().cast("array<string>")))
    else:
        works = works.withColumn("t", F.array().cast("array<string>"))
    head = F.concat(F.array(F.lit(LICENCE), F.lit(""), F.concat(F.lit("WORK: "), "work_id", F.lit(" | "), "title")), F.col("t"))
    works = works.select("work_id", F.lit(-1).alias("book_ord"), F.lit(-1).alias("chapter_ord"), F.posexplode(head).alias("line_no", "line"))
    return works.unionByName(books).unionByName(chapters)


def write(lines: DataFrame, folder: str) -> None:
    """One folder of text files for each work; lines in order within and across its files."""
    order = ["work_id", "book_ord", "chapter_ord", "line_no"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("work_id", F.col("line").alias("value")).write.partitionBy("work_id").text(folder)


PAIR = re.compile(r"\s*(.+?)\s*\|\s*(.+?)\s*$")


def parse_text(text: str) -> list[dict]:
    """The chapters of one work's text, in order, with their book and work. A directive whose number is none is a verse or has no effect."""
    work: dict = {"work_id": None, "title": None}
    book: dict | None = None
    chapter: dict | None = None
    books = 0
    out: list[dict] = []

    def number(rest: str) -> int | None:
        """A verse number; 1 if none is given, None if it is not a number."""
        return int(rest) if rest.isascii() and rest.isdigit() else None if rest else 1

    for line in text.split("\n"):
        tag, _, rest = line.partition(":")
        if not line:
            continue
        if tag == "WORK" and (m := PAIR.match(rest)):
            work = {"work_id": m[1], "title": m[2]}
        elif tag == "TRANSLATION":
            continue
        elif tag == "BOOK" and (m := PAIR.match(rest)):
            book, chapter = {"book_ord": books, "book_id": m[1], "book_name": m[2], "start": 1, "count": 0}, None
            books += 1
        elif tag == "START" and book is not None:
            n = number(rest.strip())
            book["start"] = book["start"] if n is None else n
        elif tag == "CHAPTER":
            place = book or {"book_ord": 0, "book_id": "ch", "book_name": "ch", "start": 1, "count": len(out)}
            chapter = {"chapter_ord": place["count"], "chapter_id": f"{place['book_id']}-{place['start'] + place['count']}", "name": rest.strip() or None, "intro": None, "sections": [], "next": 1}
            place["count"] += 1
            out.append(work | {k: place[k] for k in ("book_ord", "book_id", "book_name", "start")} | chapter)
            chapter = out[-1]
        elif chapter is None:
            continue
        elif line.startswith("> "):
            chapter["intro"] = line[2:]
        elif line.startswith("@") and not line.startswith("@@") and (n := number(line[1:].strip())) is not None:
            chapter["next"] = n
        elif tag == "SECTION":
            if rest.strip().startswith("@") and (n := number(rest.strip()[1:].strip())) is not None:
                chapter["next"] = n
            chapter["sections"].append({"startVerse": chapter["next"], "verses": []})
        else:
            if not chapter["sections"]:
                chapter["sections"].append({"startVerse": chapter["next"], "verses": []})
            section = chapter["sections"][-1]
            section["verses"].append(line)
            chapter["next"] = section["startVerse"] + len(section["verses"])
    return out


def read(files: DataFrame) -> DataFrame:
    """Chapters (``ROWS``) of whole texts in a column ``value``, one work a row; files are parsed in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            yield pd.DataFrame([[c[n] for n in names] for text in batch["value"] for c in parse_text(text or "")], columns=names)

    return files.select("value").mapInPandas(run, ROWS)
