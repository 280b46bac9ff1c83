"""Printed volumes as spans of text with place and font: heads found on the pages, and verses by a state machine run in parallel.

A span is ``(doc, p, t, s, f, x, y)``: page, text, size, flags, left and upper edge; ``x1``, its right edge, may follow. Decoding stays
outside. Whether a span is verse text depends on all that stands before it in its volume: on the chapter's summary, its
initial, the verse in force. But what a stretch of pages does to that state is a function on a small set of states, and such functions are
composed in any grouping. So stretches are read in parallel twice: once to learn their functions, and, when those have been
composed into the state in which each stretch begins, once to read the verses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import corpus as C
from quire.operators.ranges import PART, carried
from quire.plans.store import materialize, small


@dataclass(frozen=True)
class Print:
    """How a volume is set. Sizes are points, flags a font's bits; the defaults are fixed values of one edition, any can be given."""

    header_y: float = 35.0
    header_size: float = 10.5
    note_size: float = 9.0
    verse: tuple[float, float] = (10.0, 10.7)
    italic: int = 6
    bold: int = 20
    title: tuple[float, float] = (20.0, 30.0)
    initial: float = 30.0
    middle: float = 216.0
    head_size: tuple[float, float] = (10.0, 11.0)
    head: str = r"^(?:CHAPTER|Chapter|PSALM)\s+(\d+)$"
    declaration: str = r"^Official Declaration\s+(\d+)$"
    most: int = 200
    jump: int = 10
    #: Pages of a stretch, and functions that are composed in one row.
    stretch: int = 16
    width: int = 256


OTHER, TEXT, INITIAL, TITLE, HEAD, DECLARATION = range(6)
#: States: outside a chapter, in its summary, in prose without verses; then three for each verse in force: plain, after an
#: initial, and directly after it.
OUTSIDE, SUMMARY, PROSE, BODY = 0, 1, 2, 3


def classified(spans: DataFrame, titles: DataFrame, style: Print = Print()) -> DataFrame:
    """Spans that may count, with ``k`` (their kind), ``soft`` (left out of a summary), ``n`` and ``rest`` (a verse number and what follows), ``num`` (a head's number) and ``own`` (a title's book).

    Running heads, notes and their marks go, blank spans too. ``titles``: ``title``, ``words`` (of which the text above the title must
    hold all, for books that share one; null or empty for none), ``work_id``, ``book_id`` and ``single`` (a book without chapter heads).
    """
    t, s = T.strip(F.col("t")), F.round("s", 1)
    rows = spans.where(F.col("t").rlike(r"\S")).withColumns({"t": t, "s": s})
    rows = rows.where(~((F.col("y") < style.header_y) & (F.col("s") <= style.header_size)) & (F.col("s") > style.note_size))
    large = F.col("s").between(*style.title) & (F.col("s") < style.title[1])
    book = F.struct("work_id", "book_id", F.coalesce("single", F.lit(False)).alias("single"))
    plainest = F.struct(F.size(F.coalesce("words", F.array().cast("array<string>"))).alias("n"), "work_id", "book_id")
    known = titles.groupBy(F.upper(F.trim("title")).alias("__q_title")).agg(F.min_by(book, plainest).alias("own"))
    rows = rows.withColumn("__q_title", F.when(large & ~F.col("t").rlike(style.head), F.upper("t"))).join(small(known), "__q_title", "left").drop("__q_title")
    number = lambda pattern: F.regexp_extract("t", pattern, 1).try_cast("int")
    head = F.col("t").rlike(style.head) & F.col("s").between(*style.head_size)
    declared = F.col("t").rlike(style.declaration) & F.col("s").between(*style.head_size)
    kind = F.when(F.col("own").isNotNull(), TITLE).when(large, OTHER).when(head, HEAD).when(declared, DECLARATION)
    kind = kind.when(F.col("s") >= style.initial, INITIAL).when(F.col("s").between(*style.verse), TEXT).otherwise(OTHER)
    verse = r"(?s)^(\d+)(?:\s+(.*))?$"
    return rows.withColumns({
        "k": kind, "soft": F.col("f").isin(style.italic, style.bold) | F.startswith("t", F.lit("(")), "n": number(verse), "rest": F.regexp_extract("t", verse, 2),
        "num": F.when(head, number(style.head)).when(declared, number(style.declaration)),
    })


def head_heights(rows: DataFrame, style: Print = Print()) -> DataFrame:
    """``doc``, ``p``, ``ys``: the heights on each page at which both columns begin anew.

    There stands a title, or a head that lies over both columns: it begins left of the middle and ends right of it (``x1``).
    """
    over = (F.col("x") < style.middle) & (F.col("x1") > style.middle) if "x1" in rows.columns else F.lit(False)
    heads = rows.where((F.col("k") == TITLE) | (F.col("k").isin(HEAD, DECLARATION) & over))
    return heads.groupBy("doc", "p").agg(F.sort_array(F.collect_set(F.col("y").cast("double"))).alias("ys"))


def placed(rows: DataFrame, style: Print = Print()) -> DataFrame:
    """``rows`` with ``place``, which sorts as the pages are read: zones between heads, left column first, lines, from left to right."""
    marked = rows.join(head_heights(rows, style), ["doc", "p"], "left")
    zone = F.size(F.filter(F.coalesce("ys", F.array().cast("array<double>")), lambda b: b <= F.col("y")))
    return marked.withColumn("place", F.struct("p", zone.alias("zone"), (F.col("x") >= style.middle).cast("int").alias("column"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "t")).drop("ys")


def page_books(spans: DataFrame, titles: DataFrame, headers: DataFrame, style: Print = Print()) -> DataFrame:
    """``doc``, ``p``, ``first`` and ``last``: the books (``work_id``, ``book_id``) with which each page begins and ends.

    A title decides, with the text above it where several books share the title; else the running head ``NAME c:v``, whose first
    and last books are looked up in ``headers`` (``header``, ``work_id``, ``book_id``); else the page ends as the one before. On a
    page with both, the head gives the book it begins with.
    """
    rows = spans.withColumns({"t": T.strip(F.col("t")), "s": F.round("s", 1)}).where("t <> ''")
    at = F.struct("y", "x", "t")
    large = rows.where(F.col("s").between(*style.title) & (F.col("s") < style.title[1]))
    name = large.groupBy("doc", "p").agg(F.max_by(F.upper("t"), at).alias("name"), F.max("y").alias("top"))
    above = rows.join(name, ["doc", "p"]).where((F.col("y") < F.col("top")) & ((F.col("s") >= 11) | ((F.col("s") >= 10) & (F.col("f") == style.bold))))
    preamble = above.groupBy("doc", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda a: a["t"]), " ").alias("preamble"))
    asked = name.join(preamble, ["doc", "p"], "left").select("doc", "p", F.upper(F.coalesce("preamble", F.lit(""))).alias("preamble"), F.posexplode(F.array("name", F.concat(F.lit("ST "), "name"))).alias("nth", "name"))
    known = titles.select(F.upper(F.trim("title")).alias("name"), F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.struct("work_id", "book_id").alias("book"))
    fits = asked.join(small(known), "name").where(F.forall("words", lambda w: F.contains("preamble", w)))
    by_title = fits.groupBy("doc", "p").agg(F.min_by("book", F.struct("nth", -F.size("words"), F.array_join("words", " "), "book")).alias("title"))

    top = rows.where((F.col("y") <= style.header_y) & (F.col("s") >= 10) & ~F.col("t").rlike(r"^\d+$")).groupBy("doc", "p").agg(F.max_by("t", at).alias("header"))
    names = F.regexp_extract_all("header", F.lit(r"((?:\d\s+)?(?:[A-Z][A-Z]+(?:\s+[A-Z]+)*))\s+\d+:\d+"), F.lit(1))
    found = top.select("doc", "p", F.posexplode(names).alias("i", "name")).select("doc", "p", "i", F.posexplode(F.array("name", F.replace("name", F.lit("ST "), F.lit("ST. ")))).alias("nth", "name"))
    listed = headers.select(F.trim("header").alias("name"), F.struct("work_id", "book_id").alias("book"))
    books = found.join(small(listed), "name").groupBy("doc", "p", "i").agg(F.min_by("book", "nth").alias("book"))
    by_header = books.groupBy("doc", "p").agg(F.min_by("book", "i").alias("begins"), F.max_by("book", "i").alias("ends"))

    pages = rows.select("doc", "p").distinct().join(by_title, ["doc", "p"], "left").join(by_header, ["doc", "p"], "left").withColumn(PART, F.floor(F.col("p") / 256))
    filled = carried(pages, ["doc"], ["p"], last={"last": F.coalesce("title", "ends")})
    return filled.select("doc", "p", F.coalesce("begins", "title", "last").alias("first"), "last").where("last IS NOT NULL")


def _code(verse: int | np.ndarray, mode: int) -> int | np.ndarray:
    return BODY + 3 * (verse - 1) + mode


def stepped(states: np.ndarray, k: int, soft: bool, n: int | None, style: Print) -> np.ndarray:
    """The states after one span, for an array of states before it."""
    if k in (HEAD, DECLARATION):
        return np.full(1, SUMMARY if k == HEAD else PROSE)
    if k == TITLE:
        return np.full(1, OUTSIDE)
    if k == OTHER:
        return states
    verse, mode = (states - BODY) // 3 + 1, (states - BODY) % 3
    body, begins = states >= BODY, (states == SUMMARY) & (not soft)
    if k == INITIAL:
        return np.where(begins, _code(1, 2), np.where(body & (mode == 0), states + 2, states))
    verse, mode = np.where(body, verse, 1), np.where(body, mode, 0)
    number = (n is not None) & (mode < 2) & (verse <= (n or 0)) & ((n or 0) <= np.minimum(verse + style.jump, style.most))
    after = np.where(number, _code(n or 1, 0), _code(verse, np.where(mode == 2, 1, mode)))
    return np.where(body | begins, after, states)


def step(state: int, k: int, soft: bool, n: int | None, style: Print) -> int:
    """``stepped`` for one state."""
    if k == OTHER:
        return state
    if k in (HEAD, DECLARATION, TITLE):
        return {HEAD: SUMMARY, DECLARATION: PROSE, TITLE: OUTSIDE}[k]
    if state == SUMMARY and not soft:
        if k == INITIAL:
            return BODY + 2
        state = BODY
    if state < BODY:
        return state
    verse, mode = (state - BODY) // 3 + 1, (state - BODY) % 3
    if k == INITIAL:
        return state if mode else state + 2
    if n is not None and mode < 2 and verse <= n <= min(verse + style.jump, style.most):
        return BODY + 3 * (n - 1)
    return state - 1 if mode == 2 else state


def function_of(kinds: list[int], softs: list[bool], numbers: list[int | None], style: Print) -> tuple[int, list[int]]:
    """How many chapters begin in a stretch, and the state at its end for each at its begin (one state, if it is always the same)."""
    starts = [i for i, k in enumerate(kinds) if k in (HEAD, DECLARATION, TITLE)]
    if starts:
        state = OUTSIDE
        for i in range(starts[-1], len(kinds)):
            state = step(state, kinds[i], softs[i], numbers[i], style)
        return sum(kinds[i] != TITLE for i in starts), [state]
    states = np.arange(_code(style.most, 2) + 1)
    for k, soft, n in zip(kinds, softs, numbers, strict=True):
        states = stepped(states, k, soft, n, style)
    return 0, states.tolist()


def read_stretch(state: int, chapter: int, kinds: list[int], softs: list[bool], numbers: list[int | None], style: Print) -> Iterator[tuple]:
    """Pieces of a stretch that begins in ``state``, in chapter number ``chapter`` of the volume: chapter, verse, whether the verse begins (and its text
    is the span's ``rest``), kind of piece, place of the span."""
    for i, (k, soft, n) in enumerate(zip(kinds, softs, numbers, strict=True)):
        after = step(state, k, soft, n, style)
        if k in (HEAD, DECLARATION):
            chapter += 1
        elif state == PROSE and k != TITLE:
            yield chapter, 1, False, "t", i
        elif after >= BODY and k in (TEXT, INITIAL):
            verse, mode = (after - BODY) // 3 + 1, (after - BODY) % 3
            if k == INITIAL:
                yield chapter, verse, False, "v" if state == after else "i", i
            elif mode == 0 and n == verse and (state < BODY or (state - BODY) % 3 < 2):
                yield chapter, verse, True, "t", i
            else:
                yield chapter, verse, False, "t", i
        state = after


def entry_states(functions: DataFrame, width: int) -> DataFrame:
    """``doc``, ``stretch``, ``state`` and ``chapter`` in which each stretch begins: a prefix scan, ``width`` functions in a row.

    ``functions``: ``doc``, ``stretch``, ``chapters`` (how many begin in it) and ``after`` (the states at its end). A volume of more
    stretches is composed level by level, so no row holds more than ``width`` functions.
    """
    group = F.floor(F.col("stretch") / width)
    lists = functions.groupBy("doc", group.alias("group")).agg(F.array_sort(F.collect_list(F.struct("stretch", "chapters", "after"))).alias("l"))
    then = lambda f, g: F.when((F.size(g) == 1) | (F.size(f) == 0), g).otherwise(F.transform(f, lambda s: F.get(g, s)))
    if (functions.agg(F.max("stretch")).first()[0] or 0) >= width:
        lists = materialize(lists, "functions")
        whole = F.aggregate("l", F.array().cast("array<int>"), lambda a, x: then(a, x["after"]))
        upper = lists.select("doc", F.col("group").alias("stretch"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["chapters"]).alias("chapters"), whole.alias("after"))
        above = entry_states(upper, width).withColumnRenamed("stretch", "group")
        lists = lists.join(above, ["doc", "group"])
    else:
        lists = lists.withColumns({"state": F.lit(OUTSIDE), "chapter": F.lit(0).cast("long")})
    begin = F.struct(F.col("state").cast("int").alias("state"), F.col("chapter").cast("long").alias("chapter"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.get(x["after"], F.when(F.size(x["after"]) == 1, 0).otherwise(s["state"])).cast("int").alias("state"), (s["chapter"] + x["chapters"]).alias("chapter"))

    after = C.scan(F.col("l"), begin, "struct<state:int,chapter:bigint>", step)
    before = T.let(F.struct(after.alias("s"), begin.alias("b")), lambda z: F.transform(z["s"], lambda _, i: F.when(i == 0, z["b"]).otherwise(F.get(z["s"], i - 1))))
    return lists.select("doc", F.explode(F.arrays_zip(F.transform("l", lambda x: x["stretch"]).alias("stretch"), before.alias("b"))).alias("z")).select("doc", "z.stretch", "z.b.state", "z.b.chapter")


def chapter_heads(rows: DataFrame, pages: DataFrame | None, style: Print) -> DataFrame:
    """The spans at which chapters begin or a book does, with ``book``; a title of the book that is being read anyway is none.

    A title's book is the one with which its page ends (``pages``), else its own; the first chapter of a page that ends in another
    book begins that book.
    """
    heads = rows.where(F.col("k").isin(TITLE, HEAD, DECLARATION)).withColumn(PART, F.floor(F.col("p") / (16 * style.stretch)))
    if pages is None:
        heads = heads.withColumns({"first": F.lit(None).cast("struct<work_id:string,book_id:string>"), "last": F.lit(None).cast("struct<work_id:string,book_id:string>")})
    else:
        heads = heads.join(pages, ["doc", "p"], "left")
    own = F.when(F.col("k") == TITLE, F.coalesce("last", "first", F.struct("own.work_id", "own.book_id"))).when((F.col("k") == HEAD) & (F.col("num") == 1), F.col("last"))
    heads = heads.withColumn("sets", own)
    heads = carried(heads, ["doc"], ["place"], last={"before": F.col("sets")}, inclusive=False)
    heads = heads.where(~F.coalesce((F.col("k") == TITLE) & (F.col("sets") == F.col("before")), F.lit(False)))
    return heads.withColumn("book", F.coalesce("sets", "before", "last", "first")).drop("sets", "before", "first", "last", PART)


def chapters(spans: DataFrame, titles: DataFrame, pages: DataFrame | None = None, style: Print = Print()) -> DataFrame:
    """``doc``, ``chapter`` (its number in the volume), ``work_id``, ``book_id``, ``chapter_num`` and ``verses`` of printed volumes.

    Notes, running heads, summaries (in italics or bold or brackets, until verse text comes), ornaments and text outside chapters are left
    out. A summary ends at verse text or at an initial, which joins the word that follows it. A number at the head of a span begins a verse if
    it is at most ``style.most`` and from the verse in force to ``style.jump`` above it; directly after an initial it does not. A declaration
    is prose: one verse. A title of a book with a single chapter begins it. Verses without text are left out; a chapter without verses
    stays, with none. ``pages`` (from ``page_books``) names the books where titles do not.
    """
    rows = placed(materialize(classified(spans, titles, style), "spans"), style)
    heads = chapter_heads(rows, pages, style)
    # A book of one chapter begins it by its title.
    heads = heads.withColumns({"num": F.when((F.col("k") == TITLE) & F.col("own.single"), 1).otherwise(F.col("num")), "k": F.when((F.col("k") == TITLE) & F.col("own.single"), HEAD).otherwise(F.col("k"))})
    heads = materialize(heads.select("doc", "p", "place", "k", "num", "book"), "heads")
    none = {"soft": F.lit(False), "n": F.lit(None).cast("int"), "rest": F.lit(""), "t": F.lit("")}
    both = rows.where(~F.col("k").isin(TITLE, HEAD, DECLARATION)).select("doc", "p", "place", "k", "soft", "n", "rest", "t").unionByName(heads.withColumns(none).drop("num", "book"))
    element = F.struct("place", "k", "soft", "n", "rest", "t")
    stretches = both.groupBy("doc", F.floor(F.col("p") / style.stretch).alias("stretch")).agg(F.transform(F.array_sort(F.collect_list(element)), lambda e: e.dropFields("place")).alias("l"))
    stretches = materialize(stretches, "stretches")
    doc = dict(spans.dtypes)["doc"]

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function_of(k, s, n, style) for k, s, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pa.int32()))], names=["doc", "stretch", "chapters", "after"])

    some = stretches.select("doc", "stretch", F.col("l.k").alias("k"), F.col("l.soft").alias("soft"), F.col("l.n").alias("n"))
    known = materialize(some.mapInArrow(functions, f"doc {doc}, stretch long, chapters long, after array<int>"), "functions")
    begun = entry_states(known, style.width)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32()]
        for batch in batches:
            ends = batch.column(2).offsets.to_pylist()
            spans = batch.column(2).flatten()
            k, soft, n, rest, t = (spans.field(c) for c in ("k", "soft", "n", "rest", "t"))
            kinds, softs, numbers = k.to_pylist(), soft.to_pylist(), n.to_pylist()
            found = []
            for row, (state, chapter) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                low = ends[row] - ends[0]
                part = slice(low, ends[row + 1] - ends[0])
                found += [(row, low + x[4], *x) for x in read_stretch(state, chapter, kinds[part], softs[part], numbers[part], style)]
            if found:
                row, at, chapter, verse, begins, kind, i = (pa.array(c, x) for c, x in zip(zip(*found, strict=True), types, strict=True))
                text = pc.if_else(begins, rest.take(at), t.take(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), chapter, verse, begins, kind, text, i], names=["doc", "stretch", "chapter", "verse", "begins", "kind", "t", "i"])

    entered = stretches.join(begun, ["doc", "stretch"]).select("doc", "stretch", "l", "state", "chapter")
    pieces = entered.mapInArrow(read, f"doc {doc}, stretch long, chapter long, verse int, begins boolean, kind string, t string, i int")
    parts = pieces.groupBy("doc", "chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("stretch", "i", "begins", "kind", "t"))).alias("l"))
    texts = parts.select("doc", "chapter", "verse", F.posexplode(T.let(with_initials(F.col("l")), lambda l: C.pieces(l, F.transform(l, lambda e: e["begins"]), lambda part: F.array_join(F.transform(part, lambda e: e["t"]), " ")))).alias("nth", "t"))
    texts = texts.withColumn("t", T.printed(F.col("t")))
    lists = texts.groupBy("doc", "chapter").agg(F.array_sort(F.collect_list(F.struct("verse", "nth", "t"))).alias("l")).select(F.col("doc").alias("__q_doc"), F.col("chapter").alias("__q_chapter"), F.filter(F.transform("l", lambda e: e["t"]), lambda t: t != "").alias("verses"))
    begins = heads.where(F.col("k") != TITLE).withColumn(PART, F.floor(F.col("p") / (16 * style.stretch)))
    numbered = carried(begins, ["doc"], ["place"], total={"chapter": F.lit(1).cast("long")})
    out = numbered.join(lists, F.col("doc").eqNullSafe(F.col("__q_doc")) & (F.col("chapter") == F.col("__q_chapter")), "left")
    return out.select("doc", "chapter", "book.work_id", "book.book_id", F.col("num").alias("chapter_num"), F.coalesce("verses", F.array().cast("array<string>")).alias("verses"))


def with_initials(elements: Column) -> Column:
    """Pieces of a verse without its initials: one joins the next text, whose capitals go on its word in small letters.

    A large letter while the first verse is open (kind ``v``) is text by itself.
    """

    def joined(initial: Column, t: Column) -> Column:
        capitals = F.regexp_extract(t, "^[A-Z]*", 0)
        word = F.concat(initial, capitals)
        return F.concat(F.substring(word, 1, 1), F.when(capitals != "", F.lower(F.substring(word, 2, 1 << 30))).otherwise(F.substring(word, 2, 1 << 30)), F.substring(t, F.length(capitals) + 1, F.length(t)))

    def whole(l: Column) -> Column:
        held = C.scan(l, F.lit(None), "string", lambda s, e: F.when(e["kind"] == "i", e["t"]).when(e["kind"] == "v", s))
        return T.let(F.struct(l.alias("l"), held.alias("h")), lambda z: F.filter(F.transform(z["l"], lambda e, i: e.withField("t", T.let(F.get(z["h"], i - 1), lambda h: F.when(h.isNotNull() & (i > 0) & (e["kind"] == "t"), joined(h, e["t"])).otherwise(e["t"])))), lambda e: e["kind"] != "i"))

    return T.let(elements, whole)
