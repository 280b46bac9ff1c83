"""Readers of printed layouts: one description for each, one engine for all.

A layout says which lines are noise, what begins a chapter, how a chapter's body falls into verses and how verses are
cleaned. A source file is one row; files are parsed in parallel, and each gives chapter rows (``CHAPTERS``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import ROMAN, SMALL_WORDS, caps_first_words, lay_verse, let
from quire.operators.corpus import pieces
from quire.operators.ranges import PART, carried
from quire.plans.store import small

CHAPTERS = "work_id string, book_id string, chapter_id string, chapter_num int, name string, sections array<struct<startVerse:int,verses:array<string>>>"
Verses = list[str]
Sections = list[tuple[int, Verses]]

# ---------------------------------------------------------------- cleaning of one verse


def tidy(text: str) -> str:
    """Brackets away, dashes, punctuation close to its word, single spaces."""
    for pattern, new in ((r"[\[\]]", ""), (r"-{2,}", "—"), (r" ([,;:.!?])", r"\1"), (r"  +", " ")):
        text = re.sub(pattern, new, text)
    return text.strip()


def one_line(text: str) -> str:
    return " ".join(text.split())


def without_parentheses(text: str) -> str:
    return re.sub(r"  +", " ", re.sub(r"\s*\([^)]*\)", "", text)).strip()


def heading_case(text: str) -> str:
    """``quire.functions.text.title_case`` of one title."""
    words = text.lower().split()
    inner = range(1, len(words) - 1)
    return " ".join(w if i in inner and w in SMALL_WORDS else w[:1].upper() + w[1:] for i, w in enumerate(words))


def roman(text: str) -> int:
    """``quire.functions.text.roman_to_int`` of one numeral."""
    values = [ROMAN.get(c, 0) for c in text.upper()]
    return sum(-v if v < after else v for v, after in zip(values, [*values, 0][1:], strict=True))


# ---------------------------------------------------------------- bodies into verses


def grouped(lines: list[str], begins: Callable[[str], str | None]) -> Verses:
    """Lines joined into verses; ``begins`` gives what is left of a line that starts one, None for all other lines."""
    verses: list[list[str]] = [[]]
    for line in lines:
        rest = begins(line)
        if rest is not None:
            verses.append([])
        text = (line if rest is None else rest).strip()
        if text:
            verses[-1].append(text)
    return [" ".join(v) for v in verses if v]


NUMBER = re.compile(r"(\d+)\.\s*(.*)")


def numbered(body: str) -> Verses:
    def begins(line: str) -> str | None:
        m = NUMBER.match(line.strip())
        return m[2] if m else None

    return grouped(body.split("\n"), begins)


def indented(body: str) -> Verses:
    """A verse begins at three spaces; other lines go on with it."""
    return grouped([x.rstrip() for x in body.split("\n")], lambda x: x if re.match(r"   \S", x) else None)


def paragraphs(body: str) -> Verses:
    return [" ".join(x.strip() for x in p.split("\n")) for p in re.split(r"\n(?:[^\S\n]*\n)+", "\n".join(x.strip() for x in body.strip().split("\n"))) if p.strip()]


def rejoined(ends: str) -> Callable[[str], Verses]:
    """Paragraphs, those that a page break cut put together again: one without a closing mark goes on in the next."""
    closed = re.compile(f"[{ends}]\\s*$")

    def split(body: str) -> Verses:
        out: Verses = []
        for p in paragraphs(body):
            if out and not closed.search(out[-1]):
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    return split


def bracket_numbers(body: str) -> Verses:
    """Verses behind [1], [2]...; without any, paragraphs."""
    marks = list(re.finditer(r"\[\d+(?:&nbsp;)*\s*\]", body))
    if not marks:
        return paragraphs(body)
    ends = [m.start() for m in marks[1:]] + [len(body)]
    return [one_line(body[m.end() : e]) for m, e in zip(marks, ends, strict=True)]


def in_sequence(body: str) -> list[tuple[int, str]]:
    """(number, text) of verses whose numbers stand within the lines: only the next expected number is a marker."""
    found, want = [], None
    for m in re.finditer(r"(?:^|\s)(\d+)[.,]\s", body):
        if want is None or int(m[1]) == want:
            found.append(m)
            want = int(m[1]) + 1
    ends = [*[m.start() for m in found[1:]], len(body)][: len(found)]
    return [(int(m[1]), body[m.end() : e].strip()) for m, e in zip(found, ends, strict=True)]


def restarting(body: str) -> Sections:
    """Numbered verses in sections, a new one where numbers fall back; without numbers, paragraphs."""
    lines = [x.strip() for x in body.split("\n")]
    marks = [(i, int(m[1])) for i, x in enumerate(lines) if (m := NUMBER.match(x))]
    if not marks:
        verses = paragraphs(body)
        return [(1, verses)] if verses else []
    cuts, last, begin = [0], 0, 0
    for i, n in marks:
        if n <= last and any(numbered("\n".join(lines[begin:i]))):
            cuts.append(i)
            begin = i
        last = n
    parts = [numbered("\n".join(lines[a:b])) for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True)]
    return [(1, p) for p in parts if p]


# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Layout:
    """How a printed work is laid out. ``head`` finds chapter heads; its groups ``num`` (digits or Roman) and ``name`` are optional."""

    work: str
    head: str
    verses: Callable[[str], Verses | Sections]
    book: str = ""
    noise: tuple[str, ...] = ()
    cut: str | None = None
    clean: tuple[Callable[[str], str], ...] = (tidy,)
    body: Callable[[str], str] = lambda b: b
    name: Callable[[str | None, str], tuple[str | None, str]] = lambda n, b: (n.strip() or None if n else None, b)
    number: Callable[[re.Match, int], int] = lambda m, i: int(m["num"])
    #: What is done to each verse after parsing, as a Column; what it leaves empty goes. Then the first verse's capitals.
    finish: Callable[[Column], Column] | None = None
    first_caps: bool = False
    preface: str | None = None
    books: tuple[tuple[str, str], ...] = field(default=())
    flags: int = re.MULTILINE

    def parse(self, text: str) -> Iterator[tuple[str, int, str | None, Sections]]:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        for pattern in self.noise:
            text = re.sub(pattern, "", text, flags=re.MULTILINE)
        heads = list(re.finditer(self.head, text, self.flags))
        ends = [*[m.start() for m in heads[1:]], len(text)][: len(heads)]
        starts = [(m.start(), b) for b, p in self.books for m in re.finditer(p, text, re.MULTILINE)]
        if self.preface and heads and (m := re.search(self.preface, text[: heads[0].start()], re.MULTILINE)):
            yield from self._chapter(self.books[0][0] if self.books else self.book or self.work, 0, "Preface", text[m.end() : heads[0].start()])
        count: dict[str, int] = {}
        for i, (m, end) in enumerate(zip(heads, ends, strict=True)):
            # The book whose own head is the last one before this chapter.
            book = max(((at, b) for at, b in starts if at <= m.start()), default=(0, self.book or self.work))[1]
            count[book] = count.get(book, 0) + 1
            name = m.groupdict().get("name")
            name, rest = self.name(name, text[m.end() : end])
            yield from self._chapter(book, self.number(m, i if not self.books or self.preface else count[book] - 1), name, rest)

    def _chapter(self, book: str, number: int, name: str | None, body: str) -> Iterator[tuple[str, int, str | None, Sections]]:
        if self.cut:
            body = re.split(self.cut, body, maxsplit=1, flags=re.MULTILINE)[0]
        found = self.verses(self.body(body))
        start = 1
        if found and isinstance(found[0], tuple) and isinstance(found[0][1], str):  # numbered by the text itself
            if found[0][0] == 0:
                name, found = tidy(found[0][1]).rstrip("."), found[1:]
            start = found[0][0] if found else 1
            found = [t for _, t in found]
        sections: Sections = found if found and isinstance(found[0], tuple) else [(start, found)]  # type: ignore[assignment]
        done = []
        for first, verses in sections:
            for f in self.clean:
                verses = [f(v) for v in verses]
            verses = [v for v in verses if v]
            if verses:
                done.append((first, verses))
        if done:
            yield book, number, name, done


PAGE = r"\[f?p\.\s*\w+\]"


def _subtitle(name: str | None, body: str) -> tuple[str | None, str]:
    """The first line within four after the head that is not blank is the chapter's name."""
    if name:
        return name.capitalize(), body
    lines = body.split("\n")
    for k, line in enumerate(lines[1:5], 1):
        if line.strip():
            title = re.sub(r"-{2,}", "—", line.strip().rstrip(".").strip())
            return (heading_case(title) if title == title.upper() else title), "\n".join(lines[k + 1 :])
    return name, body


def _poem(name: str | None, body: str) -> tuple[str | None, str]:
    """A poem's first line, up to a semicolon and without its article, is its name; organizing lines are left out."""
    lines = [x.strip() for x in body.split("\n")]
    lines = [x for x in lines if x and not re.match(r"(?:BOOK|SECTION)\s+[IVXLC]+\.?|PART\s+[IVXLC]+\s*$", x, re.IGNORECASE)]
    title = lines[0].split(";")[0].strip() if lines else None
    return (title.removeprefix("The ") if title else None), "\n".join(lines[1:])


def _caps_title(text: str) -> str:
    return text.title() if text == text.upper() else text


def commented(lines: list[str], marks: tuple[str, ...] = ("COMMENTARY", "TSANG")) -> Sections:
    """Text, then a commentary behind a line with all ``marks``; the commentary's numbers go on from the text's."""
    at = next((i for i, x in enumerate(lines) if all(m in x.upper() for m in marks)), len(lines))
    text, comment = indented("\n".join(lines[:at])), indented("\n".join(lines[at + 1 :]))
    return [(1, text)] + ([(len(text) + 1, comment)] if comment else [])


#: The lines of a lay by their form (fixed by the printed text): rules and gaps, numbered heads, speakers, stanzas, notes.
STANZA = re.compile(r"(?P<number>\d+)[.,]\s*(?P<text>.*)")
SPEAKER = re.compile(r"(?P<name>\w[\w\s'-]*?)\s+spake:\s*$")
NOT_TEXT = re.compile(r"__|\.(?:\s+\.)+$|[IVXLC]+\.\s+[A-Z]")
NOTE = re.compile(r"\[(?:\d+|Prose|General|Introductory)")


def noted(lines: list[str]) -> list[bool]:
    """Lines of notes: a note begins with its bracket and ends where its brackets are closed; blank lines are none."""
    out, depth = [], 0
    for line in lines:
        out.append(bool(line) and (depth > 0 or NOTE.match(line) is not None))
        if out[-1]:
            depth = max(0, depth + line.count("[") - line.count("]"))
    return out


def lay(body: str) -> Verses:
    """Stanzas and prose of a lay, as islands between blank lines and stanza numbers; a speaker's name goes before what follows.

    Notes in brackets, titles, rules and gaps are left out.
    """
    lines = [x.strip() for x in body.split("\n")]
    islands: list[list[str]] = [[]]
    speaker = ""
    for line, note in zip(lines, noted(lines), strict=True):
        stanza, said_by = STANZA.match(line), SPEAKER.match(line)
        capitals = line.isupper() and len(line) > 3 and not stanza
        if note or capitals or NOT_TEXT.match(line):
            continue
        if said_by:
            speaker = said_by["name"].strip()
            continue
        if stanza or not line:
            islands.append([])
        text = stanza["text"].strip() if stanza else line
        if speaker and (text or stanza):
            text, speaker = f"{speaker}: {text}".strip(), ""
        islands[-1].append(text)
    return [joined for x in islands if (joined := " ".join(filter(None, x)))]


def after_introduction(body: str) -> str:
    """A lay's body from its first stanza, speaker or rule on, if an introductory note stands before it."""
    lines = body.split("\n")
    note = next((i for i, x in enumerate(lines) if x.strip() in ("INTRODUCTORY NOTE", "INTRODUCTORY NOTES")), None)
    if note is not None:
        begins = lambda x: STANZA.match(x) or SPEAKER.match(x) or x.startswith("__")
        lines = lines[next((i for i in range(note + 1, len(lines)) if begins(lines[i].strip())), 0) :]
    end = next((i for i, x in enumerate(lines) if x.strip() == "PRONOUNCING INDEX OF PROPER NAMES"), len(lines))
    return "\n".join(lines[:end])


def lays(titles: dict[str, str], work: str = "lays") -> Layout:
    """A layout of lays that begin at known titles; ``titles`` maps a title line to the name shown."""
    head = "|".join(re.escape(t) for t in sorted(titles, key=len, reverse=True))
    return Layout(work, rf"^[^\S\n]*(?P<name>{head})[^\S\n]*$", lay, noise=(PAGE, r"^\s*The .*sacred-texts\.com\s*$"), body=after_introduction, clean=(), finish=lay_verse, name=lambda n, b: (titles[(n or "").strip()], b), number=lambda m, i: i + 1)


#: A layout for each kind of source.
LAYOUTS = {
    "chunks": Layout("ttc", r"(?:\A|\n{3,})[^\S\n]*(?:Ch\.\s+)?(?P<num>\d+)\.", numbered, clean=(str.strip,), cut=r"^PART\b", flags=0),
    "sequence": Layout(
        "bund", r"^CHAPTER\s+(?P<num>\d+)\..*$", in_sequence,
        body=lambda b: one_line(without_parentheses(re.sub(r"[\[\]]", "", b))),
    ),
    "subverses": Layout(
        "viraf", r"^(?:CHAPTER|Chapter)\s+(?P<num>\d+)\.?(?P<name>.*)$", numbered, noise=(PAGE,), first_caps=True,
        body=lambda b: re.sub(r"^\[?Part \d+\..*$", "", b, flags=re.MULTILINE),
        clean=(lambda v: re.sub(r"\(\d+\)\s*", "", v), tidy, without_parentheses),
        name=lambda n, b: ((m[1].strip() if (m := re.search(r"\[(.+?)\]", n or "")) else None), b),
    ),
    "volumes": Layout(
        "kj", r"^\[SECT\.\s+[IVXLC]*\.?[:\-\s]*[-—]?(?P<name>.+?)\]?\s*\]?\s*$", rejoined('.!?"”'), cut=r"^Footnotes\s*$",
        noise=(PAGE, r"\[\d+\]", r"\[?\*\d+[a-z]?\]?", r"(?i)\[paragraph continues\]", r"^\s*The .*, translated by .*$", r"[()]"),
        number=lambda m, i: i + 1, name=lambda n, b: (_caps_title((n or "").strip().rstrip("]")), b), preface=r"^PREFACE\.",
        books=(("kjk", r"^VOL\. I\."), ("kjn", r"^VOL\. II\."), ("kjs", r"^VOL\. III\.")),
    ),
    "poems": Layout(
        "bop", r"^[IVXLC]+[^\S\n]*$", bracket_numbers, noise=(PAGE,), number=lambda m, i: i + 1, name=_poem,
        books=(("guofeng", r"^PART I\s*$"), ("xiaoya", r"^PART II\s*$"), ("daya", r"^PART III\s*$"), ("hymns", r"^PART IV\s*$")),
    ),
    "runes": Layout(
        "kv", r"^(?:(?P<name>PROEM)\.|RUNE\s+(?P<num>[IVXLC]+)\.?)[^\S\n]*$", rejoined('.!?;:,"”'), noise=(PAGE,), first_caps=True,
        number=lambda m, i: roman(m["num"]) if m["num"] else 0, name=_subtitle,
    ),
    "scraped": Layout(
        "scraped", r"^=== CHAPTER (?P<num>\d+) ===$", restarting, first_caps=True, clean=(str.strip,),
        body=lambda b: re.sub(r"\A(?:\s*\n)?(?:(?=[^\n]*\S)[^a-z\n]+(?:\n|\Z))+", "", b),
    ),
    "commented": Layout("gl", r"\A", lambda b: commented(b.split("\n")), clean=(str.strip,), first_caps=True, number=lambda m, i: i + 1, flags=0),
    "whole": Layout("dm", r"\A", indented, clean=(str.strip,), first_caps=True, number=lambda m, i: i + 1, flags=0),
    "indented": Layout("analects", r"^[^\S\n]{11,}(?P<num>\d+)[^\S\n]*$", indented, clean=(str.strip,), first_caps=True),
}


def _rows(layout: Layout, text: str | None, work: str, own: str | None = None) -> Iterator[tuple]:
    for found, number, name, sections in layout.parse(text or ""):
        book = own or found
        yield work, book, f"{book}-{number}", number, name, [{"startVerse": a, "verses": v} for a, v in sections]


def _finished(found: DataFrame, layouts: list[tuple[Column, Layout]]) -> DataFrame:
    """``found`` with what the layouts do to verses in the JVM; each layout has the condition of its rows."""
    verses = lambda x, v: F.struct(x["startVerse"].alias("startVerse"), v.alias("verses"))

    def finished(x: Column, finish: Callable[[Column], Column]) -> Column:
        return verses(x, F.filter(F.transform(x["verses"], lambda t: finish(t)), lambda t: t != ""))

    sections = F.col("sections")
    for mine, layout in layouts:
        if layout.finish:
            done = F.transform(sections, lambda x: finished(x, layout.finish))  # noqa: B023  built at once
            sections = F.when(mine, F.filter(done, lambda x: F.size(x["verses"]) > 0)).otherwise(sections)
    found = found.withColumn("sections", sections).where(F.size("sections") > 0)
    capitals = [mine for mine, layout in layouts if layout.first_caps]
    if not capitals:
        return found
    first = lambda v: F.transform(v, lambda t, i: F.when(i == 0, caps_first_words(t)).otherwise(t))
    begun = F.transform("sections", lambda x, i: F.when(i == 0, verses(x, first(x["verses"]))).otherwise(x))
    return found.withColumn("sections", F.when(reduce(lambda x, y: x | y, capitals), begun).otherwise(F.col("sections")))


def parse_files(files: DataFrame, layout: Layout) -> DataFrame:
    """Chapters of ``files`` (a column ``value`` with a whole text each); a null text gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in CHAPTERS.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for text in batch["value"] for r in _rows(layout, text, layout.work)], columns=names)

    return _finished(files.select("value").mapInPandas(run, CHAPTERS), [(F.lit(True), layout)])


def parse_books(files: DataFrame, layouts: dict[str, Layout], work: str) -> DataFrame:
    """Chapters of a work whose books come in files of their own (``book_id``, ``value``), each in the layout of its book.

    Files of books without a layout are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in CHAPTERS.split(", ")]
        for batch in batches:
            known = [(b, t) for b, t in zip(batch["book_id"], batch["value"], strict=True) if b in layouts]
            yield pd.DataFrame([r for book, text in known for r in _rows(layouts[book], text, work, book)], columns=names)

    found = files.select("book_id", "value").mapInPandas(run, CHAPTERS)
    return _finished(found, [(F.col("book_id") == b, layout) for b, layout in layouts.items()])


# ---------------------------------------------------------------- one verse a line: no Python


def verse_lines(lines: DataFrame, books: DataFrame, work: str) -> DataFrame:
    """Chapters of lines ``BOOK CHAPTER:VERSE text`` (column ``value``); other lines and unknown books are left out.

    ``books`` (``abbrev``, ``book_id``) is a small table. Verses are sorted within their chapter, which is as large as one
    chapter; its first number is its smallest.
    """
    from quire.functions.text import clean_text, normalize_divine_names, strip

    pattern = r"(?s)^(\w+)\s+(\d+):(\d+)\s+(.*)$"
    line = strip(F.col("value"))
    part = lambda k: F.regexp_extract(line, pattern, k)
    rows = lines.where(line.rlike(pattern)).select(part(1).alias("abbrev"), part(2).cast("int").alias("chapter_num"), part(3).cast("int").alias("verse"), clean_text(normalize_divine_names(part(4))).alias("text"))
    rows = rows.join(small(books.select("abbrev", "book_id")), "abbrev")
    grouped_ = rows.groupBy("book_id", "chapter_num").agg(F.array_sort(F.collect_list(F.struct("verse", "text"))).alias("v"))
    section = F.struct(F.element_at("v", 1)["verse"].alias("startVerse"), F.transform("v", lambda x: x["text"]).alias("verses"))
    return grouped_.select(F.lit(work).alias("work_id"), "book_id", F.concat_ws("-", "book_id", "chapter_num").alias("chapter_id"), "chapter_num", F.lit(None).cast("string").alias("name"), F.array(section).alias("sections"))


def headed_verses(files: DataFrame, work: str, head: str = r"^(\d+)\. [^:]*: .*$", verse: str = r"^\[(\d+)_(\d+)\](\d+)\s*(.*)$") -> DataFrame:
    """Chapters of whole texts (``value``) with chapter heads and verse lines ``[NNN_VVV]V text``; all within the row."""
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.rtrim(x)), lambda x: x.rlike(head) | x.rlike(verse))
    # A chapter is the piece from one head to the next; lines before the first head belong to none.
    rows = files.select(F.explode(let(lines, lambda l: pieces(l, F.transform(l, lambda x: x.rlike(head)), lambda p: p))).alias("p")).where(F.get("p", F.lit(0)).rlike(head))
    verses = F.transform(F.filter("p", lambda x: x.rlike(verse)), lambda x: F.trim(F.regexp_extract(x, verse, 4)))
    rows = rows.select(F.regexp_extract(F.get("p", F.lit(0)), head, 1).cast("int").alias("chapter_num"), verses.alias("v")).where(F.size("v") > 0)
    section = F.struct(F.lit(1).alias("startVerse"), F.col("v").alias("verses"))
    return rows.select(F.lit(work).alias("work_id"), F.lit(work).alias("book_id"), F.concat(F.lit(f"{work}-"), "chapter_num").alias("chapter_id"), "chapter_num", F.lit(None).cast("string").alias("name"), F.array(section).alias("sections"))


def headed_files(spark: SparkSession, path: str, work: str, head: str = r"^(\d+)\. [^:]*: .*$", verse: str = r"^\[(\d+)_(\d+)\](\d+)\s*(.*)$") -> DataFrame:
    """What ``headed_verses`` reads, from files of any size: a large file is read by many tasks.

    Spark divides a file at lines. The chapter that a part of a file begins in is handed on from the parts before it; the verses of
    a chapter, which is as large as one row, meet at the end. Parts know their places by their offset in the file.
    """
    line = F.rtrim("value")
    rows = spark.read.text(path).select(line.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias(PART), F.monotonically_increasing_id().alias("at"))
    rows = rows.where(F.col("value").rlike(head) | F.col("value").rlike(verse))
    is_head = F.col("value").rlike(head)
    number = F.when(is_head, F.regexp_extract("value", head, 1).cast("int"))
    placed = carried(rows, ["file"], ["at"], last={"chapter_num": number}, total={"nth": is_head.cast("long")})
    found = placed.where(~is_head & (F.col("nth") > 0)).groupBy("file", "nth", "chapter_num").agg(F.array_sort(F.collect_list(F.struct(PART, "at", F.trim(F.regexp_extract("value", verse, 4)).alias("t")))).alias("v"))
    section = F.struct(F.lit(1).alias("startVerse"), F.transform("v", lambda x: x["t"]).alias("verses"))
    return found.select(F.lit(work).alias("work_id"), F.lit(work).alias("book_id"), F.concat(F.lit(f"{work}-"), "chapter_num").alias("chapter_id"), "chapter_num", F.lit(None).cast("string").alias("name"), F.array(section).alias("sections"))
