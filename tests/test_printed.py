"""Printed volumes against a plain fold over the spans in reading order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.text import printed as clean
from quire.operators.ranges import PART, carried, in_parts
from quire.sources import printed

STYLE = printed.Print()
TITLES = [("Alpha", [], "w1", "a", False), ("Beta", [], "w1", "b", True), ("John", [], "w2", "john", False), ("John", ["FIRST", "EPISTLE"], "w2", "1john", False), ("John", ["SECOND"], "w2", "2john", True)]
TITLE_SCHEMA = "title string, words array<string>, work_id string, book_id string, single boolean"
SPANS = "doc string, p int, t string, s double, f int, x double, y double, x1 double"


def fold(spans, style=STYLE):
    """[(book, number, [raw verse texts])] of one volume, one span after another."""
    base = {t.upper(): (w, b, s) for t, words, w, b, s in reversed(TITLES) if not words}
    kept, heights = [], {}
    for _, p, t, s, f, x, y, x1 in spans:
        t, s = t.strip(), round(s, 1)
        if not t or (y < style.header_y and s <= style.header_size) or s <= style.note_size:
            continue
        head, decl = re.match(style.head, t), re.match(style.declaration, t)
        in_head = style.head_size[0] <= s <= style.head_size[1]
        if style.title[0] <= s < style.title[1] and not head and t.upper() in base:
            kind = "title"
        elif style.title[0] <= s < style.title[1]:
            kind = "other"
        elif head and in_head:
            kind = "head"
        elif decl and in_head:
            kind = "decl"
        elif s >= style.initial:
            kind = "initial"
        elif style.verse[0] <= s <= style.verse[1]:
            kind = "text"
        else:
            kind = "other"
        if kind == "title" or (kind in ("head", "decl") and x < style.middle < x1):
            heights.setdefault(p, set()).add(y)
        kept.append((p, y, x, t, s, f, kind, head or decl))
    key = lambda e: (e[0], sum(h <= e[1] for h in heights.get(e[0], ())), e[2] >= style.middle, e[1], e[2], e[3])
    out, ch, book = [], None, None
    for p, y, x, t, s, f, kind, m in sorted(kept, key=key):
        if kind == "title":
            own = base[t.upper()]
            if own[:2] != book:
                book, ch = own[:2], None
                if own[2]:
                    ch = {"book": book, "num": 1, "verses": [], "cur": None, "summary": True, "v1": False, "cap": None, "prose": False}
                    out.append(ch)
            continue
        if kind in ("head", "decl"):
            ch = {"book": book, "num": int(m[1]), "verses": [], "cur": 1 if kind == "decl" else None, "summary": kind == "head", "v1": False, "cap": None, "prose": kind == "decl"}
            if kind == "decl":
                ch["verses"].append([])
            out.append(ch)
            continue
        if ch is None:
            continue
        if ch["prose"]:
            ch["verses"][-1].append(t)
            continue
        if kind == "other" or (ch["summary"] and (f in (style.italic, style.bold) or t.startswith("("))):
            continue
        if ch["summary"]:
            ch["summary"], ch["cur"] = False, 1
            ch["verses"].append([])
        if kind == "initial":
            if ch["v1"]:
                ch["verses"][-1].append(t)
            else:
                ch["v1"], ch["cap"] = True, t
            continue
        if ch["cap"] is not None:
            up = re.match("[A-Z]*", t)[0]
            word = ch["cap"] + up
            t, ch["cap"] = word[0] + (word[1:].lower() if up else word[1:]) + t[len(up) :], None
        else:
            n = re.match(r"^(\d+)(?:\s+(.*))?$", t, re.DOTALL)
            if n and len(n[1]) < 9 and int(n[1]) <= style.most and ch["cur"] <= int(n[1]) <= ch["cur"] + style.jump:
                ch["cur"], ch["v1"] = int(n[1]), False
                ch["verses"].append([n[2] or ""])
                continue
        ch["verses"][-1].append(t)
    return [(c["book"], c["num"], [" ".join(v) for v in c["verses"]]) for c in out]


def volume(rng, doc, pages):
    """Random pages on which every rule can fire."""
    rows = []
    for p in range(pages):
        if rng.random() < 0.5:
            rows.append((doc, p, f"ALPHA {p}:1", 10.0, 0, 100.0, 20.0, 200.0))
        for _ in range(rng.randrange(14)):
            x, y = rng.choice([20.0, 60.0, 230.0, 280.0]), rng.randrange(40, 300) * 1.0
            kind = rng.choice("ttttttnnnnnkqhhwcimsobBpxd" if rng.random() < 0.7 else "tn")
            t, s, f, x1 = {
                "t": (rng.choice(["and it came", "THE Word", "be- ", "side", "LORD of hosts", "a , b", "in 1999", "[x] y"]), 10.2, 0, x + 50),
                "n": (f"{rng.randrange(30)}{rng.choice(['', ' and so', ' he said'])}", 10.5, rng.choice([0, 16]), x + 50),
                "k": ("7 hundred", 10.7, 0, x + 50), "q": ("(a date)", 10.0, 0, x + 50), "h": (f"CHAPTER {rng.randrange(1, 9)}", 10.4, 0, x + 50), "w": (f"Chapter {rng.randrange(1, 9)}", 11.0, 0, 400.0),
                "c": (rng.choice("IAT"), 32.0, 0, x + 20), "i": ("a summary", 10.0, 6, x + 50), "m": ("a", 6.0, 1, x + 3), "s": ("a note", 8.5, 0, x + 50), "o": ("* * *", 15.0, 0, x + 50), "b": (rng.choice(["ALPHA", "alpha", "Unknown"]), 24.0, 0, 380.0),
                "B": (rng.choice(["Beta", "John"]), 22.0, 0, 380.0), "p": ("12345678901 x", 10.2, 0, x + 50), "x": ("bold", 10.0, 20, x + 50), "d": (f"Official Declaration {rng.randrange(3)}", 10.8, 0, x + 50),
            }[kind]
            rows.append((doc, p, t, s, f, x, y, x1))
    return rows


def found(spark, rows, style=STYLE):
    df = spark.createDataFrame(rows, SPANS).repartition(5)
    out = {}
    for r in printed.chapters(df, spark.createDataFrame(TITLES, TITLE_SCHEMA), style=style).collect():
        out.setdefault(r.doc, []).append((r.chapter, (r.work_id, r.book_id) if r.book_id else None, r.chapter_num, r.verses))
    return {d: [x[1:] for x in sorted(v)] for d, v in out.items()}


def cleaned(spark, chapters):
    """The verses' raw texts cleaned, those without text left out."""
    flat = [(i, j, v) for i, (_, _, vs) in enumerate(chapters) for j, v in enumerate(vs)]
    texts = {(r.i, r.j): r.t for r in spark.createDataFrame(flat, "i int, j int, v string").select("i", "j", clean(F.col("v")).alias("t")).collect()} if flat else {}
    return [(b, n, [texts[i, j] for j in range(len(vs)) if texts[i, j]]) for i, (b, n, vs) in enumerate(chapters)]


@pytest.mark.parametrize("style", [STYLE, printed.Print(stretch=1, width=4), printed.Print(stretch=3, width=2, most=12, jump=3)])
def test_parallel_reading_is_the_fold(spark, style):
    rng = random.Random(8)
    rows = {d: volume(rng, d, n) for d, n in (("long", 90), ("two", 7), ("one", 1), ("none", 0))}
    rows["headless"] = [(*r[:2], r[2], r[3], *r[4:]) for r in volume(rng, "headless", 30) if "hapter" not in r[2].lower() and r[3] < 20 and "Decl" not in r[2]]
    rows["headless"].insert(0, ("headless", 0, "CHAPTER 1", 10.0, 0, 10.0, 36.0, 50.0))
    got = found(spark, [r for v in rows.values() for r in v], style)
    want = {d: w for d, v in rows.items() if (w := cleaned(spark, fold(v, style)))}
    assert got == want
    assert sum(len(c[2]) for c in got["long"]) > 40 and any(c[0] == ("w1", "b") for c in got["long"])


def test_each_rule(spark):
    at = lambda i, t, s=10.2, f=0, x=20.0, x1=100.0, p=1: ("d", p, t, s, f, x, 40.0 + i, x1)
    rows = [
        ("d", 1, "ALPHA 1:1", 10.0, 0, 90.0, 20.0, 150.0), at(0, "stray"), at(1, "ALPHA", 24.0, x1=400.0), at(2, "CHAPTER 1", 10.5), at(3, "what it tells", f=6), at(4, "(in spring)"), at(5, "A SUBTITLE", f=20),
        at(6, "I", 32.0), at(7, "N the beginning"), at(8, "a", 6.0), at(9, "5 loaves"), at(10, "2", f=16), at(11, "and 40"), at(12, "40"), at(13, "a foot- "), at(14, "note ends", f=6), at(15, "note", 8.0), at(16, "* *", 15.0), at(17, "4 later ."),
        at(2, "right of the head", x=230.0), at(20, "Chapter 2", 10.5, x1=400.0), at(21, "left"), at(21, "2 right", x=230.0), at(30, "Chapter 3", 10.5, x1=400.0), at(31, "third"), at(50, "ALPHA", 24.0, x1=400.0), at(51, "goes on"),
        at(60, "Beta", 24.0, x1=400.0), at(61, "only chapter"), at(62, "Official Declaration 1", 10.8), at(63, "prose 1"), at(64, "2 more", 12.0),
    ]
    got = found(spark, rows)["d"]
    assert got == [
        (("w1", "a"), 1, ["In the beginning", "loaves 2 and 40 40 a footnote ends 4 later. right of the head"]), (("w1", "a"), 2, ["left", "right"]), (("w1", "a"), 3, ["third goes on"]),
        (("w1", "b"), 1, ["only chapter"]), (("w1", "b"), 1, ["prose 1 2 more"]),
    ]
    assert got == cleaned(spark, fold(rows))


def test_page_books(spark):
    rows = [
        ("d", 1, "Alpha", 24.0, 0, 50.0, 60.0, 300.0), ("d", 2, "ALPHA 1:2 BETA 1:1", 10.0, 0, 50.0, 20.0, 300.0), ("d", 2, "text", 10.0, 0, 50.0, 60.0, 90.0), ("d", 3, "text", 10.0, 0, 50.0, 60.0, 90.0),
        ("d", 4, "THE FIRST EPISTLE OF", 12.0, 0, 50.0, 50.0, 300.0), ("d", 4, "JOHN", 24.0, 0, 50.0, 60.0, 300.0), ("d", 4, "BETA 1:9", 10.0, 0, 50.0, 20.0, 300.0), ("d", 5, "the second", 10.0, 20, 50.0, 50.0, 300.0), ("d", 5, "John", 24.0, 0, 50.0, 60.0, 300.0),
        ("d", 6, "the second", 10.0, 0, 50.0, 50.0, 300.0), ("d", 6, "John", 24.0, 0, 50.0, 60.0, 300.0), ("d", 7, "7", 10.0, 0, 50.0, 20.0, 300.0), ("e", 1, "no book", 10.0, 0, 50.0, 60.0, 300.0), ("f", 0, "x", 10.0, 0, 1.0, 50.0, 9.0), ("f", 300, "Beta", 24.0, 0, 50.0, 60.0, 300.0), ("f", 900, "y", 10.0, 0, 50.0, 60.0, 300.0),
    ]
    headers = spark.createDataFrame([("ALPHA", "w1", "a"), ("BETA", "w1", "b")], "header string, work_id string, book_id string")
    got = {(r.doc, r.p): (r["first"].book_id, r["last"].book_id) for r in printed.page_books(spark.createDataFrame(rows, SPANS), spark.createDataFrame(TITLES, TITLE_SCHEMA), headers).collect()}
    assert got == {("d", 1): ("a", "a"), ("d", 2): ("a", "b"), ("d", 3): ("b", "b"), ("d", 4): ("b", "1john"), ("d", 5): ("2john", "2john"), ("d", 6): ("john", "john"), ("d", 7): ("john", "john"), ("f", 300): ("b", "b"), ("f", 900): ("b", "b")}


def test_books_from_pages(spark):
    """The page's map decides which of the books of one title begins."""
    at = lambda p, i, t, s=10.2, x1=100.0: ("d", p, t, s, 0, 20.0, 40.0 + i, x1)
    rows = [at(1, 0, "THE FIRST EPISTLE", 12.0), at(1, 1, "John", 24.0, 400.0), at(1, 2, "CHAPTER 1"), at(1, 3, "one"), at(2, 0, "THE SECOND", 12.0), at(2, 1, "John", 24.0, 400.0), at(2, 2, "CHAPTER 1"), at(2, 3, "two"), at(3, 0, "CHAPTER 2"), at(3, 1, "three")]
    df, titles = spark.createDataFrame(rows, SPANS), spark.createDataFrame(TITLES, TITLE_SCHEMA)
    pages = printed.page_books(df, titles, spark.createDataFrame([], "header string, work_id string, book_id string"))
    got = sorted((r.chapter, r.book_id, r.chapter_num, r.verses) for r in printed.chapters(df, titles, pages).collect())
    assert got == [(1, "1john", 1, ["one"]), (2, "2john", 1, ["two"]), (3, "2john", 2, ["three"])]


def test_carried_over_parts(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, None, None, i]), rng.randrange(5)) for k in ("hot", "b", None) for i in range(1000 if k == "hot" else 90)]
    df = spark.createDataFrame(rows, "k string, i int, v int, n int")
    for parts in (1, 2, 40):
        for inclusive in (True, False):
            got = carried(in_parts(df, "i", parts), ["k"], ["i"], last={"seen": F.col("v")}, total={"sum": F.col("n")}, inclusive=inclusive)
            assert got.select(PART).distinct().count() == parts
            seen, total = {}, {}
            want = []
            for k, i, v, n in rows:
                if inclusive:
                    seen[k], total[k] = v if v is not None else seen.get(k), total.get(k, 0) + n
                want.append((k, i, seen.get(k), total.get(k, 0)))
                if not inclusive:
                    seen[k], total[k] = v if v is not None else seen.get(k), total.get(k, 0) + n
            assert sorted(map(tuple, got.select("k", "i", "seen", "sum").collect()), key=repr) == sorted(want, key=repr)


def test_a_verse_is_cleaned_once(spark):
    """the cleaned text is not computed anew wherever a step names it."""
    df = spark.createDataFrame([("THE ﬁrst",), (" ",)], "t string").select(clean(F.col("t")).alias("t")).where("t <> ''")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 30
    assert [r.t for r in df.collect()] == ["The first"]


def test_spans_are_classified_once(spark, monkeypatch):
    """spans are written before the heads of their pages are looked up in them."""
    written = {}
    real = printed.materialize
    monkeypatch.setattr(printed, "materialize", lambda df, name: written.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and real(df, name))
    rows = [("d", 1, "ALPHA", 24.0, 0, 20.0, 40.0, 400.0), ("d", 1, "CHAPTER 1", 10.5, 0, 20.0, 41.0, 100.0), ("d", 1, "one", 10.2, 0, 20.0, 42.0, 100.0)]
    assert found(spark, rows) == {"d": [(("w1", "a"), 1, ["one"])]}
    assert "collect_set" not in written["spans"]


def test_one_state_steps_as_many_do():
    """a stretch is read with one state at a time."""
    import numpy as np

    states = np.arange(printed._code(STYLE.most, 2) + 1)
    for k in range(6):
        for soft in (False, True):
            for n in (None, 0, 1, 2, 7, 11, 60, 199, 200, 201, 10**8):
                many = np.broadcast_to(printed.stepped(states, k, soft, n, STYLE), states.shape)
                assert [printed.step(int(s), k, soft, n, STYLE) for s in states] == many.tolist()
