import json
import random

import pytest
from pyspark.sql import functions as F

from quire.model import verses_of
from quire.sources import corpus, layouts, spans, tagged, web


def parsed(spark, layout, text):
    rows = layouts.parse_files(spark.createDataFrame([(text,)], "value string"), layouts.LAYOUTS[layout]).collect()
    return [(r.book_id, r.chapter_num, r.name, [(x.startVerse, x.verses) for x in r.sections]) for r in rows]


def test_chunks(spark):
    text = "PART I\n\n\n\nCh. 1. 1. The Tao\nthat can\n2. second\n\n\n\nCh. 2. 1. All\r\n 3. x"
    assert parsed(spark, "chunks", text) == [("ttc", 1, None, [(1, ["The Tao that can", "second"])]), ("ttc", 2, None, [(1, ["All", "x"])])]


def test_sequence_takes_only_the_next_number(spark):
    text = "CHAPTER 1.\n\n0. On the name.\n[1. First (gl) of 12. men 2. second\n\nmore 3, third\nCHAPTER 2.\nno marks"
    assert parsed(spark, "sequence", text) == [("bund", 1, "On the name", [(1, ["First of 12. men", "second more", "third"])])]


def test_subverses(spark):
    text = "CHAPTER 3 [The way.]\n[Part 1. Intro]\n\n1. IN THE name [p. 4] (1) of (2) God\ngo on\n2. Two (x y) end ."
    assert parsed(spark, "subverses", text) == [("viraf", 3, "The way.", [(1, ["In the name of God go on", "Two end."])])]


def test_volumes(spark):
    text = "VOL. I.\nPREFACE. [*1]\nI say.\n\n[SECT. I.--THE BEGINNING.]\n\n[1] When chaos\n\nbegan. [*2]\n\nNext one.\nFootnotes\nx\nVOL. II.\n[SECT. II.—Mixed Case]\nBody here.\n"
    got = parsed(spark, "volumes", text)
    assert [(b, n, s) for b, n, _, s in got] == [("kjk", 0, [(1, ["I say."])]), ("kjk", 1, [(1, ["When chaos began.", "Next one."])]), ("kjn", 2, [(1, ["Body here."])])]
    assert got[1][2] == "The Beginning." and got[2][2] == "Mixed Case"


def test_poems_and_runes(spark):
    text = "PART I\nBOOK I. x\nI\nThe Kwan; celebrating\n[1] Kwan kwan\ngo. [2] Second\nII\nPoem two\nline a\nline b\nPART II\nI\nThe X\n[1] y"
    assert parsed(spark, "poems", text) == [("guofeng", 1, "Kwan", [(1, ["Kwan kwan go.", "Second"])]), ("guofeng", 2, "Poem two", [(1, ["line a line b"])]), ("xiaoya", 1, "X", [(1, ["y"])])]
    text = "PROEM.\n\nMASTERED by desire,\nsing.\n\nRUNE IV.\nBIRTH OF THE HERO.\n\nIn primeval times\n\na maiden.\n\nNext\n"
    assert parsed(spark, "runes", text) == [("kv", 0, "Proem", [(1, ["Mastered by desire, sing."])]), ("kv", 4, "Birth of the Hero", [(1, ["In primeval times a maiden.", "Next"])])]


def test_scraped_and_indented(spark):
    text = "=== CHAPTER 1 ===\nTITLE LINE\n1. the first\nmore\n2. b\n1. new\n=== CHAPTER 2 ===\npara one\ngoes\n\npara two\n"
    assert parsed(spark, "scraped", text) == [("scraped", 1, None, [(1, ["the first more", "b"]), (1, ["new"])]), ("scraped", 2, None, [(1, ["para one goes", "para two"])])]
    text = "              1\n   THE MASTER said\n go on\n   Second\n              2\n   X\n"
    assert parsed(spark, "indented", text) == [("analects", 1, None, [(1, ["The master said go on", "Second"])]), ("analects", 2, None, [(1, ["X"])])]
    assert parsed(spark, "commented", "   A\n b\n   C\nCOMMENTARY OF TSANG\n   D\n") == [("gl", 1, None, [(1, ["A b", "C"]), (3, ["D"])])]


def test_lays(spark):
    text = "VOLUSPO\nINTRODUCTORY NOTE\nLong talk.\n\nOthin spake:\n1. Hearing I ask\nfrom all;\n[1. A note [p. 4]\ngoes on]\n2. I remember\n. . . . .\n\nProse here.\n\nHOVAMOL\n1. Within the gates"
    text += "\n\n, of -- [the] fp. gods . . . and\n\np. 12\n\n. . .\n\n[Paragraph continues] men [p. xii]"
    files = spark.createDataFrame([(text,), (None,), ("VOLUSPO\n. . .",)], "value string")
    got = layouts.parse_files(files, layouts.lays({"VOLUSPO": "Voluspo", "HOVAMOL": "Hovamol"})).orderBy("chapter_num").collect()
    assert [(r.chapter_id, r.name, [(x.startVerse, x.verses) for x in r.sections]) for r in got] == [
        ("lays-1", "Voluspo", [(1, ["Othin: Hearing I ask from all;", "I remember", "Prose here."])]), ("lays-2", "Hovamol", [(1, ["Within the gates", "of — the fp. gods and", "men"])]),
    ]


def test_parse_files(spark):
    files = spark.createDataFrame([("=== CHAPTER 5 ===\n1. a\n2. b",), (None,), ("",)], "value string")
    assert [(r.chapter_id, r.verse, r.text) for r in verses_of(layouts.parse_files(files, layouts.LAYOUTS["scraped"])).collect()] == [("scraped-5", 1, "a"), ("scraped-5", 2, "b")]


@pytest.mark.parametrize("text,want", [("IN THE NAME OF GOD, x", "In the name of God, x"), ("A MAN", "A MAN"), ("I SAW", "I SAW"), ("MASTERED by", "Mastered by"), ("", "")])
def test_sentence_case(spark, text, want):
    from quire.functions.text import caps_first_words

    assert spark.createDataFrame([(text,)], "t string").select(caps_first_words(F.col("t"))).first()[0] == want


def test_tagged_round_trip(spark, tmp_path):
    s = lambda n, *v: {"startVerse": n, "verses": list(v)}
    rows = [
        ("w", "Work", 0, "b", "Book", 1, 0, "b-1", "Name", "Intro", [s(1, "a", "b"), s(3, "c"), s(1, "d"), s(9, "e")]),
        ("w", "Work", 0, "b", "Book", 1, 1, "b-2", None, None, [s(4, "x")]),
        ("w", "Work", 1, "c", "Other", 7, 0, "c-7", None, None, [s(1, "y")]),
    ]
    df = spark.createDataFrame(rows, tagged.ROWS)
    lines = tagged.render(df, spark.createDataFrame([("w", 0, "kjv", "King", 1769)], "work_id string, ord int, id string, name string, year int"))
    tagged.write(lines, str(tmp_path / "t"))
    text = "\n".join(r.line for r in sorted(lines.collect(), key=lambda r: (r.book_ord, r.chapter_ord, r.line_no)))
    assert "TRANSLATION: kjv | King | 1769" in text and "SECTION:\nc" in text and "SECTION: @\nd" in text and "SECTION: @ 9\ne" in text and "START: 7" in text
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "t" / "work_id=w")).collect()) == text
    back = tagged.read(spark.createDataFrame([(text,)], "value string")).collect()
    assert [tuple(r)[:10] + ([x.asDict() for x in r.sections],) for r in back] == rows


def test_corpus_folder(spark, tmp_path):
    for work, ident in (("aa", "aa"), ("bb", "zz")):
        (tmp_path / work / "chapters").mkdir(parents=True)
        (tmp_path / work / "manifest.json").write_text(json.dumps({"id": ident, "title": "T", "books": [{"id": "g", "name": "G", "abbrev": "G.", "chapters": 2, "names": ["x", None]}]}))
        (tmp_path / work / "chapters" / "g-2.json").write_text(json.dumps({"sections": [{"startVerse": 5, "verses": ["v", "w"]}]}, indent=1))
    books = corpus.read_manifests(spark, str(tmp_path))
    assert {(r.work_id, r.book_id, r.chapters, r.start) for r in books.collect()} == {("aa", "g", 2, 1), ("zz", "g", 2, 1)}
    assert [r.message for r in corpus.work_mismatches(books).collect()] == ["bb: id is zz"]
    chapters = corpus.read_chapters(spark, str(tmp_path))
    assert sorted((r.ref, r.text) for r in verses_of(chapters).collect()) == [("aa:g-2:5", "v"), ("aa:g-2:6", "w"), ("bb:g-2:5", "v"), ("bb:g-2:6", "w")]
    corpus.write_chapters(chapters, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_spans(spark):
    rows = [("d", 1, "right", 10.0, 0, 300.0, 10.0), ("d", 1, "left", 10.0, 0, 10.0, 50.0), ("d", 1, "1", 10.0, 16, 5.0, 10.0), ("d", 1, "2", 10.0, 16, 290.0, 10.0), ("d", 1, "999", 10.0, 16, 5.0, 60.0), ("d", 1, "note", 5.0, 0, 5.0, 90.0)]
    df = spark.createDataFrame(rows, "doc string, p int, t string, s double, f int, x double, y double")
    bounds = spark.createDataFrame([], "doc string, p int, ys array<double>")
    got = spans.page_verses(spans.reading_order(spans.without_notes(df, 6.0), bounds, 200.0)).collect()
    assert sorted((r.verse, r.text) for r in got) == [(1, "left 999"), (2, "right")]


def test_web(spark):
    page = '<title>t</title><a href="#x">a</a><a href="b.htm">b</a><a class="q" href="b.htm">b</a><a href="http://x">x</a><a href="index.htm">i</a><a href="/d/c.htm">c</a>'
    df = spark.createDataFrame([(1, "http://h/d/index.htm", page)], "page_id long, url string, html string")
    assert [(r.pos, r.link) for r in web.page_links(df).collect()] == [(0, "http://h/d/b.htm"), (1, "http://h/d/c.htm")]
    assert web.visible_text("<title>T</title><p>Next</p><p>1. In the beginning &amp; so on</p><script>x</script><p>more of it</p><p>Index</p>").startswith("1. In the beginning & so on")


def test_span_chapters(spark):
    rows = [(0, "FIRST BOOK", 20.0, 0), (1, "stray", 8.0, 0), (2, "CHAPTER 1", 9.0, 0), (3, "1", 8.0, 16), (4, "In the", 8.0, 0), (5, "beginning", 8.0, 0), (6, "2", 8.0, 16), (7, "and 900", 8.0, 0), (8, "900", 8.0, 16), (9, "CHAPTER 2", 9.0, 0), (10, "5", 8.0, 16), (11, "later", 8.0, 0), (12, "first book", 8.0, 0), (13, "Second Book", 20.0, 0), (14, "SECTION 7", 9.0, 0), (15, "no number", 8.0, 0), (16, "1", 8.0, 16), (17, "a verse", 8.0, 0)]
    df = spark.createDataFrame([("d", i, t, s, f) for i, t, s, f in rows], "doc string, place int, t string, s double, f int")
    titles = spark.createDataFrame([("First Book", "w1", "b1", 0), ("Second Book", "w2", "b2", 0)], "title string, work_id string, book_id string, ord int")
    found = spans.span_chapters(df, titles, 15.0)
    got = {r.chapter_id: (r.work_id, [(x.startVerse, x.verses) for x in r.sections]) for r in found.collect()}
    assert got == {"b1-1": ("w1", [(1, ["In the beginning", "and 900 900"])]), "b1-2": ("w1", [(5, ["later first book"])]), "b2-7": ("w2", [(1, ["no number", "a verse"])])}
    books = {r.book_id: (r.work_id, r.chapters, r.start, r.name) for r in spans.volume_manifest(found, titles).collect()}
    assert books == {"b1": ("w1", 2, 1, "First Book"), "b2": ("w2", 1, 7, "Second Book")}


def test_headed_files_are_read_in_parts(spark, tmp_path):
    """A file of one line a part gives what the whole text does, wherever Spark cuts it."""
    rng = random.Random(3)
    texts = []
    for f in range(3):
        lines = ["[1_1]1 before any head", "noise"]
        for c in range(40):
            lines += [f"{c}. name: Title {f}", *[f"[{c:03}_{v:03}]{v} verse {v} of {c} " + "x" * rng.randrange(200) for v in range(1, rng.randrange(1, 12))], "noise \t"]
        texts.append("\n".join(lines))
        (tmp_path / f"f{f}.txt").write_text(texts[-1])
    want = sorted((r.chapter_num, r.sections[0].verses) for r in layouts.headed_verses(spark.createDataFrame([(t,) for t in texts], "value string"), "q").collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("777", "5000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = layouts.headed_files(spark, str(tmp_path), "q")
            assert sorted((r.chapter_num, r.sections[0].verses) for r in got.collect()) == want
            if size == "777":
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
