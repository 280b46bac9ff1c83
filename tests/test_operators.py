"""Edge cases of the operators on small literals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.model import verses_of
from quire.operators import corpus as C
from quire.operators import reader as R
from quire.operators import site
from quire.operators.asof import latest_before


@pytest.fixture(scope="module")
def verses(spark):
    rows = [("w", "b", "b-1", 0, i, i + 1, f"w:b-1:{i + 1}", t) for i, t in enumerate(["The CAT sat.", "100% of a_b (x)", "Éclair é", "", "cat's don't forty-two"])]
    rows += [("x", "b", "b-1", 0, i, i + 1, f"x:b-1:{i + 1}", "cat") for i in range(120)]
    return spark.createDataFrame(rows, "work_id string, book_id string, chapter_id string, section_idx int, verse_idx int, verse int, ref string, text string")


def test_search(verses):
    count = lambda *a, **k: C.search(verses, *a, **k).count()
    assert [count(""), count("  "), count("%"), count("_"), count("(x)"), count(" CAT "), count("cat", work="w")] == [0, 0, 1, 1, 1, 122, 2]
    assert count("cat", work="w", book="none") == 0 and count("cat", book="none") == 122
    first = C.first_hits(C.search(verses, "cat")).collect()
    assert len(first) == 100 and [r.ref for r in first[:3]] == ["w:b-1:1", "w:b-1:5", "x:b-1:1"]
    assert {tuple(r) for r in C.group_hits(C.search(verses, "cat")).collect()} == {("w", 2, "w:b-1:1"), ("x", 120, "x:b-1:1")}


def test_words(verses):
    words = C.word_rows(verses, ["the", "of"])
    assert {r.word for r in words.where("ref = 'w:b-1:5'").collect()} == {"cat's", "don't", "forty", "two"}
    assert {r.word: r.verse_count for r in C.word_counts(words).collect()}["cat"] == 121
    row = C.concordance(words).where("word = 'cat' AND work_id = 'x'").first()
    assert row.verse_count == 120 and row.refs.split(" ")[:3] == ["x:b-1:1", "x:b-1:2", "x:b-1:3"]


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"c {kind}").select(*columns).first())


def test_text(spark):
    c = F.col("c")
    assert one(spark, "a+b (x) A+B", T.highlight(c, "a+b"), T.highlight(c, "")) == ("<mark>a+b</mark> (x) <mark>A+B</mark>", "a+b (x) A+B")
    assert one(spark, "É é ée", T.highlight(c, "é")) == ("<mark>É</mark> <mark>é</mark> <mark>é</mark>e",)
    assert one(spark, " [a] x -- y , z  \t", T.clean_text(c)) == ("a x — y, z",)
    assert one(spark, "Héllo, Wörld -- x", T.slugify(c)) == ("hello-world-x",)
    assert one(spark, "**b** *i* <x> gen:gen-1:3", T.markdown(c)) == ('<strong>b</strong> <em>i</em> &lt;x&gt; <a class="ref" href="#" data-ref="gen:gen-1:3">gen:gen-1:3</a>',)
    assert one(spark, "a b-\nc ﬁre¶ so­ft", T.ligatures(c)) == ("a bc fire soft",)
    assert one(spark, "THE LAY of the king", T.title_case(c), T.title_if_caps(c)) == ("The Lay of the King", "THE LAY of the king")
    exact, over = "x" * 80 + " " + "y" * 79, "x" * 80 + " " + "y" * 200
    assert one(spark, exact, T.description(c)) == (exact,) and one(spark, over, T.description(c)) == ("x" * 80 + "…",)
    assert one(spark, "z" * 161, T.description(c)) == ("z" * 160 + "…",)
    assert one(spark, "w:1-ne-3:7", T.parse_ref(c))[0].asDict() == {"work_id": "w", "chapter_id": "1-ne-3", "verse": 7}
    assert one(spark, "gen-26", T.chapter_number(c), T.book_of(c), T.format_ref(c, F.lit("4"), F.lit("Gen.")), T.format_ref(c, F.lit("4"), F.lit(None))) == ("26", "gen", "Gen. 26:4", "gen-26:4")
    assert one(spark, ["A", "B"], T.credit(c, F.lit("ed"), F.lit(1)), kind="array<string>") == ("A & B",)
    assert one(spark, "long " * 30, T.wrap(F.lit("1:2 "), c))[0].startswith("1:2 long") and max(map(len, one(spark, "long " * 30, T.wrap(F.lit("1:2 "), c))[0].split("\n"))) <= 72


def test_sections_and_refs(spark):
    df = spark.createDataFrame([("w", "b", "b-1", 1, [(1, ["a", "b"]), (1, ["c"]), (9, [])])], "work_id string, book_id string, chapter_id string, chapter_num int, sections array<struct<startVerse:int,verses:array<string>>>")
    assert [(r.section_idx, r.verse, r.ref) for r in verses_of(df).collect()] == [(0, 1, "w:b-1:1"), (0, 2, "w:b-1:2"), (1, 1, "w:b-1:1")]


def test_reading_order_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE", 3)
    rows = [("w", b, f"{b}-{n}", n) for b, ns in (("a", range(1, 9)), ("b", [2, 20]), ("c", [0])) for n in ns]
    got = {r.chapter_id: (r.prev_id, r.next_id, r.position, r.chapters) for r in C.reading_order(spark.createDataFrame(rows, "work_id string, book_id string, chapter_id string, chapter_num long")).collect()}
    ids = [r[2] for r in rows]
    for i, (_, b, c, _) in enumerate(rows):
        of = [r for r in rows if r[1] == b]
        assert got[c] == (ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None, [r[2] for r in of].index(c) + 1, len(of))


def test_expand_books(spark):
    df = spark.createDataFrame([("w", "b", 2, 0, ["x", None]), ("w", "none", 0, 1, None), ("w", "c", 1, None, None)], "work_id string, book_id string, chapters int, start int, names array<string>")
    assert [(r.chapter_id, r.name) for r in C.expand_books(df).collect()] == [("b-0", "x"), ("b-1", None), ("c-1", None)]


def test_similarity(spark):
    t = ["alpha beta gamma delta", "alpha beta gamma delta", "alpha beta gamma omega", "unlike words here entirely"]
    rows = [("w1", "b", "b-1", t[0]), ("w1", "b", "b-2", t[1]), ("w2", "b", "c-1", t[1]), ("w2", "d", "d-1", t[2]), ("w3", "e", "e-1", t[3]), ("w3", "e", "e-2", " ")]
    df = spark.createDataFrame(rows, "work_id string, book_id string, chapter_id string, t string").withColumn("sections", F.array(F.struct(F.lit(1).alias("startVerse"), F.array("t").alias("verses"))))
    got = [(r.chapter_id, r["rank"], r.ref, r.score) for r in C.similar_chapters(C.chapter_vectors(df, [])).orderBy("chapter_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == "b-1"] == [("b-1", 1, "w2:c-1"), ("b-1", 2, "w2:d-1")] and got[0][3] == 1.0
    assert not any(g[0].startswith("e") for g in got)
    assert [g[2] for g in got if g[0] == "c-1"] == ["w1:b-1", "w1:b-2", "w2:d-1"]


def test_similarity_is_all_pairs(spark):
    """Many strips, rare words beyond the dense ones, copies and ties: as numpy finds it."""
    import math
    from collections import Counter

    rng = random.Random(9)
    common, rare = [f"c{i}" for i in range(900)], [f"rare{i}" for i in range(2500)]
    rows = []
    for i in range(260):
        words = [rng.choice(common) for _ in range(40)] + [rng.choice(rare) for _ in range(rng.randrange(40))] if i % 5 else ["one", "passage", "again", common[7]]
        rows.append((f"w{i % 4}", f"b{i % 3}", f"b-{i:03}", " ".join(words)))
    rows += [("v", "z", f"z-{k}", " ".join([f"only{k % 3}", f"rare{k}x"] * 2)) for k in range(9)]
    df = spark.createDataFrame(rows, "work_id string, book_id string, chapter_id string, t string").withColumn("sections", F.array(F.struct(F.lit(1).alias("startVerse"), F.array("t").alias("verses"))))
    tf = [Counter(t.split()) for *_, t in rows]
    cf, dfs = Counter(), Counter()
    for c in tf:
        cf.update(c)
        dfs.update(c.keys())
    assert len(cf) > 1.5 * C.DENSE
    vec = []
    for c in tf:
        x = {w: n * (math.log((1 + len(rows)) / (1 + dfs[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        vec.append({w: v / norm for w, v in x.items()})
    want = {}
    for i, (w, b, c, _) in enumerate(rows):
        scores = [(-round(s, 3), (w2, c2)) for j, (w2, b2, c2, _) in enumerate(rows) if (w2, b2) != (w, b) and (s := sum(v * vec[j].get(k, 0) for k, v in vec[i].items())) >= 0.1]
        for r, (s, (w2, c2)) in enumerate(sorted(scores)[:5], 1):
            want[w, c, r] = (f"{w2}:{c2}", -s)
    for size in (1 << 25, 20_000):
        got = {(r.work_id, r.chapter_id, r["rank"]): (r.ref, r.score) for r in C.similar_chapters(C.chapter_vectors(df, []), strip_bytes=size).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_verify_in_one_pass(spark):
    """Each check, repeated and null rows, and what is observed on the way."""
    from pyspark.sql import Observation

    s = "array<struct<startVerse:int,verses:array<string>>>"
    works = spark.createDataFrame([("w",), ("w",), ("gone",), (None,)], "work_id string")
    books = spark.createDataFrame([("w", "b", 2, 5), ("w", "c", 0, None), ("v", "b", 1, None)], "work_id string, book_id string, chapters int, start int")
    chapters = spark.createDataFrame([("w", "b", "b-5", 5, [(1, ["a", ""]), (3, [" "])]), ("x", "q", "q-9", 9, [(1, [" "])]), ("v", "b", "b-1", 1, []), ("w", "b", "b-8", 8, [(1, ["extra"])])], f"work_id string, book_id string, chapter_id string, chapter_num int, sections {s}")
    expected = spark.createDataFrame([("b", 0, 3), ("b", 1, 2), ("b", 2, 2), ("none", 0, 1)], "book_id string, idx int, verses int")
    seen = Observation()
    got = sorted(r.message for r in C.verify(works, books, chapters, expected, seen).collect())
    assert got == ["gone: manifest missing", "v/b-1: 0 verses, expected 3", "v/b: 1 chapters, expected 3", "w/b-5: 2 blank verses", "w/b-6: chapter missing", "w/b: 2 chapters, expected 3", "x/q-9: 1 blank verses"]
    assert seen.get == {"chapters": 4, "verses": 5, "blank": 3}
    assert C.verify(works.limit(0), books.limit(0), chapters.limit(0), expected.limit(0)).count() == 0


def test_verify(spark):
    s = "array<struct<startVerse:int,verses:array<string>>>"
    works = spark.createDataFrame([("w",), ("gone",)], "work_id string")
    books = spark.createDataFrame([("w", "b", 3, 1)], "work_id string, book_id string, chapters int, start int")
    chapters = spark.createDataFrame([("w", "b", "b-1", 1, [(1, ["a", " "])]), ("w", "b", "b-2", 2, [(1, ["a"])])], f"work_id string, book_id string, chapter_id string, chapter_num int, sections {s}")
    expected = spark.createDataFrame([("b", 0, 2), ("b", 1, 4)], "book_id string, idx int, verses int")
    assert sorted(r.message for r in C.verify(works, books, chapters, expected).collect()) == ["gone: manifest missing", "w/b-1: 1 blank verses", "w/b-2: 1 verses, expected 4", "w/b-3: chapter missing", "w/b: 3 chapters, expected 2"]


def test_readers(spark):
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    notes = R.merge_notes(mk([("a", "1"), ("b", "2")], "ref string, text string"), mk([("b", "3"), ("c", "4")], "ref string, text string"))
    assert {tuple(r) for r in notes.collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    marks = R.merge_bookmarks(mk([("a", 1), ("b", 2)], "ref string, seq int"), mk([("b", 1), ("c", 2)], "ref string, seq int"))
    assert [r.ref for r in marks.orderBy("side", "seq").collect()] == ["a", "b", "c"]
    assert {tuple(r) for r in R.toggled(mk([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "u int, k string"), "u", "k").collect()} == {(1, "b"), (2, "a")}
    stores = R.restore(mk([(1, '{"notes":{"a":"b"}}'), (2, "broken"), (3, None)], "user_id int, store string"))
    assert {r.user_id: (dict(r.store.notes), list(r.store.bookmarks)) for r in stores.collect()} == {1: ({"a": "b"}, []), 2: ({}, []), 3: ({}, [])}
    assert [r.w for r in R.ordered_union(mk([("x", 1), ("gone", 0), ("y", 2)], "w string, k int"), mk([("y",), ("new",), ("x",)], "w string"), "w", "k").orderBy("side", "place", "w").collect()] == ["x", "y", "new"]


def test_as_of_with_any_ranges(spark):
    rows = [(i % 3, (i * 37) % 101, i, i % 5 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t long, id long, m boolean")
    want = {}
    for k, t, i, _ in rows:
        before = [(u, j) for l, u, j, m in rows if l == k and m and (u, j) <= (t, i)]
        want[i] = max(before)[1] if before else None
    for ranges in (1, 7, 64):
        assert {r.id: r.marker for r in latest_before(df, "k", ("t", "id"), F.col("m"), "id", ranges).collect()} == want


def test_site(spark):
    books = spark.createDataFrame([("w", "b", 1, 3, None)], "work_id string, book_id string, chapters int, start int, names array<string>")
    lines = [r.value for r in site.sitemap_lines(site.site_urls(books, "https://h")).collect()]
    assert lines[2] == "<url><loc>https://h/w/b-3</loc><changefreq>yearly</changefreq><priority>0.6</priority></url>"
    row = spark.range(1).select(site.json_ld(F.struct(F.lit("</script>").alias("a"), F.lit(None).cast("string").alias("b"))), site.json_ld(site.breadcrumbs(F.array(F.lit("n")), F.array(F.lit("i"))))).first()
    assert row[0] == '{"a":"\\u003c/script>"}' and '"position":1' in row[1]


def test_folds_are_linear(spark):
    """A document of 100,000 lines: each fold ends in seconds and is right."""
    import time

    n = 100_000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 7 == 0, i)).alias("v"), F.sequence(F.lit(1), F.lit(n)).alias("k"))
    text = F.transform("k", lambda i: F.concat(F.when(i % 5 == 1, F.concat(i.cast("string"), F.lit(". "))).otherwise(""), F.lit("w")))
    paragraphs = F.transform("k", lambda i: F.when(i % 3 == 0, "end.").otherwise("on"))
    began = time.time()
    filled = C.filled_forward(F.transform("v", lambda x: x.cast("string")))
    restarts = C.sections_of_numbers(F.transform("k", lambda i: i % 10))
    marks = C.sequential_markers(F.transform("k", lambda i: F.when(i % 2 == 0, i / 2).otherwise(0)))
    row = rows.select(filled.alias("f"), restarts.alias("r"), marks.alias("m"), C.numbered_verses(text).alias("t"), C.merged_paragraphs(paragraphs).alias("p")).first()
    assert row.f[:8] == [None] * 6 + ["7", "7"] and row.f[-1] == str(n - n % 7)
    assert row.r[8:12] == [0, 1, 1, 1] and row.r[-1] == n // 10 and len(row.r) == n
    assert row.m == list(range(1, n, 2))
    assert len(row.t) == n // 5 and set(row.t) == {"w w w w w"}
    assert row.p[0] == "on on end." and len(row.p) == n // 3 + 1
    assert time.time() - began < 60


def test_folds_on_small_arrays(spark):
    values = [[], [None], ["a", None, None, "b", None], [None, "", "x"]]
    df = spark.createDataFrame([(v,) for v in values] + [(["m"] + [None] * 600,)], "v array<string>")
    assert [r[0] for r in df.select(C.filled_forward(F.col("v"))).collect()] == [[], [None], ["a", "a", "a", "b", "b"], [None, "", "x"], ["m"] * 601]
    df = spark.createDataFrame([(["", "a", "", "b"], [False, False, True, False]), ([], []), ([""], [True])], "l array<string>, s array<boolean>")
    assert [r[0] for r in df.select(C.islands(F.col("l"), F.col("s"))).collect()] == [["a", "b"], [], [""]]


def test_sections_need_text(spark):
    rows = [([1, 2, 1, 2, 2, 1], [True, True, True, False, False, True]), ([1, 1, 1], [False, False, True]), ([3, 2, 1], [True, True, True]), ([], [])]
    df = spark.createDataFrame(rows, "n array<int>, f array<boolean>")
    assert [r[0] for r in df.select(C.sections_of_numbers(F.col("n"), F.col("f"))).collect()] == [[0, 0, 1, 1, 2, 2], [0, 0, 0], [0, 1, 2], []]


def test_numerals_and_titles(spark):
    from quire.sources.layouts import heading_case, roman

    numerals = ["", "I", "IV", "XIX", "XL", "CCXCIX", "MCMXCIV", "XIIX", "IIX", "iv", "A"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numerals], "c string").select(T.roman_to_int(F.col("c"))).collect()]
    assert got == [roman(x) for x in numerals] == [0, 1, 4, 19, 40, 299, 1994, 20, 10, 4, 0]
    titles = ["UP TO NOW AND UP", "the lay OF the king", "a", "", "of the", "  so it   is "]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in titles], "c string").select(T.title_case(F.col("c"))).collect()] == [heading_case(x) for x in titles]
    assert heading_case("UP TO NOW AND UP") == "Up to Now and Up"
    assert one(spark, "THE KING'S SON", T.title_if_caps(F.col("c"))) == ("The King'S Son",)


def test_printed_text(spark):
    cases = {
        "I SAW the Lord": "I saw the Lord", "O LORD our GOD": "O Lord our God", "THUS the heavens": "Thus the heavens", "AND, behold": "And, behold", "See Feasts .": "See Feasts.",
        "be- side Baal- Hanan": "beside Baal-Hanan", "Cæsar\u00ad ¶x": "Caesar x", "McK x": "McK x", "A": "A", "": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c string").orderBy("i")
    assert [r[0] for r in df.select(T.printed(F.col("c"))).collect()] == list(cases.values())


def test_stores(spark):
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    stores = R.restore(R.migrated(mk([(1, '{"notes":{"a":"b"}}', '{"c":"d"}'), (2, "broken", '{"c":"d"}'), (3, None, "broken"), (4, None, None)], "user_id int, store string, old_notes string")))
    assert {r.user_id: dict(r.store.notes) for r in stores.collect()} == {1: {"a": "b"}, 2: {"c": "d"}, 3: {}, 4: {}}
    kept = R.replaced(mk([(1, "x", "y"), (2, "x", "y")], "user_id int, a string, b string"), mk([(1, "z", None), (3, "n", None)], "user_id int, a string, b string"), ["a", "b"])
    assert sorted(map(tuple, kept.collect())) == [(1, "z", None), (2, "x", "y"), (3, "n", None)]
    refs = ["w:b-10:2", "w:b-2:10", "w:b-2:9", "v:z-1:1", "w:b-2:x"]
    assert [r.ref for r in R.listed(mk([(r,) for r in refs], "ref string")).collect()] == ["v:z-1:1", "w:b-10:2", "w:b-2:x", "w:b-2:9", "w:b-2:10"]
    assert [r.ref for r in R.of_chapter(mk([(r,) for r in refs], "ref string"), "w", "b-2").collect()] == ["w:b-2:10", "w:b-2:9", "w:b-2:x"]
    assert R.matching_bookmarks(mk([("w:a-1:1", None), ("x", "The END")], "ref string, text string"), " end ", "text", "ref").count() == 1


def test_build(spark, tmp_path):
    from quire.plans import build

    folder = str(tmp_path / "corpus")
    assert [r.message for r in build.missing_works_list(spark, folder).collect()] == ["works: list missing"]
    works = spark.createDataFrame([("w", "Work"), ("v", "Other")], "work_id string, title string")
    books = spark.createDataFrame([("w", 0, "b", "Book", None, 2, 1, None)], "work_id string, book_ord int, book_id string, name string, abbrev string, chapters int, start int, names array<string>")
    s = "array<struct<startVerse:int,verses:array<string>>>"
    chapters = spark.createDataFrame([("w", "b", "b-1", 1, [(1, ["alpha beta", "gamma"])]), ("w", "b", "b-2", 2, [(1, ["beta"])])], f"work_id string, book_id string, chapter_id string, chapter_num int, sections {s}")
    build.write_corpus(works, books, chapters, folder)
    assert build.missing_works_list(spark, folder).count() == 0
    assert [r.work_id for r in build.works_list(spark, folder).orderBy("work_id").collect()] == ["v", "w"]
    back = {w: (tmp_path / "corpus" / w / "manifest.json").read_text() for w in ("v", "w")}
    assert back == {"w": '{"id":"w","title":"Work","books":[{"id":"b","name":"Book","chapters":2,"start":1}]}', "v": '{"id":"v","title":"Other","books":[]}'}
    assert build.build_indexes(chapters, [], folder) == {"search": 3, "concordance": 4, "similarity": 0}
    assert [r.word for r in spark.read.parquet(f"{folder}/concordance/words/data").select("word").distinct().orderBy("word").collect()] == ["alpha", "beta", "gamma"]
    assert "text/html" in site.open_search("https://h", "a & b", "d") and "a &amp; b" in site.open_search("https://h", "a & b", "d")


def test_corpus_is_read_as_it_was_written(spark, tmp_path):
    from pyspark.errors import PySparkException

    from quire.plans import build
    from quire.sources import corpus

    folder = str(tmp_path / "corpus")
    works = spark.createDataFrame([("w", "Work"), ("v", None)], "work_id string, title string")
    s = "array<struct<startVerse:int,verses:array<string>>>"
    books = spark.createDataFrame([("w", 0, "b", "Book", "B.", 2, 3, ["x", None]), ("w", 1, "c", "C", None, 1, None, None)], "work_id string, book_ord int, book_id string, name string, abbrev string, chapters int, start int, names array<string>")
    rows = [("w", "b", f"b-{i}", i, "N" if i % 2 else None, None, [(1, ["é\n\"q\"", ""]), (7, [])]) for i in range(30)] + [("v", "z", "z-1", 1, None, "intro", [])]
    chapters = spark.createDataFrame(rows, f"work_id string, book_id string, chapter_id string, chapter_num long, name string, intro string, sections {s}").repartition(6)
    for _ in range(2):  # the second time it is replaced
        build.write_corpus(works, books, chapters, folder)
        back = corpus.read_chapters(spark, folder).select(*chapters.columns)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, chapters.collect()))
        found = corpus.read_manifests(spark, folder).where("book_id IS NOT NULL").orderBy("book_ord").collect()
        assert [(r.work_id, r.dir, r.title, r.book_ord, r.book_id, r.book_name, r.abbrev, r.chapters, r.start, r.names) for r in found] == [("w", "w", "Work", 0, "b", "Book", "B.", 2, 3, ["x", None]), ("w", "w", "Work", 1, "c", "C", None, 1, 1, None)]
    assert corpus.work_mismatches(corpus.read_manifests(spark, folder)).count() == 0
    build.write_corpus(works.where("work_id = 'w'"), books, chapters.where("chapter_id = 'b-4'"), folder)  # w has one chapter now, v stays
    assert sorted(r.chapter_id for r in corpus.read_chapters(spark, folder).collect()) == ["b-4", "z-1"]
    before = sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.json"))
    for bad in ("../x", "", ".hidden"):
        with pytest.raises(PySparkException):
            build.write_corpus(works, books, chapters.withColumn("chapter_id", F.when(F.col("chapter_num") == 7, F.lit(bad)).otherwise(F.col("chapter_id"))), folder)
    with pytest.raises(PySparkException, match="there already"):
        spark.createDataFrame([("w", "b-1", "{}")], "work_id string, chapter_id string, json string").write.format("quire_corpus").mode("append").save(folder)
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.json")) == before
    assert not [d for d in (tmp_path / "corpus").iterdir() if d.name.startswith(".staging")]
    module = build.corpus_module(corpus.read_manifests(spark, folder).select("work_id", "dir", F.lit("{}").alias("json")).distinct())
    assert sorted(r.work_id for r in module.collect()) == ["v", "w"]


def test_search_with_manifests(spark, verses):
    books = spark.createDataFrame([("w", "b")], "work_id string, book_id string")
    assert C.search(verses, "cat", work="w", book="none", books=books).count() == 2 == C.search(verses, "cat", work="w", book="b", books=books).count()
    assert C.lookup(verses, "cat", []).count() == 121 and C.lookup(verses, "cat", ["cat"]).count() == 0


def test_replace_words_in_one_pass(spark):
    """As one substitution with the longest key first: what is written isn't read again."""
    from quire.functions import text as T

    rng = random.Random(6)
    pairs = {"a": "b", "b": "a", "to day": "today", "to": "of", "of": "to day", "shew-bread": "show$1", "shew": "sh\\\\ew", "don't": "do not", "é": "e", "été": "summer", "": "x", "x2": "2x", "of the": "the"}
    keys = sorted((k for k in pairs if k), key=len, reverse=True)
    texts = ["", None, "a", "to day of the to", "abba a-b é été'é", "shew-bread shew bread; don't don''t", "x2 x22 _a a_"]
    texts += ["".join(rng.choice(["a", "b", " ", "-", "to", "day", "of", "the", "shew", "bread", "'", "don't", "é", "x2", "\n", "é"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    want = [t if t is None else re.sub(r"\b(?:" + "|".join(map(re.escape, keys)) + r")\b", lambda m: pairs[m[0]], t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.replace_words(F.col("t"), pairs).alias("o")).orderBy("i").collect()
    assert [r.o for r in rows] == want


def test_ranges_of_lines(spark):
    lines = [(1, i, f"l{i}") for i in range(6)] + [(2, 0, "only")]
    changes = [(1, 4, 6, ["x"]), (1, 0, 1, ["a", "b", "c"]), (1, 2, 3, []), (2, 5, 7, ["beyond"]), (2, 0, 0, ["nothing"])]
    got = C.ranges_replaced(spark.createDataFrame(lines, "k int, i int, line string"), spark.createDataFrame(changes, "k int, first int, end int, lines array<string>"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "l1"), (1, 4, "l3"), (1, 5, "x"), (2, 0, "only")]


def test_speakers(spark):
    lines = ["Othin spake:", "", "  Hail ", "he spake so", "A spake:", "Bragi spake:", "x", "Last spake:"]
    row = spark.createDataFrame([(lines,), (None,), ([],)], "l array<string>").select(T.with_speakers(F.col("l")).alias("o")).collect()
    assert [r.o for r in row] == [["Othin: Hail", "he spake so", "Bragi: x"], None, []]


def test_many_small_chapters_are_few_tasks(spark, tmp_path):
    from quire.sources import corpus

    for work in ("v", "w"):
        (tmp_path / work / "chapters").mkdir(parents=True)
        for i in range(1200):
            (tmp_path / work / "chapters" / f"b-{i}.json").write_text(f'{{"name": "{work}{i}", "sections": []}}')
    (tmp_path / "w" / "chapters" / "b-1.txt").write_text("no chapter")
    rows = corpus.read_chapters(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= corpus.FEW_TASKS
    assert {(r.work_id, r.chapter_id, r.name) for r in rows.collect()} == {(w, f"b-{i}", f"{w}{i}") for w in "vw" for i in range(1200)}
