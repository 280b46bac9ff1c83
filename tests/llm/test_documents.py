"""Language ID and quality rules on small documents."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import langid, quality
from quire.llm.sample import held_out, labelled_sample

SF = "/root/testdata/sf0.001"


def phrases(train, text):
    """Greedy longest matches, by definition."""
    i = n = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


def test_phrase_counts():
    texts = {"aa": "the cat sat on the mat and the dog ran", "bb": "le chat est sur la table et le chien", "cc": "ο σκύλος και η γάτα στο χαλί"}
    m = langid.Automata(texts)
    asked = ["the dog sat", "le chien est", "zzz", "", "a", "the thé ¡! mat", "the cat " * 30, "dog" * 400, "γάτα, σκύλος", "日本語 the", "ο" * 50, "q" * 40 + " the cat", "the cat and the dog " * 20 + "z"]
    symbols = [m.symbols(t)[0] for t in asked]
    want = [[phrases("".join(chr(65 + s) for s in m.symbols(texts[lang])[0]), "".join(chr(65 + x) if x else "?" for x in s)) for lang in m.langs] for s in symbols]
    for segment in (1, 2, 3, 7, 50, 8192):
        assert m.phrases(symbols, segment).tolist() == want, segment


def test_scripts_do_not_crowd_one_another_out():
    latin = {f"l{i}": "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(3000)) for i in range(8)}
    greek = {"el": "η γλώσσα και το κείμενο " * 40, "ru": "язык и текст " * 40, "ja": "日本語の文章です。" * 40}
    m = langid.Automata(latin | greek)
    for lang, text in (("el", "το κείμενο και η γλώσσα"), ("ru", "текст и язык"), ("ja", "文章の日本語")):
        cost = m.phrases([m.symbols(text)[0]])[0] * np.array(m.bits)
        assert m.langs[cost.argmin()] == lang


def test_very_long_texts_and_many_labels(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} common words " * 30, f"lang{i % 90:02d}") for i in range(360)]
    rows.append((1000, "wab common words " * 40_000, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    learned = {lang for i, _, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model) == learned and len(learned) > 64 and sum(map(len, model.values())) <= 2 * langid.ALL_BYTES
    got = {r.doc_id: r for r in langid.identify(df.where("doc_id = 1000"), model).collect()}
    assert got[1000].lang_pred in learned and 0 <= got[1000].score <= 1


def test_identify(spark):
    docs = [(i, t, lang, 0.5) for i, (t, lang) in enumerate([("the cat and the dog sat on the mat " * 4, "en"), ("le chat et le chien sont sur la table " * 4, "fr")] * 12)]
    docs += [(100, None, "en", 0.0), (101, "", None, 0.0), (102, "123 !? \n", "en", 0.0), (103, "the dog sat", None, 0.0), (None, "le chien", "xx", 0.0), (103, "the dog sat", None, 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    model = langid.learn(df)
    assert set(model) == {"en", "fr"} and all(len(t) <= 2 * langid.BYTES for t in model.values())
    got = langid.identify(df, model).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert [by[100, None].lang_pred, by[101, ""].lang_pred, by[102, "123 !? \n"].lang_pred] == ["und"] * 3
    assert by[103, "the dog sat"].lang_pred == "en" and by[None, "le chien"].lang_pred == "fr"
    assert langid.identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}


def test_held_out_accuracy_and_no_leak(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    test = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out) and len(out) == len(lang)
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.97 * len(test)
    changed = docs.withColumn("text", __import__("pyspark.sql.functions", fromlist=["x"]).expr("CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'x' ELSE text END"))
    assert langid.learn(changed) == langid.learn(docs)


def test_sample_is_bounded(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t ', id) AS text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE concat('b', id % 5) END AS lang")
    got = labelled_sample(df, 10, 4, usable=~held_out("doc_id")).collect()
    assert Counter(r["__q_lang"] for r in got) == {k: 10 for k in ("a", "b0", "b1", "b2", "b3", "b4")}
    again = labelled_sample(df.repartition(9), 10, 4, usable=~held_out("doc_id")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and max(len(r["__q_sample"]) for r in got) <= 4


WORD = re.compile("[^\x20\x09-\x0d]+")


def counters(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed


def test_base_rules(spark):
    texts = [None, "", " \n\t", "a b", "a b c a b c", "x " * 60, " ".join(f"w{i}" for i in range(80)), "l\nl\n \nl\r\nl", "#*$%&|<> " * 9, "\xa0\x85 é\U0001f600", " ".join(f"w{i % 70}" for i in range(9000)), "a b c d " * 3 + " ".join(map(str, range(100)))]
    df = spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(texts)] + [(None, "q", None, 7)], "doc_id long, text string, lang string, n_words int")
    refs = quality.references(df)
    rows = quality.judge(df, refs).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counters(r.text)
        assert not (r.base_failed and r.kept)
    assert len(rows) == len(texts) + 1 and quality.judge(df.limit(0), refs).count() == 0


def test_divergence_keeps_prose_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op9_quality_rules(spark, sf)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    rows = {r.doc_id: r for r in out.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    long = [i for i in labels if not rows[i].base_failed]
    good = [i for i in long if labels[i] == 1]
    assert sum(rows[i].kept for i in good) >= 0.99 * len(good)
    bad = [i for i in long if labels[i] == 0 and rows[i].n_words >= 100]
    assert sum(not rows[i].kept for i in bad) >= 0.5 * len(bad) > 0


@pytest.mark.parametrize("p,q,want", [([1.0, 0.0], [0.0, 1.0], 1.0), ([0.5, 0.5], [0.5, 0.5], 0.0), ([0.0, 0.0], [0.0, 0.0], 0.0)])
def test_jensen_shannon(spark, p, q, want):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality.jensen_shannon(F.col("p"), F.col("q"))).first()[0]
    assert abs(got - want) < 1e-9


def test_words_of_another_language_and_no_common_words(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", F.length("text").alias("n_chars"))
    refs = spark.createDataFrame(quality.references(docs).collect(), quality.references(docs).schema)
    good = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id").where("lang = 'en' AND n_chars < 3000")
    judged = lambda d: [r for r in quality.judge(d, refs).collect() if not r.base_failed and r.js_words is not None]
    own, wrong = judged(good), judged(good.withColumn("lang", F.lit("es")))
    assert len(own) == len(wrong) > 20
    assert sum(r.kept for r in own) >= 0.98 * len(own) and sum(not r.kept for r in wrong) >= 0.9 * len(wrong)
    none = spark.createDataFrame([(n, " ".join(f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}rd" for i in range(n)), lang) for n in (100, 150, 600) for lang in ("en", "es", "fr", "de")], "doc_id long, text string, lang string")
    got = judged(none)
    assert not any(r.kept for r in got) and len(got) == 12


def distance(p, q):
    """Jensen-Shannon distance by definition."""
    kl = lambda a, m: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return max(0.0, (kl(p, m) + kl(q, m)) / 2) ** 0.5


def test_quality_query_by_definition(spark):
    """The verdict of every document: distances and limits computed again from the references."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    refs = {r["__q_lang"]: r for r in quality.references(docs.select("doc_id", "text", "lang")).collect()}
    rows = {r.doc_id: r for r in quality.op9_quality_rules(spark, SF).collect()}
    judged = 0
    for d in docs.collect():
        r, t, ref = rows[d.doc_id], d.text or "", refs.get(d.lang)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counters(t)
        words, near = WORD.findall(t), True
        if ref and len(t) >= quality.LEAST_CHARS:
            kinds = [sum(c.isalpha() for c in t), sum(c in " \t\n\x0b\x0c\r" for c in t), sum(c in "0123456789" for c in t), sum(c in "#*$%&|<>" for c in t)]
            p = [x / len(t) for x in (*kinds, len(t) - sum(kinds))]
            assert abs(r.js_classes - distance(p, ref["__q_ref_classes"])) < 1e-6
            near &= r.js_classes <= quality.MOST_CLASSES
        else:
            assert r.js_classes is None
        if ref and len(words) >= quality.LEAST_WORDS:
            rest = lambda a: [*a, max(0.0, 1 - sum(a))]
            shares, none = rest([words.count(w) / len(words) for w in ref["__q_ref_words"]]), rest([0.0] * len(ref["__q_ref_words"]))
            own = rest(ref["__q_ref_shares"])
            assert abs(r.js_words - distance(shares, own)) < 1e-6
            near &= r.js_words <= min(quality.MOST_WORDS + quality.SHORT / len(words) ** 0.5, quality.REACH * distance(none, own))
            judged += 1
        else:
            assert r.js_words is None
        assert r.kept == (not r.base_failed and near)
    assert judged > 50


def test_language_query_by_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    m = langid.Automata(model)
    train = {k: "".join(chr(65 + s) for s in m.symbols(t)[0]) for k, t in model.items()}
    got = {r.doc_id: r for r in langid.op7_language_id(spark, SF).collect()}
    some = [d for d in docs.collect() if d.text and len(d.text) < 900][:40]
    for d in some:
        s = m.symbols(d.text)[0]
        text = "".join(chr(65 + x) if x else "?" for x in s)
        cost = [phrases(train[k], text) * b / max(1, len(s)) for k, b in zip(m.langs, m.bits, strict=True)]
        order = np.argsort(cost, kind="stable")
        assert got[d.doc_id].lang_pred == m.langs[order[0]]
        assert abs(got[d.doc_id].score - (1 - cost[order[0]] / cost[order[1]])) < 1e-9
    assert len(some) == 40


def test_quality_of_clashing_columns_ties_and_many_languages(spark):
    text = " ".join(f"the w{i % 37} of w{i % 11}x{i}" for i in range(60))
    rows = [(i, text, f"l{i % 80:02d}", "x", True, 1.0) for i in range(160)] + [(7, text, "l07", "x", True, 1.0), (None, text, None, None, None, None), (900, "", "l01", "y", False, 2.0), (901, "word " * 200_000, "l02", "y", False, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, js_classes string, kept boolean, js_words double")
    refs = quality.references(df)
    assert refs.count() == 80
    got = quality.judge(df, refs).collect()
    assert len(got) == len(rows) and all(r.kept == (not r.base_failed) for r in got if r.text == text)
    same = {(r.lang, r.js_classes, r.js_words, r.kept) for r in got if r.doc_id == 7}
    assert len(same) == 1 and {r.doc_id: r.js_words for r in got}[None] is None
    long = next(r for r in got if r.doc_id == 901)
    assert (long.n_words, long.n_repeat_words, long.base_failed, long.kept) == (200_000, 200_000, True, False)


def test_references_count_every_labelled_row(spark):
    """Over 300 rows of a language, a text of over 20,000 characters, and rows without an id: all of them count, whole."""
    texts = [f"one w{i % 7} {'12' * (i % 3)}" for i in range(700)] + ["late " * 5000 + "end"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "one #%", "en"), (3, "again", "en"), (4, None, "en"), (5, "none", None), (6, "", "leer")]
    refs = {r["__q_lang"]: r for r in quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).collect()}
    text = [t for _, t, lang in rows if lang == "en" and t]
    words = Counter(w for t in text for w in WORD.findall(t))
    best = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
    assert list(refs) == ["en"] and refs["en"]["__q_ref_words"] == [w for w, _ in best]
    assert all(abs(x - n / sum(words.values())) < 1e-12 for x, (_, n) in zip(refs["en"]["__q_ref_shares"], best, strict=True))
    whole = "".join(text)
    kinds = [sum(c.isalpha() for c in whole), whole.count(" "), sum(c.isdigit() for c in whole), sum(c in "#*$%&|<>" for c in whole), 0]
    assert all(abs(x - n / len(whole)) < 1e-12 for x, n in zip(refs["en"]["__q_ref_classes"], kinds, strict=True))
