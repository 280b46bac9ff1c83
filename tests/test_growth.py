"""What must not grow with the input: partitions, batches and joins by few names; and single cases found on larger tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from quire import queries as Q
from quire.functions import text as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    """A folder whose documents are the given (doc_id, text)."""

    def made(*rows):
        docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return made


def test_first_upper_is_one_letter(spark, tables):
    """a letter whose capital Spark writes as two."""
    got = [r.out for r in Q.QUERIES["first_upper"](spark, tables((1, "ßheit"), (2, "ŉa"), (3, "éa"), (4, ""))).orderBy("doc_id").collect()]
    assert got == ["ẞheit", "ŉa", "Éa", ""]


def test_numbers_of_the_text_are_text(spark, tables):
    """lines that begin with a number and a point of their own."""
    rows = Q.QUERIES["segment_numbered"](spark, tables((1, "41.2.x\n7. b\n\\3. c 4.\n5. d\n6. e"))).orderBy("verse_idx").collect()
    assert [r.verse for r in rows] == ["41.2.x", "7. b \\3. c 4. 5. d", "6. e"]


def test_whole_texts_come_in_rows():
    """an Arrow batch of whole texts holds ten thousand of them."""
    from quire.sources.web import page_text

    assert all(f.evalType == PythonEvalType.SQL_BATCHED_UDF for f in (T.slugify, T.wrap, page_text))


def test_few_names_are_broadcast(spark, tmp_path):
    """the few names of a large table, which Spark takes for large, must not gather its lines by name."""
    from quire.plans import store

    spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("abbrev"), F.sha2(F.col("id").cast("string"), 512).alias("x")).write.parquet(f"{tmp_path}/t")
    names = spark.read.parquet(f"{tmp_path}/t").select("abbrev", F.lower("abbrev").alias("book_id")).distinct()
    most = store.SMALL
    store.SMALL = 5_000
    try:
        assert store.plan_bytes(names) > store.SMALL
        assert store.plan_bytes(store.small(names)) <= store.SMALL
        df = spark.range(3).select(F.lit("A").alias("abbrev")).join(store.small(names), "abbrev")
        assert "Broadcast" in plan(df) and df.count() == 3
    finally:
        store.SMALL = most


def test_words_are_counted_in_parts_of_the_texts(spark, tables, monkeypatch):
    """texts are dealt by chapter, in as many parts as their size asks for; their words do not travel."""
    from quire.operators import corpus as C

    sf = tables(*[(i, f"one two{i}\nthree one") for i in range(50)])
    monkeypatch.setattr(C, "WORD_BYTES", 100)
    parts = C.word_parts(Q.docs(spark, sf))
    assert parts > 4
    build = plan(Q.QUERIES["concordance_build"](spark, sf))
    assert build.count("Exchange hashpartitioning(work_id") == 1 and "hashpartitioning(word" not in build and f", {parts}), REPARTITION_BY_NUM" in build
    assert f", {parts}), REPARTITION_BY_NUM" in plan(C.weights(Q.chapters(spark, sf), []))


def test_headed_files_follow_from_the_size(spark, monkeypatch):
    """as many files as the texts' size asks for."""
    import glob

    from quire.plans import sorted as S

    monkeypatch.setattr(S, "FILE_BYTES", 20_000)
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir', '/nowhere')}/quire-*/files"))
    assert Q.QUERIES["headed_files"](spark, "/root/testdata/sf0.001").count() > 0
    new = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/quire-*/files")) - before
    assert len(glob.glob(f"{new.pop()}/part-*")) > 4


def test_volumes_are_dealt_in_parts(spark, monkeypatch):
    """F16: one shuffle by volume, in as many parts as the spans' size asks for."""
    from quire.operators import corpus as C

    monkeypatch.setattr(C, "WORD_BYTES", 2_000)
    found = Q.QUERIES["span_chapters"](spark, "/root/testdata/sf0.001")
    parts = C.word_parts(Q.docs(spark, "/root/testdata/sf0.001"))
    text = plan(found)
    assert parts > 4 and "REPARTITION_BY_NUM" in text and "hashpartitioning(doc#" in text and "nth" not in "".join(x.split(")")[0] for x in text.split("hashpartitioning(")[1:])


def test_strips_are_few(spark):
    """a chapter is written once for each strip, so a strip holds a good part of a gigabyte's vectors."""
    from quire.operators import corpus as C

    assert -(-(1 << 30) * 3 // C.STRIP_BYTES) <= 12


def test_vectors_are_not_shuffled(spark):
    """texts are dealt once in the order of chapters; their vectors are written once and read by the tasks, not sent to strips."""
    from quire.operators import corpus as C

    sf = "/root/testdata/sf0.001"
    made = plan(C.chapter_vectors(Q.chapters(spark, sf), []).sort(*C.CHAPTER_ORDER))
    assert made.count("rangepartitioning(work_id") == 1 and "hashpartitioning(work_id" not in made
    for name in ("chapter_similarity_top5", "related_by_work", "related_by_title"):
        text = plan(Q.QUERIES[name](spark, sf))
        assert "CartesianProduct" in text and "FlatMapGroupsInArrow" not in text and "Generate explode" not in text


def test_tasks_return_the_best_of_all_blocks(spark):
    """many small blocks in a task give no more rows than one, and the same best, with copies and ties in many books."""
    import random

    from quire.operators import corpus as C

    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = ["one", "passage", "again"] if i % 3 == 0 else [rng.choice([f"c{k}" for k in range(60)] + [f"r{k}" for k in range(3000)]) for _ in range(rng.randrange(1, 40))]
        rows.append((f"w{i % 4}", f"b{i % 5}", f"b-{rng.randrange(1000):03}-{i}", " ".join(words)))
    df = spark.createDataFrame(rows, "work_id string, book_id string, chapter_id string, t string").withColumn("sections", F.array(F.struct(F.lit(1).alias("startVerse"), F.array("t").alias("verses"))))
    vectors = C.chapter_vectors(df, [])
    got = [sorted(map(tuple, C.similar_chapters(vectors, block=n, strip_bytes=1 << 28).collect())) for n in (9, 64, 2048)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 900
    best = C._Best(2, 0.1, 5)
    for k in range(50):
        best.add(C.np.array([0, 1]), C.np.array([k, 99 - k]), C.np.array([0.5, 0.2 + k / 1000]))
    assert best.y[best.x == 0].tolist() == [0, 1, 2, 3, 4] and best.y[best.x == 1].tolist() == [50, 51, 52, 53, 54]
