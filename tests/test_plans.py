"""Sorted tables with pruned lookups, and tables in versions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.operators import corpus as C
from quire.operators import reader as R
from quire.plans import versions as V
from quire.plans.sorted import looked_up, write_sorted


def test_lookups_open_the_files_that_hold_the_word(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(f"w{i:04}", i) for i in range(500)] + [("hot", i) for i in range(400)] + [(None, 1)]
    write_sorted(spark.createDataFrame(rows, "word string, n int").repartition(5), ["word", "n"], folder, files=16)
    every = spark.read.parquet(f"{folder}/data")
    assert every.count() == len(rows) and len(every.inputFiles()) > 10
    one = looked_up(spark, folder, "word", "w0123")
    assert [tuple(r) for r in one.collect()] == [("w0123", 123)] and len(one.inputFiles()) <= 2
    hot = looked_up(spark, folder, "word", "hot")  # a word of many files is found in all of them
    assert hot.count() == 400 and 5 < len(hot.inputFiles()) < len(every.inputFiles())
    assert sorted(r.n for r in looked_up(spark, folder, "word", "w0001", "w0499", "zz").collect()) == [1, 499]
    assert looked_up(spark, folder, "word", "zzz").count() == 0 and looked_up(spark, folder, "word", "").count() == 0


def test_stored_concordance(spark, tmp_path):
    rows = [(f"w{i % 3}", "b", f"b-{i}", i, [(1, ["the cat sat", "a dog" if i % 2 else "a cat's cat"])]) for i in range(60)]
    chapters = spark.createDataFrame(rows, "work_id string, book_id string, chapter_id string, chapter_num int, sections array<struct<startVerse:int,verses:array<string>>>")
    from quire.model import verses_of

    verses = verses_of(chapters)
    C.write_index(verses, ["the"], str(tmp_path), files=4)
    for word in ("cat", "dog", "cat's", "the", "none"):
        hits = C.lookup(verses, word, ["the"])
        want = [(r.ref, r.text) for r in hits.orderBy(*C.INDEX_ORDER).limit(5).collect()]
        got = C.stored_lookup(spark, str(tmp_path), word).collect()
        assert [(r.ref, r.text) for r in got] == want and {r.verse_count for r in got} == ({hits.count()} if want else set())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "store")
    mk = lambda rows: spark.createDataFrame(rows, "user_id long, ref string, text string")
    first = [(u, f"r{k}", f"t{u}-{k}") for u in range(50) for k in range(3)] + [(7, f"many{k}", "x") for k in range(300)]
    assert V.create(mk(first), folder, "user_id", 16) == 1
    assert rows_of(V.read(spark, folder)) == sorted(first)
    with pytest.raises(ValueError):
        V.create(mk(first), folder, "user_id", 16)
    before = {str(f) for f in tmp_path.rglob("*.parquet")}
    new = [(3, "r1", "new"), (99, "r", "other")]
    assert V.change(mk(new), folder, lambda old, inc: R.upsert(old, inc, "user_id")) == 2
    want = sorted([r for r in first if r[0] != 3] + new)
    assert rows_of(V.read(spark, folder)) == want and rows_of(V.read(spark, folder, 1)) == sorted(first)
    # Only the two users' buckets are written again.
    written = [f for f in tmp_path.rglob("*.parquet") if str(f) not in before]
    assert 1 <= len({f.parent.name for f in written}) <= 2 and before <= {str(f) for f in tmp_path.rglob("*.parquet")}
    # A job that fails leaves the table, and so does one that makes other users' rows.
    broken = lambda old, inc: old.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException):
        V.change(mk([(3, "a", "b")]), folder, broken)
    with pytest.raises(ValueError, match="does not name"):
        V.change(mk([(3, "a", "b")]), folder, lambda old, inc: old.unionByName(mk([(u, "x", "y") for u in range(100, 160)])))
    assert V.versions(spark, folder) == [1, 2] and rows_of(V.read(spark, folder)) == want
    assert V.change(mk([]), folder, lambda old, inc: old) == 2
    # All rows of the touched buckets may go.
    assert V.change(mk([(7, "", "")]), folder, lambda old, inc: old.join(inc.select("user_id"), "user_id", "left_anti")) == 3
    want = [r for r in want if r[0] != 7]
    assert rows_of(V.read(spark, folder)) == want
    # Two changes at once: the later one is merged on top of the earlier.
    state = {"done": False}

    def slow(old, inc):
        if not state["done"]:
            state["done"] = True
            V.change(mk([(3, "between", "x")]), folder, lambda o, i: o.unionByName(i))
        return old.unionByName(inc)

    assert V.change(mk([(3, "after", "y")]), folder, slow) == 5
    assert rows_of(V.read(spark, folder)) == sorted([*want, (3, "between", "x"), (3, "after", "y")])
    now = rows_of(V.read(spark, folder))
    assert V.forget(spark, folder, before=5) >= 3 and V.versions(spark, folder) == [5] and rows_of(V.read(spark, folder)) == now
    with pytest.raises(ValueError):
        V.read(spark, folder, 1)
