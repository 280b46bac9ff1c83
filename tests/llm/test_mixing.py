from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing


def earliest_deadline(weights, blocks):
    """Slot by slot: of the blocks released (else of all), the one due first."""
    total, done, order = sum(weights.values()), Counter(), []
    for t in range(sum(blocks.values())):
        left = [(done[s] * total // w > t, -(-(done[s] + 1) * total // w), s) for s, w in sorted(weights.items()) if done[s] < blocks[s]]
        order.append((min(left)[2], done[min(left)[2]]))
        done[order[-1][0]] += 1
    return order


WEIGHTS = [{"a": 1}, {"a": 1, "b": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 10_000, "b": 10_000, "c": 10_000, "d": 1}, {"a": 9, "b": 2, "c": 1, "d": 53}, {f"s{i:02d}": 1 + i % 3 for i in range(13)}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_schedule(spark, weights):
    total = sum(weights.values())
    slots = 10 * total if total < 100 else 40_000
    blocks = {s: max(1, slots * w // total) for s, w in weights.items()}
    table = spark.createDataFrame([(0, s, w, 5 * blocks[s] - 1) for s, w in weights.items()], "part int, __q_source string, weight long, rows long")
    rows = sorted(mixing.schedule(table, 5).collect(), key=lambda r: r["slot"])
    got = [(r["__q_source"], r["i"]) for r in rows]
    assert rows[-1]["before"] == sum(5 * blocks[s] - 1 for s in weights) - 4 and rows[1 % len(rows)]["before"] in (0, 4, 5)
    assert got == earliest_deadline(weights, blocks)
    done = Counter()
    for t, (s, i) in enumerate(got[: slots - len(weights)], 1):
        assert i == done[s]
        done[s] += 1
        assert all(abs(done[x] * total - w * t) < total for x, w in weights.items())


def test_weights(spark):
    of = lambda rows: {r["__q_source"]: r["weight"] for r in mixing.whole_weights(spark.createDataFrame(rows, "__q_source string, weight double")).collect()}
    assert of([("a", 3.0), ("b", 4.0), ("c", 0.0), ("d", -1.0), ("e", None), ("f", float("nan")), ("g", float("inf"))]) == {"a": 3, "b": 4}
    third = of([("a", 1 / 3), ("b", 1 / 3), ("c", 1 / 3), ("d", 1e-300)])
    assert third["a"] == third["b"] == third["c"] and third["d"] == 1
    assert of([("a", 0.0)]) == {} and of([("a", 2.0**60), ("b", 2.0**60)]) == {"a": mixing.PARTS // 2, "b": mixing.PARTS // 2}


def test_mix(spark):
    sources = ["a"] * 500 + ["b"] * 120 + [None] * 61 + ["c"] * 90
    rows = [(i, s, "t", 1) for i, s in enumerate(sources)] + [(0, "a", "t", 1), (None, "b", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_block int")
    df = df.withColumnRenamed("mix_block", "slot")
    weights = spark.createDataFrame([("a", 4.0), ("b", 2.0), (None, 1.0), ("c", 0.7)], "source string, weight double")
    out = mixing.mix(df, weights, block=4)
    got = out.collect()
    assert out.columns == ["doc_id", "source", "text", "slot", "mix_position", "mix_block", "in_mix"]
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(rows, key=str)
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    mixed = sorted((r for r in got if r.in_mix), key=lambda r: r.mix_position)
    assert [r.mix_position for r in mixed] == list(range(len(mixed)))
    # The first source that is used up by its weight ends the mix.
    end = min(Fraction(n) / Fraction(w) for n, w in ((501, 4.0), (121, 2.0), (61, 1.0), (90, 0.7)))
    assert Counter(r.source for r in mixed) == {s: int(end * Fraction(w)) for s, w in (("a", 4.0), ("b", 2.0), (None, 1.0), ("c", 0.7))}
    share = {"a": 4.0, "b": 2.0, None: 1.0, "c": 0.7}
    by_block = {}
    for r in mixed:
        by_block.setdefault(r.mix_block, set()).add(r.source)
    assert sorted(by_block) == list(range(len(by_block))) and all(len(x) == 1 for x in by_block.values())
    done = Counter()
    for n in range(len(by_block) - 4):
        done[next(iter(by_block[n]))] += 1
        assert all(abs(done[s] - w * (n + 1) / 7.7) < 1 for s, w in share.items())
    again = {(r.doc_id, r.source, r.text, r.mix_position) for r in mixing.mix(df.repartition(7), weights, block=4).collect()}
    assert again == {(r.doc_id, r.source, r.text, r.mix_position) for r in got}
    assert mixing.mix(df.limit(0)).count() == 0
    part = mixing.mix(df, weights.where("source = 'a'"), block=4)
    assert part.where("mix_position IS NULL AND NOT in_mix").count() == len(rows) - 501
    none = mixing.mix(df, weights.where("source = 'no'"), block=4)
    assert none.where("mix_position IS NULL AND mix_block IS NULL AND NOT in_mix").count() == len(rows)


def test_default_weights_and_no_python(spark):
    sizes = {"hot": 500, **{f"s{i}": 70 + i for i in range(7)}, "stray": 5, None: 1, "small": 37}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    out = mixing.mix(spark.createDataFrame(rows, "source string, doc_id long"))
    assert "Python" not in out._jdf.queryExecution().toString()
    got = sorted(out.collect(), key=lambda r: r.mix_position)
    assert all(r.in_mix for r in got) and [r.mix_position for r in got] == list(range(len(rows)))
    blocks = Counter(r.mix_block for r in got)
    assert sorted(blocks) == list(range(len(blocks))) and max(blocks.values()) == mixing.BLOCK
    have = Counter()
    for n, r in enumerate(got, 1):
        have[r.source] += 1
        # A row's own block may be placed in part, and each source's last block is short.
        assert all(abs(have[s] - k * n / len(rows)) < 2 * mixing.BLOCK for s, k in sizes.items())


def test_larger_blocks(spark):
    rows = [(i, f"s{i % 3}") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), slots=30).collect()
    assert set(Counter(r.mix_block for r in got).values()) == {30}


@pytest.mark.parametrize("weights", [WEIGHTS[4], {**{f"b{i}": 300 for i in range(3)}, **{f"r{i:02d}": 5 for i in range(20)}}])
@pytest.mark.parametrize("uneven", [False, True])
def test_stretches(spark, weights, uneven):
    """A schedule in stretches of 111 slots is that of one line, also where sources end long before the others."""
    total = sum(weights.values())
    blocks = {s: max(1, 400 * w // total) * (1 + 2 * uneven * (k % 3)) for k, (s, w) in enumerate(weights.items())}
    table = spark.createDataFrame([(0, s, w, 5 * blocks[s] - 1) for s, w in weights.items()], "part int, __q_source string, weight long, rows long")
    rows = sorted(mixing.schedule(table, 5, 111).collect(), key=lambda r: r["slot"])
    assert [(r["__q_source"], r["i"]) for r in rows] == earliest_deadline(weights, blocks)
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    full = [5 - (r["i"] == blocks[r["__q_source"]] - 1) for r in rows]
    assert [r["before"] for r in rows] == [sum(full[:k]) for k in range(len(full))]


def test_blocks_do_not_grow(spark):
    """A corpus of over 65,536 blocks has blocks of eight rows as any other."""
    rows = spark.range(600_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    got = mixing.mix(rows)
    assert [tuple(r) for r in got.groupBy("mix_block").count().groupBy("count").count().collect()] == [(8, 75_000)]
    first = got.where("mix_block < 9").select("mix_block", "source").distinct().orderBy("mix_block").collect()
    assert [r.source for r in first] == ["s0", "s1", "s2"] * 3
    assert got.agg(F.min("mix_position"), F.max("mix_position"), F.count_distinct("mix_position")).first()[:] == (0, 599_999, 600_000)
    assert got.where("mix_position div 8 <> mix_block").count() == 0


def test_default_weights_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")).collect(), key=lambda r: r.mix_position)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(map(tuple, docs))
    sizes = Counter(r.source for r in docs)
    blocks = {s: -(-n // mixing.BLOCK) for s, n in sizes.items()}
    order = earliest_deadline(dict(sizes), blocks)
    assert [r.mix_position for r in got] == list(range(len(docs)))
    at = {}
    for r in got:
        assert at.setdefault(r.mix_block, r.source) == r.source and r.in_mix
    assert [at[k] for k in range(len(order))] == [s for s, _ in order]


def test_query(spark):
    """The roots of the sources' characters as targets: both parts of the mix, slot by slot."""
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = table.select("doc_id", "source")
    got = sorted(mixing.op6_mix_sources(spark, sf).collect(), key=lambda r: r.mix_position)
    assert sorted((r.doc_id, r.source) for r in got) == sorted(map(tuple, docs.collect()))
    sizes = Counter(r.source for r in got)
    weights = mixing.root_weights(table).select(mixing.source_key(F.col("source")).alias("__q_source"), "weight")
    whole = {r["__q_source"].removeprefix("="): r["weight"] for r in mixing.whole_weights(weights).collect()}
    chars = Counter()
    for r in table.select("source", "n_chars").collect():
        chars[r.source] += r.n_chars
    assert all(abs(whole[s] / sum(whole.values()) - n**0.5 / sum(x**0.5 for x in chars.values())) < 1e-9 for s, n in chars.items())
    first = min(sizes, key=lambda s: Fraction(sizes[s], whole[s]))
    admitted = {s: min(n, whole[s] * sizes[first] // whole[first]) for s, n in sizes.items()}
    assert Counter(r.source for r in got if r.in_mix) == admitted and 0 < sum(admitted.values()) < len(got)
    assert [r.in_mix for r in got] == sorted((r.in_mix for r in got), reverse=True)
    want = []
    for part in (admitted, {s: n - admitted[s] for s, n in sizes.items()}):
        blocks = {s: -(-n // mixing.BLOCK) for s, n in part.items() if n}
        done = Counter()
        for s, i in earliest_deadline({s: whole[s] for s in blocks}, blocks):
            want += [s] * min(mixing.BLOCK, part[s] - done[s])
            done[s] += mixing.BLOCK
    assert [r.source for r in got] == want
    assert "Python" not in mixing.op6_mix_sources(spark, sf)._jdf.queryExecution().toString()
