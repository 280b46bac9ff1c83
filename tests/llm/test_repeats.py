import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import repeats, substring_dedup, suffix_array
from quire.llm.repeats import by_prefix
from quire.llm.substring_dedup import dedup_words, deep_nodes, op2_substring_dedup, tree_classes
from quire.llm.suffix_array import dedup_bytes, op3_suffix_array_dedup
from tests.llm.brute import bytes_removed, words_removed

SCHEMA = "doc_id long, text string, kept string, __q_extra int"
key = lambda r: tuple((x is None, x) for x in r)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "straße", "and", "x" * 30] + ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(k))
    passages = [text(k) for k in (9, 12, 50, 55, 70, 200)]
    docs = []
    for i in range(n):
        t = text(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(passages)[rng.randint(0, 9) :] + text(rng.randint(0, 40))
        docs.append((i * 3 % 101, t))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (None, "a"), (300, None), (301, ""), (302, "a" * 400), (303, "b" + "a" * 399), (304, "ab " * 300), (305, "w " * 49), (306, "w " * 50)]
    docs.append((307, text(5000) + passages[-1]))
    return docs


@pytest.mark.parametrize("hot", [1024, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], SCHEMA).repartition(5)
    sha = F.sha2("kept", 256)
    got = dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", sha).collect()
    assert sorted(map(tuple, got), key=key) == sorted(bytes_removed(docs), key=key)
    got = dedup_words(df).select("doc_id", "n_words", "n_removed", sha).collect()
    assert sorted(map(tuple, got), key=key) == sorted(words_removed(docs), key=key)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup_bytes(df).count() == 0 and dedup_words(df).count() == 0


def test_prefix_groups_of_any_size():
    words = ["a", "b"]
    rng = random.Random(5)
    contents = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(50)]
    text = np.frombuffer("".join(contents).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(c) for c in contents])
    windows = np.array([12 - 5 + 1] * 50)
    split = lambda most: tree_classes(5, most)(text, offsets, windows, np.zeros(50))
    a, b = split(1), split(10**6)
    want = [" ".join(c.split()[j : j + 5]) for c in contents for j in range(8)]
    for got in (a, b):
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_queries_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op3_suffix_array_dedup(spark, sf).collect())) == sorted(bytes_removed(docs))
    assert sorted(map(tuple, op2_substring_dedup(spark, sf).collect())) == sorted(words_removed(docs))


def test_deep_nodes():
    left, right = deep_nodes(np.array([3, 5, 6, 2, 7, 1]), 5)
    assert list(zip(left.tolist(), right.tolist())) == [(1, 4), (4, 6)]
    assert deep_nodes(np.empty(0, int), 5)[0].size == 0


def test_every_window_passes_the_resolver(spark, monkeypatch, tmp_path):
    passage = " ".join(f"w{i}" for i in range(80))
    docs = [(i, passage + f" own{i}") for i in range(40)] + [(99, "alone " * 3)]
    folder, real = str(tmp_path), suffix_array.radix_classes

    def counting(window):
        inner = real(window)

        def resolve(text, offsets, windows, group):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(int(windows.sum())))
            return inner(text, offsets, windows, group)

        return resolve

    monkeypatch.setattr(suffix_array, "radix_classes", counting)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(bytes_removed(docs))
    # Each window of the passage once for a bin at most, however many of a block's documents have it.
    seen = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert len(passage) - 49 <= seen <= 4 * (len(passage) + 60 * 40)


def test_cut_characters(spark):
    same = "é" * 40
    docs = [(1, "x" + same), (2, "zé" + same + "\ufffdend"), (3, "\u00e8\u00e8" + "ab" * 25), (4, "\u00e9\u00e8" + "ab" * 25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_bytes(df, as_text=True).collect()}
    want = {r[0]: r for r in bytes_removed(docs)}
    assert {i: (r.n_removed, r.n_spans) for i, r in got.items()} == {i: want[i][2:4] for i in want}
    assert got[1].kept == docs[0][1] and got[2].kept == "z\ufffdend" and got[4].kept == "\u00e9"


@pytest.mark.parametrize("module,name,dedup", [(suffix_array, "radix_classes", "dedup_bytes"), (substring_dedup, "tree_classes", "dedup_words")])
def test_nothing_else_finds_repeats(spark, monkeypatch, module, name, dedup):
    """With a resolver for which all is different nothing is removed: neither within a block of documents nor between blocks."""

    class Different:
        def __call__(self, text, offsets, windows, group):
            return np.arange(int(windows.sum()))

        def same(self, content, starts, lengths, group):
            return np.arange(len(starts))

    passage = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(i, f"own{i} {passage} more{i}" if i % 3 else passage) for i in range(90)], "doc_id long, text string")
    assert getattr(module, dedup)(df).agg(F.sum("n_removed")).first()[0] > 5000
    monkeypatch.setattr(module, name, lambda *a: Different())
    assert getattr(module, dedup)(df).agg(F.sum("n_removed")).first()[0] == 0


def test_by_prefix():
    rng = np.random.default_rng(1)
    base = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(1, 30, 300)]
    runs_ = base + base[:100] + [b"x" * 500, b"x" * 499 + b"y", b"x" * 500, b"", b"", b"a\0", b"a"]
    group = np.array([len(r) % 2 for r in runs_])
    lengths = np.array([len(r) for r in runs_])
    starts = np.cumsum(lengths) - lengths
    got = by_prefix(np.frombuffer(b"".join(runs_), np.uint8), starts, lengths, group)
    want = list(zip(group.tolist(), runs_, strict=True))
    assert (got >= 0).all() and len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))
    assert len(by_prefix(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))) == 0
