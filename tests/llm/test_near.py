import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import embeddings, minhash
from quire.llm.components import components
from tests.llm.brute import WORD


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = union(600, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def overlap(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 0.0


def corpus():
    rng = random.Random(11)
    vocab = ["w%d" % i for i in range(400)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    docs = []
    for _ in range(12):
        t = text(rng.randint(60, 200))
        docs.append(" ".join(t))
        for _ in range(rng.randint(0, 6)):
            u = list(t)
            for _ in range(rng.randint(0, 5)):
                u[rng.randrange(len(u))] = rng.choice(vocab)
            docs.append(rng.choice([" ", "\n", "  "]).join(u))
    docs += ["a b", "a  b", "a", "a b c d e", "a b c d e f", None, "", " \n", "x y z " * 300, "x y z " * 290, "x y z " * 100]
    rows = [(i * 7 % 1009, t, 1) for i, t in enumerate(docs)] + [(None, docs[0], 1), (None, "only null id here", 1), (0, docs[0], 1)]
    return rows


def classes_of(rows):
    """(id, class id, kept) of each row by direct definition; null ids come last."""
    big = 1 << 62
    bags = [bag(t) for _, t in rows]
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if overlap(bags[i], bags[j]) >= 0.8])
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, big), big if i is None else i)
    return sorted([(i, None if least[r] == big else least[r], (big if i is None else i) == least[r]) for r, (i, _) in zip(root, rows, strict=True)], key=str)


@pytest.mark.parametrize("tile", [256, 3])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, class_id int")).collect()
    assert sorted(map(tuple, got), key=str) == classes_of([r[:2] for r in rows])


def test_ids_with_several_texts(spark):
    rng = random.Random(3)
    text = lambda: [rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(80)]
    t, v, u = text(), text(), text()
    near = t[:-1] + ["other"]
    rows = [(1, " ".join(t)), (7, " ".join(near)), (7, " ".join(v)), (None, " ".join(near[1:])), (None, " ".join(u)), (None, " ".join(u)), (None, None), (3, None), (3, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, lang int")
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str) == classes_of(rows)
    kept = sorted(map(tuple, minhash.representatives(docs).collect()), key=str)
    assert kept == sorted([(*rows[k], k) for k in (0, 2, 4, 6, 7, 8)], key=str)


def test_many_alike_below_the_threshold(spark):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(64)]
    docs = [" ".join(passage + [f"t{d}x{i}" for i in range(20)]) for d in range(500)]
    docs += [docs[3] + " end", docs[400] + " end here", " ".join(docs[77].split()[2:])]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == classes_of(rows)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert embeddings.links_and_classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    x = np.arange(60, dtype=np.uint64) + np.uint64(1000)
    wa, wb = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    doc = np.repeat([0, 1], 60)
    w = np.concatenate((wa, wb))
    keep = w > 0
    sig = minhash.signatures(doc[keep], np.concatenate((x, x))[keep], w[keep], 2, 4096)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_similarities():
    rows = [t for _, t, _ in corpus() if t]
    left, right = rows, rows[3:] + rows[:3]
    got = minhash.similarities([t.encode() for t in left], [t.encode() for t in right])
    assert np.allclose(got, [overlap(bag(a), bag(b)) for a, b in zip(left, right)])
    long = ["word%d " % (i % 700) * 40000 for i in range(5)]
    got = minhash.similarities([t.encode() for t in long], [t.encode() for t in long[::-1]])
    assert np.allclose(got, [0, 0, 1, 0, 0])


def brute(rows, cosine=0.98):
    ok = [lab is not None and e is not None and all(v is not None and np.isfinite(v) for v in e) and any(e) for _, e, lab in rows]
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if o else None for o, (_, e, _) in zip(ok, rows)]
    return {(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine}


def cases():
    rng = np.random.default_rng(3)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = []
    for c in range(20):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), f(centre + rng.normal(size=16) * 0.12), c % 3))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, rows[0][1], 9), (1003, None, 1), (1004, [0.0] * 16, 1), (1005, [float("nan")] * 16, 1), (1006, [None] * 16, 1), (1007, rows[5][1], None), (1008, [], 1), (1009, f(np.array(rows[0][1]) * 2), rows[0][2]), (1010, [1.0, 2.0], 1), (1011, [2.0, 4.0], 1), (1012, [float("inf")] + [1.0] * 15, 1)]
    return rows


@pytest.mark.parametrize("tile,longest", [(512, 4096), (7, 4096), (7, 20)])
def test_embeddings(spark, monkeypatch, tile, longest):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "LIST", longest)
    rows = cases()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.links_and_classes(df).collect()}
    pairs = brute(rows)
    root = union(len(rows), pairs)
    links = Counter(x for p in pairs for x in p)
    want = {r[0]: (links[k], rows[root[k]][0], rows[root[k]][0] == r[0]) for k, r in enumerate(rows)}
    assert set(got) == set(want)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1:] == want[k][1:] for k in want) >= 0.95 * len(want)


def test_recall_on_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(8)
    for i, e, lab in rows[::5]:
        for k in range(3):
            noisy = np.array(e) + rng.normal(size=len(e)) * np.linalg.norm(e) * 0.02
            rows.append((10_000 + 3 * i + k, [float(np.float32(x)) for x in noisy], lab))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.links_and_classes(df).collect()
    pairs = brute(rows)
    assert len(got) == len(rows) and 2 * len(pairs) >= sum(r.n_links for r in got) >= 0.97 * 2 * len(pairs) > 500


@pytest.mark.parametrize("hot,others", [(1000, 500), (1200, 0)])
def test_recall_in_a_hot_group(spark, hot, others):
    rng = np.random.default_rng(5)
    centre, groups = rng.normal(size=64), np.repeat(rng.normal(size=(others, 64)), 4, axis=0)
    vectors = np.concatenate((centre + rng.normal(size=(hot, 64)) * 0.1, groups + rng.normal(size=groups.shape) * 0.1)).astype(np.float32)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>, label int")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = np.array([r.n_links for r in sorted(embeddings.links_and_classes(df).collect(), key=lambda r: r.vec_id)])
    assert len(got) == len(want) and (got <= want).all()
    assert want[:hot].sum() > 100_000 and got.sum() >= 0.97 * want.sum()


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    rng = random.Random(4)
    docs = []
    for c in range(12):
        passage = [f"p{c}x{i}" for i in range(80)]
        for d in range(30):
            docs.append(" ".join(passage + [f"t{c}x{d}x{i}" for i in range(rng.randint(6, 13 + c // 2))]))
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == classes_of(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = minhash.op10_minhash(spark, sf)
    assert got.columns == ["doc_id", "class_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == classes_of(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_embedding_query(spark, sf):
    sf = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    pairs = blockwise(rows)
    got = {r.vec_id: r for r in embeddings.op5_embedding_dedup(spark, sf).collect()}
    root = union(len(rows), pairs)
    links = Counter(x for p in pairs for x in p)
    assert len(got) == len(rows) and all(got[r[0]].n_links <= links[k] for k, r in enumerate(rows))
    assert sum(r.n_links for r in got.values()) >= 0.98 * 2 * len(pairs)
    assert sum(got[r[0]].component_id == rows[root[k]][0] for k, r in enumerate(rows)) >= 0.98 * len(rows)


def blockwise(rows, cosine=0.98):
    """Linked pairs of a table without odd vectors, a thousand rows against all at a time."""
    label = np.array([r[2] for r in rows])
    vec = np.array([r[1] for r in rows], float)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    out = []
    for a in range(0, len(rows), 1000):
        x, y = np.nonzero((unit[a : a + 1000] @ unit.T >= cosine) & (label[a : a + 1000, None] == label))
        out += [(i + a, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if i + a > j]
    return out
