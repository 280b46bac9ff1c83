"""Clusters against plain Lloyd rounds on whole numbers."""

import hashlib
import math
import random

import numpy as np

from quire.llm.centroids import LONG, cluster, packed, unpacked


def plain(rows, length, clusters, rounds=5, scale=256):
    """[(id, cluster, distance, cluster inertia, inertia, digest)] with Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) and abs(x * scale) < 2.0**62 for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, packed(np.array([r[1]]))[0])
    cents = [q for _, q in sorted(kept, key=key)[:clusters]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    for _ in range(rounds):
        mine = [min(range(len(cents)), key=lambda k: (far(q, cents[k]), k)) for _, q in kept]
        cents = [[sum(x) // len(x) for x in zip(*[q for (_, q), m in zip(kept, mine, strict=True) if m == k], strict=True)] if k in mine else c for k, c in enumerate(cents)]
    last = [min((far(q, c), k) for k, c in enumerate(cents)) for _, q in kept]
    total = {k: sum(d for d, m in last if m == k) for k in range(len(cents))}
    cap = lambda x: min(x, LONG)
    return [(i, k, cap(d), cap(sum(cap(e) for e, m in last if m == k)) if d >= LONG else cap(total[k]), cap(sum(cap(e) for e, _ in last)), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, last, strict=True)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ties_copies_and_hot_vectors(spark):
    rng = random.Random(4)
    few = [[rng.choice([-0.5, -0.004, 0.0, 0.25, 1.0]) for _ in range(4)] for _ in range(25)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)] + [(i, rng.choice(few)) for i in range(200, 400)] + [(i, few[0]) for i in range(400, 600)]
    rows += rows[:30]
    got = rows_of(cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), length=4, clusters=7))
    single = [(i, [struct_float(x) for x in v]) for i, v in rows]
    assert got == sorted(plain(single, 4, 7), key=repr)


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-inf, 0.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [0.5, 0.5]), (None, [0.25, -0.5]),
        (10, [1e6, -1e6]), (10, [3.0, 4.0]), (11, [-1e-9, 0.0]), (12, [1e30, 0.0]), (13, [2.0**40, -(2.0**41)]), (14, [2.0**40, -(2.0**41)]),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, key string")
    for k in (2, 3, 40):
        assert rows_of(cluster(df, length=2, clusters=k)) == sorted(plain(rows, 2, k), key=repr)
    out = cluster(df.limit(0))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(df.where("vec_id = 2")).count() == 0


def test_distances_beyond_a_long(spark):
    rows = [(i, [s * 2.0**52, 0.0]) for i, s in enumerate((1, -1, 0.5))]
    got = rows_of(cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), length=2, clusters=1))
    assert [r[2] for r in got] == [r[2] for r in sorted(plain(rows, 2, 1), key=repr)]
    assert all(r[4] == LONG for r in got)


def test_packing_of_numbers():
    q = np.array([[1, -2], [1 << 40, 3], [-(1 << 15), 0], [32767, -32767]])
    keys = packed(q)
    assert [len(k) for k in keys] == [4, 16, 16, 4] and unpacked(keys, 2).tolist() == q.tolist()
