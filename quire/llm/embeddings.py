"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its ``NEAREST`` closest pivots, in order. An inverted list for each label and pivot holds the
vectors that name it; two vectors that share at least ``SHARED`` pivots are candidates, and the cosine decides. A pair is
judged only in the list of its first shared pivot, so it counts once. The number of pivots grows with the root of the
number of vectors, so lists do too. A list of over ``LIST`` vectors is split by the second shared pivot: a vector goes to a
list for each other pivot that it names. What is still long is dealt over tiles of ``TILE`` vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import NULL_ID, hot_lookup, materialize
from quire.llm.components import components

COSINE = 0.98
#: Fewest and most pivots that are asked for (four times the root of the number of vectors between them), named pivots
#: of a vector, pivots that candidates share.
PIVOTS, MOST_PIVOTS, NEAREST, SHARED = 256, 2048, 10, 2
#: Vectors for each pivot that pivots are chosen from (the bound of the fitting sample). Pivots that are chosen even if they
#: are alike: any two choices of 10 among 24 share 2 with a chance of 0.99.
POOL, LEAST_PIVOTS = 16, 24
#: Bytes of that pool, and of all pivots, at most (but never fewer than 1,024 vectors and ``PIVOTS`` pivots).
POOL_BYTES, PIVOT_BYTES = 64 << 20, 16 << 20
TILE, LIST = 512, 4096


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(embedding: str, label: str):
    """Rows that can link: a label, and a vector that is neither null nor zero nor holds null or non-finite components."""
    e = F.col(embedding)
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  NaN is larger than infinity
    return F.coalesce(F.col(label).isNotNull() & e.isNotNull() & F.forall(e, finite) & F.exists(e, lambda x: x != 0), F.lit(False))


def choose_pivots(rows: DataFrame, count: int = PIVOTS, cosine: float = COSINE) -> np.ndarray:
    """At most ``count`` unit vectors of the commonest length that are far from one another.

    Of ``POOL * count`` vectors whose bytes hash smallest (copies count once), each next pivot is the one farthest from those
    chosen, until all are so near to one that both may link to a third. So a dense group has one pivot that all its members
    name, instead of many about equally far ones; its size has no influence.
    """
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0))
    room = 8 * max(1, sizes[0]["d"])
    count = min(count, max(PIVOTS, PIVOT_BYTES // room))
    found = rows.where(F.size("vec") == sizes[0]["d"]).select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(min(POOL * count, max(1024, POOL_BYTES // room))).collect()
    pool = _unit(np.array([r["vec"] for r in found], float))
    chosen, near = [0], pool @ pool[0]
    while len(chosen) < min(count, len(pool)):
        far = int(np.argmin(near))
        if len(chosen) >= LEAST_PIVOTS and near[far] >= 2 * cosine**2 - 1:
            break
        near[far] = np.inf
        chosen.append(far)
        near = np.maximum(near, pool @ pool[far])
    return pool[chosen]


def links_and_classes(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` for each row of ``vectors``.

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least ``cosine``.
    Null, zero and non-finite vectors link with nothing, nor do vectors of different lengths. Equal vectors of one
    label are indexed once and counted as often as they occur. ``component_id`` is the smallest id that links reach. Ids name
    vectors: rows with one id are one node. A null id comes after all others and is a null ``component_id`` alone. Links are
    found if the vectors share ``shared`` of their ``nearest`` pivots (recall is measured in the tests).
    """
    base = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(embedding_col).cast("array<double>").alias("vec"), usable(embedding_col, label_col).alias("ok"))
    good = base.where("ok")
    pivots = pivots or max(PIVOTS, min(MOST_PIVOTS, 4 * math.isqrt(good.count())))
    reference = choose_pivots(good, pivots, cosine)
    single = vectors.schema[embedding_col].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64  # as they came; the cosine is computed in double precision

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, rows = batch.column(1).to_pylist(), batch.column(2)
            data = [np.asarray(rows[i].values, float) for i in range(len(rows))]
            blobs = [d.astype(kind).tobytes() for d in data]
            keys = [hashlib.blake2b(b + b"|" + lab.encode(), digest_size=16).digest() for b, lab in zip(blobs, labels, strict=True)]
            fits = np.array([len(d) == reference.shape[1] for d in data], bool)
            perms: list[list[int]] = [[0] for _ in data]
            if fits.any():
                near = _unit(np.stack([d for d, f in zip(data, fits, strict=True) if f])) @ reference.T
                for i, p in zip(np.flatnonzero(fits).tolist(), np.argsort(-near, axis=1, kind="stable")[:, :nearest].tolist(), strict=True):
                    perms[i] = p
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary()), pa.array(perms, pa.list_(pa.int32()))], names=["id", "label", "key", "vec", "perm"])

    described = materialize(good.select("id", "label", "vec").mapInArrow(describe, "id long, label string, key binary, vec binary, perm array<int>"), "described")
    nodes = materialize(described.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.first("perm").alias("perm")), "nodes")
    need = min(shared, nearest, max(1, len(reference)))

    # Lists by label and pivot, long ones by label and two pivots; a list's vectors are dealt into tiles, and tiles meet pairwise.
    post = nodes.select("rep", "n", "vec", "perm", "label", F.explode("perm").alias("pivot"))
    counts = post.groupBy("label", "pivot").agg(F.count("*").alias("size")).where("size > 1")
    post = post.join(counts, ["label", "pivot"])
    splits = (F.col("size") > LIST) & (F.size("perm") > 1) & F.lit(need > 1)
    seconds = F.when(splits, F.filter("perm", lambda q: q > F.col("pivot"))).otherwise(F.array(F.lit(-1)))
    post = post.withColumn("second", F.explode(seconds)).drop("size")
    sizes = post.groupBy("label", "pivot", "second").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select("label", "pivot", "second", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    dealt = post.join(sizes, ["label", "pivot", "second"]).withColumn("tile", F.pmod(F.xxhash64("rep", "vec"), F.col("tiles")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    dealt = dealt.withColumn("m", F.explode(meets)).select("label", "pivot", "second", "m.i", "m.j", "tile", "rep", "n", "vec", "perm")

    def judge(t: pa.Table) -> pa.Table:
        pivot, second, i, j = (t.column(c)[0].as_py() for c in ("pivot", "second", "i", "j"))
        tile = t.column("tile").to_numpy()
        rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
        blobs, perms = t.column("vec").to_pylist(), t.column("perm").to_pylist()
        count, edges = np.zeros(len(rep), np.int64), []
        length = np.array([len(b) for b in blobs])
        for size in np.unique(length):
            at = np.flatnonzero(length == size)
            unit = _unit(np.stack([np.frombuffer(blobs[k], kind) for k in at]).astype(float))
            named = np.zeros((len(at), pivots), np.float32)
            for r, k in enumerate(at):
                named[r, perms[k]] = 1
            a, b = np.flatnonzero(tile[at] == i), np.flatnonzero(tile[at] == j)
            want = need if named.sum(axis=1).max() > 1 else 1
            before = [*range(pivot), *range(pivot + 1, second)]  # pivots that would come first, if they were shared
            near = (named[a] @ named[b].T >= want) & (named[a][:, before] @ named[b][:, before].T == 0)
            r, c = np.nonzero(near if i != j else np.triu(near, 1))
            for s in range(0, len(r), 1 << 16):
                ra, cb = a[r[s : s + (1 << 16)]], b[c[s : s + (1 << 16)]]
                hit = np.einsum("ij,ij->i", unit[ra], unit[cb]) >= cosine
                x, y = at[ra[hit]], at[cb[hit]]
                np.add.at(count, x, n[y])
                np.add.at(count, y, n[x])
                edges.append((x, y))
        x, y = (np.concatenate([e[k] for e in edges]) if edges else np.empty(0, np.int64) for k in (0, 1))
        root = np.arange(len(rep))
        while len(x):  # the tile's own components: a star each instead of all its links
            least = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, least)
            np.minimum.at(root, y, least)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero((count > 0) | (root != np.arange(len(rep))))
        return pa.table({"rep": rep[some], "links": count[some], "root": rep[root[some]]})

    found = materialize(dealt.groupBy("label", "pivot", "second", "i", "j").applyInArrow(judge, "rep long, links long, root long"), "found")
    roots = components(found.select("rep", "root"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = hot_lookup(described.select("id", "key"), named, "key", "n").select("id", "n_links", "component_id")
    out = out.unionByName(base.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    real = lambda c: F.when(F.col(c) != int(NULL_ID), F.col(c))
    return out.select(real("id").alias(id_col), "n_links", real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_and_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
