"""Centroid clustering by weighted deduplication: Lloyd's rounds on distinct quantised vectors with their multiplicities.

Components become whole numbers, equal vectors become one row with a weight, and each round sees distinct vectors only. A
task assigns its vectors and adds them up, weighted, cluster by cluster, so a round sends one row a cluster and task and
brings the driver one row a cluster. All sums are exact. The clusters of distinct vectors are joined back to all ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import FEW, compact, discard, hot_lookup, materialize

CLUSTERS, ROUNDS, SCALE, LENGTH, SEED = 40, 5, 256, 64, 2
#: Components whose squares and sums of squares double precision holds exactly.
EXACT = 1 << 21
#: A component's whole number is below this in size, so that a long holds it.
LARGEST = 1 << 62
LONG = (1 << 63) - 1


def usable(embedding: Column, length: int = LENGTH, scale: int = SCALE) -> Column:
    """Vectors of ``length`` components, none null or non-finite, each a long after scaling."""
    fits = lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < F.lit(float(LARGEST)))  # noqa: E731  NaN is larger than any number
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) == length) & F.forall(embedding, fits), F.lit(False))


def packed(numbers: np.ndarray) -> list[bytes]:
    """Each row of whole numbers as bytes: 16 bits a number if all of the row's fit, else 64. Equal rows give equal bytes."""
    small = (np.abs(numbers) < 1 << 15).all(axis=1)
    narrow = numbers.astype("<i2")
    return [narrow[i].tobytes() if s else numbers[i].astype("<i8").tobytes() for i, s in enumerate(small.tolist())]


def unpacked(keys: list[bytes], length: int) -> np.ndarray:
    """The rows that ``packed`` gave, as longs."""
    if all(len(k) == 2 * length for k in keys):
        return np.frombuffer(b"".join(keys), "<i2").reshape(-1, length).astype(np.int64)
    return np.stack([np.frombuffer(k, "<i2" if len(k) == 2 * length else "<i8").astype(np.int64) for k in keys])


def nearest(numbers: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the smaller number on ties) and the squared distance, exact at any size."""
    large = max(int(np.abs(numbers).max(initial=0)), max(abs(x) for c in centroids for x in c))
    if large <= EXACT:
        rows, cents = numbers.astype(float), np.array(centroids, float)
        far = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ cents.T) + (cents * cents).sum(axis=1)[None, :]
    else:
        rows = numbers.astype(object)
        far = np.stack([((rows - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = np.argmin(far, axis=1)
    return best, far[np.arange(len(best)), best]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def cluster(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` for each vector that is kept.

    A vector is kept if it has exactly ``length`` components, none null, non-finite or 2**62 or more in size after scaling; other
    rows give no row. Its whole numbers are floor(``scale`` * x). Centroids start as the vectors of the ``clusters`` smallest
    sha256 of ``seed:id``, in that order; rows with one id come in order of their packed bytes, null ids last, and if there are
    fewer vectors there are fewer centroids (equal ones keep their own numbers; the later one is empty and stays). Each
    round assigns every vector to the nearest centroid, the smaller number on ties, and moves centroids that are not empty to
    floor(sum / count); then vectors are assigned once more. ``distance`` is squared; distances and sums that no long holds
    are the largest long. Repeated rows count, and come out, as often as they occur. An empty table gives an empty one; other
    columns are ignored.
    """

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(np.floor(values * scale).astype(np.int64)), pa.binary())], names=["id", "key"])

    good = vectors.where(usable(F.col(embedding_col), length, scale)).select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).cast("array<double>").alias("v"))
    rows = materialize(good.mapInArrow(quantise, "id long, key binary"), "quantised")
    distinct = materialize(compact(rows.groupBy("key").agg(F.count("*").alias("n")), rows), "distinct")

    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("id").asc_nulls_last(), "key"]
    first = rows.orderBy(*order).limit(clusters).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = unpacked([bytes(r["key"]) for r in first], length).tolist()
    sums = [F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(length)]

    def step(centroids: list[list[int]]) -> list[list[int]]:
        """One round: each task's weighted sums by cluster, added up in Spark; the driver gets one row a cluster."""

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [[0] * length for _ in centroids]
            count = [0] * len(centroids)
            for batch in _batches(batches):
                numbers, weight = unpacked(batch.column(0).to_pylist(), length), batch.column(1).to_numpy()
                at = nearest(numbers, centroids)[0]
                small = int(np.abs(numbers).max(initial=0)) * int(weight.sum()) < 1 << 62
                weighted = numbers * weight[:, None] if small else numbers.astype(object) * weight.astype(object)[:, None]
                for c in np.unique(at).tolist():
                    mine = at == c
                    total[c] = [a + int(b) for a, b in zip(total[c], weighted[mine].sum(axis=0).tolist(), strict=True)]
                    count[c] += int(weight[mine].sum())
            some = [c for c, n in enumerate(count) if n]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([count[c] for c in some], pa.int64()), pa.array([total[c] for c in some], pa.list_(kind))], names=["cluster", "n", "sums"])

        moved = distinct.mapInArrow(added, "cluster int, n long, sums array<decimal(38,0)>").groupBy("cluster").agg(F.sum("n").alias("n"), *sums)
        after = list(centroids)
        for r in moved.collect():  # one row a cluster
            after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(length)]
        return after

    for _ in range(rounds):
        centroids = step(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            at, far = nearest(unpacked(batch.column(0).to_pylist(), length), centroids)
            far = [min(int(x), LONG) for x in far.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(far, pa.int64())], names=["key", "n", "cluster", "distance"])

    placed = materialize(distinct.mapInArrow(assigned, "key binary, n long, cluster int, distance long"), "placed")
    discard(distinct)
    names = vectors.sparkSession.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    whole = F.col("distance").cast("decimal(38,0)") * F.col("n")
    capped = lambda x: F.least(x, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    # One row a cluster: small whatever the input.
    per = materialize(placed.groupBy("cluster").agg(F.sum(whole).cast("decimal(38,0)").alias("c")).join(F.broadcast(names), "cluster"), "inertia", FEW)
    per = per.crossJoin(F.broadcast(per.agg(F.sum("c").cast("decimal(38,0)").alias("a")))).select("cluster", capped(F.col("c")).alias("cluster_inertia"), capped(F.col("a")).alias("inertia"), "centroid_sha256")
    out = hot_lookup(rows, placed, "key", "n").join(F.broadcast(per), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
