"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import FEW, discard, files_for, materialize

#: More steps than any graph of 2**60 nodes needs; reaching it is an error, not a result.
STEPS = 120
#: Edges of a written partition, about; small graphs are not spread over every shuffle partition.
EDGES = 200_000


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node that links reach) for each node of ``links`` (two long columns).

    Each half step writes its edges to the shared folder, so no plan grows with the steps. A node with very many neighbours
    is aggregated map-side; the join that hands out its smallest neighbour is one that Spark splits at run time. Nodes without links do not appear; order and repeats of links don't matter.
    """
    a, b = links.columns[:2]
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", files_for(links.count(), EDGES, FEW))
    last, parts = None, max(1, edges.count() // EDGES)
    for _ in range(STEPS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct().coalesce(2 * parts + 4), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        old, edges = edges, materialize(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct().coalesce(2 * parts + 4), "edges")
        discard(old, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
