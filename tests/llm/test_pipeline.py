"""The pipeline on small tables, each stage against its own rule."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quire.llm.common import with_place
from quire.llm.mixing import mix, root_weights
from tests.llm.brute import bytes_removed
from tests.llm.test_near import bag, overlap, union


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(100001, None, None, None, None), (100002, "", "en", "src0", 0), (100003, "12 34", "en", None, 5), (None, "the of and " * 30, None, "src1", 330)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 1"))
    assert [n for n, _ in P.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "mix_sources", "bpe_tokens"]
    seen = [docs.cache()]
    for name, stage in P.STAGES:
        seen.append(P.materialize(stage(spark, seen[-1], sf), name))
        if name != "bpe_tokens":
            assert seen[-1].columns == docs.columns
    start, lang, near, cut, mixed, tokens = ([tuple(r) for r in d.collect()] for d in seen)
    assert {r[0] for r in start} - {r[0] for r in lang} == {100001, 100002, 100003} and set(lang) <= set(start)
    # Near dedup: the representative of each class by brute force, and nothing else.
    bags = [bag(r[1]) for r in lang]
    root = union(len(lang), [(i, j) for i in range(len(lang)) for j in range(i) if overlap(bags[i], bags[j]) >= 0.8])
    big = 1 << 62
    least = {}
    for k, r in zip(root, lang, strict=True):
        least[k] = min(least.get(k, big), big if r[0] is None else r[0])
    assert sorted(big if r[0] is None else r[0] for r in near) == sorted(least.values()) and set(near) <= set(lang)
    want = {r[0]: r for r in bytes_removed([(r[0], r[1]) for r in near])}
    assert {r[0] for r in cut} == {i for i, r in want.items() if r[1] > r[2]}
    same = {r[0]: r for r in near}
    for r in cut:
        assert r[4] == len(r[1]) and (want[r[0]][2] > 0 or r[:4] == same[r[0]][:4])
    assert sorted(mixed, key=str) == sorted(cut, key=str)
    library = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert sorted((t[0], t[1]) for t in tokens if t[0]) == sorted((r[0], len(library.encode(r[1], add_special_tokens=False).ids)) for r in mixed if r[0])


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.where(F.col("n_tokens") > 0).count() > 50
    assert P.ORACLE_SQL is None


def in_files(spark, df, files):
    """``df``, by ``files`` tasks in its own order: Spark reads the larger files first."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", files)
    try:
        return P.materialize(df, "files")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tokens_follow_the_mix(spark):
    """The order of the mix is that of the result, for long texts too; another mix of the same documents gives another order."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 40 == 3, F.repeat(F.concat("text", F.lit(" ")), 70_000)).otherwise(F.col("text")).substr(1, 70_000))
    docs = P.materialize(docs, "docs")
    assert docs.where("length(text) = 70000").count() > 3
    orders = [[r.doc_id for r in mix(docs, w).orderBy("mix_position").collect()] for w in (None, root_weights(docs))]
    mixed = in_files(spark, P.mixing_stage(spark, docs, sf), 7)
    other = in_files(spark, mix(docs, root_weights(docs)).orderBy("mix_position").select(*docs.columns), 7)
    found = []
    for order, table in zip(orders, (mixed, other), strict=True):
        assert table.select(F.countDistinct("_metadata.file_name")).first()[0] == 7
        tokens = P.tokens_stage(spark, table, sf)
        found.append([tuple(r) for r in tokens.collect()])
        assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and [r[0] for r in found[-1]] == order
        written = with_place(in_files(spark, tokens, 5), "place").orderBy("place").drop("place")
        assert [tuple(r) for r in written.collect()] == found[-1]
    assert orders[0] != orders[1] and sorted(found[0]) == sorted(found[1])


def test_run_is_in_the_mix_order(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(P, "materialize", lambda df, name, f=P.materialize: made.setdefault(name, in_files(spark, df, 6) if name == "mix_sources" else f(df, name)))
    got = [r.doc_id for r in P.run(spark, "/root/testdata/sf0.001").collect()]
    assert got == [r.doc_id for r in mix(made["suffix_array_dedup"]).orderBy("mix_position").collect()] and len(got) > 50


def test_place_without_files(spark):
    rows = spark.range(40, numPartitions=4).select((39 - F.col("id")).alias("id"))
    assert [r.id for r in with_place(rows, "place").orderBy("place").collect()] == list(range(39, -1, -1))


@pytest.mark.parametrize("name", ["queries", "oracle_sql"])
def test_entry_without_this_subpackage(name, monkeypatch):
    import __spark_entry__ as entry

    full = set(getattr(entry, name)())
    monkeypatch.setattr(entry, "HAS_LLM", False)
    monkeypatch.setattr(entry, "HAS_PIPELINE", False)
    rest = set(getattr(entry, name)())
    assert rest and not any(x.startswith("op") or x == "pipeline" for x in rest) and rest <= full
