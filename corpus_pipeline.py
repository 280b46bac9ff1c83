"""A corpus from raw documents: language ID, near-dedup, substring dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import DIGESTS, digests, encode_documents
from quire.llm.common import compact, materialize, with_place
from quire.llm.langid import UNKNOWN, identify, learn
from quire.llm.minhash import representatives
from quire.llm.mixing import mix
from quire.llm.suffix_array import dedup_bytes

#: Phrases for each symbol above which no known language explains a text.
MOST_PHRASES = 0.6


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach; texts that are null, without letters or foreign go."""
    found = identify(docs, learn(docs))
    return compact(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("phrase_rate") <= MOST_PHRASES)).select(*docs.columns), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: its representative, the text with the smallest id."""
    return compact(representatives(docs), docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings of earlier ones; a character that is cut goes whole.

    ``n_chars`` follows the text. A document of which nothing is left goes.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = dedup_bytes(docs, keep=others, as_text=True).withColumnRenamed("kept", "text")
    out = out.where(F.length("text") > 0).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
    return compact(out, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix's order: after any number of blocks each source has its target share to within a block.

    The targets are the sources' sizes, so they leave no clean document out.
    """
    mixed = mix(docs).where("in_mix")
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: how many, the digest of their ids, and of the text that they decode to, in the mix's order.

    That is the order in which the rows of ``docs`` were written. It is restored once the tokens are written, so that texts are
    neither dealt again nor encoded twice.
    """
    tokens = materialize(encode_documents(with_place(docs, "__q_place"), digests, DIGESTS, keep=("__q_place",)), "tokens")
    return tokens.orderBy("__q_place").drop("__q_place")


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", substring_stage),
    ("mix_sources", mixing_stage),
    ("bpe_tokens", tokens_stage),
]

#: Language models, signatures and tokens are beyond SQL; the tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
