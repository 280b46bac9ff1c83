"""Bounded samples of labelled documents, the same rows whatever the order of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import FEW, materialize

#: Labels that may be learned, the bound of any model: the most frequent ones, should there be more.
LANGS = 4096
SALTS = 64


def held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, per_lang: int, chars: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None) -> DataFrame:
    """At most ``per_lang`` ids of each of the ``LANGS`` most frequent labels, with the first ``chars`` characters of their texts.

    Ids are ranked by a hash, first within one of ``SALTS`` parts of a label, so that no task sees all rows of a label; only
    ids travel, and the chosen ones (a table of known size) fetch their texts. Columns: ``__q_lang``, ``__q_rank``,
    ``__q_sample``. Null ids, labels and texts are never chosen; of rows with one id, one text (the smallest) is taken.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    ids = rows.select(F.col(id_col).alias("__q_id"), F.col(lang_col).alias("__q_lang")).withColumn("__q_h", F.xxhash64(F.lit(17), "__q_id"))
    langs = ids.groupBy("__q_lang").count().orderBy(F.desc("count"), "__q_lang").limit(LANGS).select("__q_lang")
    near = Window.partitionBy("__q_lang", "__q_salt").orderBy("__q_h", "__q_id")
    far = Window.partitionBy("__q_lang").orderBy("__q_h", "__q_id")
    some = ids.withColumn("__q_salt", F.pmod("__q_h", F.lit(SALTS))).withColumn("__q_rank", F.row_number().over(near)).where(F.col("__q_rank") <= per_lang)
    chosen = some.join(langs, "__q_lang").withColumn("__q_rank", F.row_number().over(far)).where(F.col("__q_rank") <= per_lang)
    chosen = materialize(chosen.groupBy("__q_id", "__q_lang").agg(F.min("__q_rank").alias("__q_rank")), "chosen", FEW)
    texts = rows.select(F.col(id_col).alias("__q_id"), F.col(lang_col).alias("__q_lang"), F.substring(text_col, 1, chars).alias("__q_sample"))
    return texts.join(chosen, ["__q_id", "__q_lang"]).groupBy("__q_lang", "__q_rank").agg(F.min("__q_sample").alias("__q_sample"))
