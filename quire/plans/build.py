"""A corpus folder from chapters and books, and the indexes built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.model import verses_of
from quire.operators import corpus as C
from quire.plans.store import materialize, small
from quire.sources.folders import FORMAT, register


def manifests(works: DataFrame, books: DataFrame) -> DataFrame:
    """One manifest for each work as ``work_id`` and ``json``; null fields are left out, books stand in their order.

    ``works`` has work_id and title, ``books`` work_id, book_ord, book_id, name, abbrev, chapters, start and names.
    """
    book = F.struct(F.col("book_id").alias("id"), "name", "abbrev", "chapters", "start", "names")
    lists = books.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("book_ord", book.alias("b")))).alias("l"))
    rows = works.join(lists, "work_id", "left")
    listed = F.coalesce(F.transform("l", lambda x: x["b"]), F.array().cast(f"array<{_BOOK}>"))
    return rows.select("work_id", F.to_json(F.struct(F.col("work_id").alias("id"), "title", listed.alias("books"))).alias("json"))


_BOOK = "struct<id:string,name:string,abbrev:string,chapters:bigint,start:bigint,names:array<string>>"


def chapter_files(chapters: DataFrame) -> DataFrame:
    """``work_id``, ``chapter_id`` and ``json`` of each chapter; a null name or introduction is left out."""
    fields = [c for c in ("name", "intro") if c in chapters.columns]
    return chapters.select("work_id", "chapter_id", F.to_json(F.struct(*fields, "sections")).alias("json"))


def write_corpus(works: DataFrame, books: DataFrame, chapters: DataFrame, folder: str) -> None:
    """Each work's ``manifest.json`` and ``chapters/<chapter_id>.json``, as ``quire.sources.corpus`` reads them, and the list of works.

    The works appear all together when every file is written; a work that was there before is replaced.
    """
    spark = works.sparkSession
    register(spark)
    rows = manifests(works, books).select("work_id", F.lit(None).cast("string").alias("chapter_id"), "json").unionByName(chapter_files(chapters))
    # One work's files come from many tasks; rows are dealt by both, so that no work is one task's.
    rows.repartition("work_id", "chapter_id").write.format(FORMAT).mode("overwrite").save(folder)
    works.select("work_id").orderBy("work_id").write.mode("overwrite").json(f"{folder}/works")


def corpus_module(manifests: DataFrame) -> DataFrame:
    """``work_id`` and ``json`` of all manifests for a site; a manifest whose id is not its folder's name (``dir``) is an error."""
    wrong = F.concat(F.lit("manifest of "), "dir", F.lit(" has the id "), F.coalesce("work_id", F.lit("null")))
    checked = F.when(F.col("work_id").eqNullSafe(F.col("dir")), F.col("json")).otherwise(F.raise_error(wrong).cast("string"))
    return manifests.select("dir", checked.alias("json")).withColumnRenamed("dir", "work_id")


def work_text(spark: SparkSession, folder: str, work: str) -> DataFrame:
    """The lines of one work's text, as ``quire.sources.tagged.write`` left them: only that work's files are read."""
    return spark.read.text(folder).where(F.col("work_id") == work).select("value")


def works_list(spark: SparkSession, folder: str) -> DataFrame:
    """``work_id`` of the works listed in a folder."""
    return spark.read.schema("work_id string").json(f"{folder}/works")


def missing_works_list(spark: SparkSession, folder: str) -> DataFrame:
    """One ``message`` if the folder has no list of works, else none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/works")
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.createDataFrame([] if there else [("works: list missing",)], "message string")


def build_indexes(chapters: DataFrame, stopwords: list[str], folder: str) -> dict[str, int]:
    """The flat index, the concordance as ``stored_lookup`` reads it and the similar chapters, written to ``folder``; rows of each."""
    verses = materialize(verses_of(chapters), "verses")
    verses.select("ref", "text", *C.INDEX_ORDER).sort(*C.INDEX_ORDER).write.mode("overwrite").parquet(f"{folder}/search")
    C.write_index(verses, stopwords, f"{folder}/concordance")
    C.similar_chapters(C.chapter_vectors(chapters, stopwords)).write.mode("overwrite").parquet(f"{folder}/similarity")
    return {name.split("/")[0]: chapters.sparkSession.read.parquet(f"{folder}/{name}").count() for name in ("search", "concordance/words/data", "similarity")}


def split_works(chapters: DataFrame, members: DataFrame) -> DataFrame:
    """Chapters under the works that claim them: ``members`` has ``work_id`` and ``chapter_id``.

    A work that names no chapter (a null ``chapter_id``) gets all of them; a chapter that no work claims is left out.
    """
    own = members.where("chapter_id IS NOT NULL").join(chapters.drop("work_id"), "chapter_id")
    whole = members.where("chapter_id IS NULL").select("work_id").distinct()
    every = chapters.drop("work_id").crossJoin(small(whole))
    return own.unionByName(every.select(*own.columns)).select("work_id", *[c for c in own.columns if c != "work_id"])
