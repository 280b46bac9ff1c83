"""Corpus folders: manifests and chapter files as JSON, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.model import CHAPTER, MANIFEST
from quire.plans.store import source_bytes

#: Bytes of chapter files that a task reads, about, and tasks that read the files of a small corpus.
TASK_BYTES, FEW_TASKS = 8 << 20, 64


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each book: ``work_id``, ``title``, ``book_ord``, ``book_id``, ``name``, ``abbrev``, ``chapters``, ``start``, ``names``."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{folder}/*/manifest.json")
    dirs = rows.select("*", F.regexp_extract(F.input_file_name(), r"([^/]+)/manifest\.json$", 1).alias("dir"))
    books = dirs.select(F.col("id").alias("work_id"), "dir", "title", "translations", F.posexplode_outer("books").alias("book_ord", "b"))
    return books.select("work_id", "dir", "title", "translations", "book_ord", F.col("b.id").alias("book_id"), F.col("b.name").alias("book_name"), F.col("b.abbrev").alias("abbrev"), F.col("b.chapters").alias("chapters"), F.coalesce("b.start", F.lit(1)).alias("start"), F.col("b.names").alias("names"))


def read_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each chapter file; work and chapter are the folder's and the file's names, the book is what precedes the last hyphen."""
    # Works' folders are listed whole: of a pattern for files Spark would look up each match by itself, and list it again.
    rows = spark.read.schema(CHAPTER).option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{folder}/*/chapters")
    path = r"([^/]+)/chapters/([^/]+)\.json$"
    # Spark deals some thirty files to a task, however small they are.
    rows = rows.select("*", F.input_file_name().alias("f")).coalesce(max(FEW_TASKS, source_bytes(rows) // TASK_BYTES))
    rows = rows.select(F.regexp_extract("f", path, 1).alias("work_id"), F.regexp_extract("f", path, 2).alias("chapter_id"), "name", "intro", "sections")
    return rows.select("work_id", F.regexp_extract("chapter_id", "^(.*)-[^-]*$", 1).alias("book_id"), "chapter_id", F.regexp_extract("chapter_id", r"(\d+)$", 1).try_cast("long").alias("chapter_num"), "name", "intro", "sections")


def write_chapters(chapters: DataFrame, folder: str) -> None:
    """Chapters as JSON lines in a folder for each work; null fields are left out."""
    chapters.write.partitionBy("work_id").json(folder)


def work_mismatches(manifests: DataFrame) -> DataFrame:
    """Manifests whose id is not their folder's name."""
    return manifests.where("work_id <> dir").select(F.concat("dir", F.lit(": id is "), "work_id").alias("message")).distinct()


def front_matter(lines: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``value`` of lines ``key: value`` (cut at the first colon), and rows with a null value for required keys that lack."""
    pairs = lines.where(F.instr("value", ":") > 0).select(F.trim(F.substring_index("value", ":", 1)).alias("key"), F.trim(F.regexp_replace("value", "^[^:]*:", "")).alias("value"))
    if not required:
        return pairs
    wanted = lines.sparkSession.createDataFrame([(k,) for k in required], "key string")
    return pairs.unionByName(wanted.join(pairs.select("key"), "key", "left_anti").withColumn("value", F.lit(None).cast("string")))
