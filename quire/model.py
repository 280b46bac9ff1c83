"""Schemas of the corpus, and how the driver's documents stand for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAPTER = "name STRING, intro STRING, sections ARRAY<STRUCT<startVerse:INT, verses:ARRAY<STRING>>>"
MANIFEST = (
    "id STRING, title STRING, translations ARRAY<STRUCT<id:STRING,name:STRING,year:INT>>, "
    "books ARRAY<STRUCT<id:STRING,name:STRING,abbrev:STRING,chapters:INT,start:INT,names:ARRAY<STRING>>>"
)
VERSE_COLUMNS = ("work_id", "book_id", "chapter_id", "chapter_num", "section_idx", "verse_idx", "verse", "ref", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters_of(docs: DataFrame) -> DataFrame:
    """Documents as chapters: work = source, book = language, one section whose verses are the lines that are not blank."""
    verses = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.where("source IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("source").alias("work_id"),
        F.col("lang").alias("book_id"),
        F.concat_ws("-", "lang", "doc_id").alias("chapter_id"),
        F.col("doc_id").alias("chapter_num"),
        F.array(F.struct(F.lit(1).alias("startVerse"), verses.alias("verses"))).alias("sections"),
    )


def verses_of(chapters: DataFrame) -> DataFrame:
    """One row per verse; its number is the section's first number plus its place. Rows stay where they are: no shuffle."""
    keep = [c for c in ("work_id", "book_id", "chapter_id", "chapter_num") if c in chapters.columns]
    sections = chapters.select(*keep, F.posexplode("sections").alias("section_idx", "s"))
    rows = sections.select(*keep, "section_idx", F.col("s.startVerse").alias("first"), F.posexplode("s.verses").alias("verse_idx", "text"))
    rows = rows.withColumn("verse", F.col("first") + F.col("verse_idx")).drop("first")
    return rows.withColumn("ref", F.concat_ws(":", "work_id", "chapter_id", "verse")).select(*[c for c in VERSE_COLUMNS if c in (*keep, "section_idx", "verse_idx", "verse", "ref", "text")])


def document_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verses_of(chapters_of(table(spark, sf_dir, "documents")))
