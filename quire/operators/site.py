"""What a site is made of: its addresses, sitemap, robots file, and structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.corpus import expand_books


def site_urls(books: DataFrame, origin: str) -> DataFrame:
    """``loc``, ``changefreq`` and ``priority`` of the site, its works and their chapters."""
    home = books.sparkSession.range(1).select(F.lit(f"{origin}/").alias("loc"), F.lit("monthly").alias("changefreq"), F.lit("1.0").alias("priority"))
    works = books.select(F.concat(F.lit(f"{origin}/"), "work_id").alias("loc")).distinct().select("loc", F.lit("monthly"), F.lit("0.8"))
    pages = expand_books(books).select(F.concat(F.lit(f"{origin}/"), "work_id", F.lit("/"), "chapter_id"), F.lit("yearly"), F.lit("0.6"))
    return home.unionAll(works).unionAll(pages)


def sitemap_lines(urls: DataFrame) -> DataFrame:
    e = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    return urls.select(F.concat(F.lit("<url>"), e("loc", F.col("loc")), e("changefreq", F.col("changefreq")), e("priority", F.col("priority")), F.lit("</url>")).alias("value"))


def robots(origin: str) -> str:
    return f"User-agent: *\nAllow: /\n\nSitemap: {origin}/sitemap.xml\n"


def open_search(origin: str, name: str, description: str) -> str:
    """The document by which a browser learns to search the site."""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    tags = [("ShortName", name), ("Description", description), ("InputEncoding", "UTF-8")]
    rows = [f"  <{tag}>{escape(text)}</{tag}>" for tag, text in tags]
    rows.append(f'  <Url type="text/html" template="{origin}/?q={{searchTerms}}"/>')
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<OpenSearchDescription xmlns="http://a9.com/-/spec/opensearch/1.1/">', *rows, "</OpenSearchDescription>", ""])


def with_details(works: DataFrame, details: DataFrame, mentions: DataFrame, origin: str) -> DataFrame:
    """``work_id`` and ``json``: a work's structured data with what is known of it; a work of which nothing is known has the rest.

    ``details`` has work_id, lang, description, author and year; ``mentions`` work_id and mentions (an array).
    """
    rows = works.join(details, "work_id", "left").join(mentions, "work_id", "left")
    url = F.concat(F.lit(f"{origin}/"), "work_id")
    fields = F.struct(
        F.lit("Book").alias("@type"), url.alias("@id"), F.col("title").alias("name"), url.alias("url"), F.coalesce("lang", F.lit("en")).alias("inLanguage"),
        "description", "author", F.col("year").cast("string").alias("datePublished"), "mentions",
    )
    return rows.select("work_id", json_ld(fields).alias("json"))


def json_ld(fields: Column) -> Column:
    """A struct as JSON for a script element: null fields are left out and ``<`` is escaped."""
    return F.replace(F.to_json(fields), F.lit("<"), F.lit("\\u003c"))


def breadcrumbs(names: Column, items: Column) -> Column:
    """A list of crumbs with positions from 1."""
    crumbs = F.transform(F.arrays_zip(names.alias("name"), items.alias("item")), lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), x["item"].alias("item")))
    return F.struct(F.lit("BreadcrumbList").alias("@type"), crumbs.alias("itemListElement"))
