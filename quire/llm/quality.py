"""Quality rules: base counters, and the divergence of a document's histograms from its language's.

Everything is an expression on one row; the whole table is neither shuffled nor seen by Python. Only the references come
from aggregates, over the whole texts of all labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import FEW, materialize, plan_bytes, words_array

#: Common words of a language.
COMMON = 16
#: Estimated bytes of references that are sent to every task; those of more languages are joined as Spark sees fit.
SMALL = 32 << 20
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a kept document: of the classes, and of the common words in a long
#: text. A text of n words may be farther by ``SHORT`` / sqrt(n), the spread of its few counts, but always stays under
#: ``REACH`` of the distance that a text without any common word has.
MOST_CLASSES, MOST_WORDS, SHORT, REACH = 0.28, 0.19, 1.2, 0.97
#: Guards: shorter documents are not judged by the histogram.
LEAST_CHARS, LEAST_WORDS = 200, 100
CLASSES = ("letters", "spaces", "digits", "symbols", "others")
COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` words that the array holds twice or more, the first ones included.

    Windows are compared by 64-bit hashes. Sorted hashes tell whether there is any; only then positions are sorted with them. n log n in the words.
    """
    n = F.size(words)

    def positions(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j)), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).cast("int").alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def any_twice(hashes: Column) -> Column:
        return F.size(F.array_distinct(hashes)) < F.size(hashes)

    grams = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    found = let(grams, lambda g: F.when(any_twice(g), covered(positions(g))).otherwise(F.lit(0).cast("long")))
    return F.when(n >= size, found).otherwise(F.lit(0).cast("long"))


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counters and, for the histograms, ``__q_words`` and ``__q_<class>``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.drop(*COUNTERS).withColumn("__q_text", text).withColumn("__q_words", words_array(F.col("__q_text")))
    out = out.withColumn("__q_rest", F.regexp_replace("__q_text", r"[\p{L}\x20\x09-\x0D]+", ""))
    lines = F.filter(F.split("__q_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns(
        {
            "n_words": F.size("__q_words").cast("long"),
            "word_chars": F.length(F.array_join("__q_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("__q_rest", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__q_words")),
            "__q_digits": F.length(F.regexp_replace("__q_rest", r"[^0-9]+", "")),
            "__q_chars": F.length("__q_text"),
        }
    )
    others = F.length("__q_rest")
    out = out.withColumn("__q_spaces", F.col("__q_chars") - F.col("word_chars")).withColumn("__q_letters", F.col("word_chars") - others)
    out = out.withColumn("__q_symbols", F.col("n_symbols")).withColumn("__q_others", others - F.col("__q_symbols") - F.col("__q_digits"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For each language of ``docs``: shares of the character classes, its common words and their shares.

    The whole texts of all rows with a language and a text count. Counts of words are added up where the rows are; of a
    language's vocabulary only each task's most frequent words meet.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = counted(rows.select(F.col(lang_col).alias("__q_lang"), F.col(text_col).alias("__q_source")), "__q_source")
    shares = rows.groupBy("__q_lang").agg(F.sum("__q_chars").alias("n"), F.sum("n_words").alias("words"), *[F.sum(f"__q_{c}").alias(c) for c in CLASSES])
    shares = shares.where("n > 0").select("__q_lang", "words", F.array(*[F.col(c) / F.col("n") for c in CLASSES]).alias("__q_ref_classes"))
    words = rows.select("__q_lang", F.explode("__q_words").alias("w")).groupBy("__q_lang", "w").count()
    top = words.withColumn("k", F.row_number().over(Window.partitionBy("__q_lang").orderBy(F.desc("count"), "w")))
    top = top.where(F.col("k") <= COMMON).groupBy("__q_lang").agg(F.array_sort(F.collect_list(F.struct("k", "w", "count"))).alias("t"))
    found = shares.join(top, "__q_lang", "left").withColumn("__q_ref_shares", F.transform("t.count", lambda n: n / F.col("words")))
    return materialize(found.select("__q_lang", "__q_ref_classes", F.col("t.w").alias("__q_ref_words"), "__q_ref_shares"), "references", FEW)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence, base 2) of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    sums = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(sums, F.lit(0.0), lambda x, y: x + y) / 2))


def judge(docs: DataFrame, refs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``js_classes``, ``js_words`` and ``kept``; columns of these names are replaced.

    A null text has no words and fails the base rules. A language without reference, or a null one, and a document under
    the guards are not judged by the histograms (their distances are null); ``kept`` is then the base rules' verdict.
    Rows are judged one by one, so repeated rows get the same verdict and an empty table gives an empty one.
    """
    out = counted(docs.drop("js_classes", "js_words", "kept"), text_col)
    out = out.join(F.broadcast(refs) if plan_bytes(refs) <= SMALL else refs, out[lang_col] == refs["__q_lang"], "left")
    shares = F.array(*[F.col(f"__q_{c}") / F.col("__q_chars") for c in CLASSES])
    out = out.withColumn("js_classes", F.when(F.col("__q_ref_classes").isNotNull() & (F.col("__q_chars") >= LEAST_CHARS), jensen_shannon(shares, F.col("__q_ref_classes"))))
    ref_words = F.col("__q_ref_words")
    hits = F.filter("__q_words", lambda w: F.array_contains(ref_words, w))
    counts = let(hits, lambda h: F.transform(ref_words, lambda r: F.size(F.filter(h, lambda x: x == r)) / F.col("n_words")))
    rest = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda x, y: x + y))))
    distance = let(counts, lambda c: jensen_shannon(rest(c), rest(F.col("__q_ref_shares"))))
    out = out.withColumn("js_words", F.when(ref_words.isNotNull() & (F.col("n_words") >= LEAST_WORDS), distance))
    none = F.transform(F.col("__q_ref_shares"), lambda x: F.lit(0.0))
    reach = F.coalesce(jensen_shannon(rest(none), rest(F.col("__q_ref_shares"))), F.lit(1.0))
    most = F.least(F.lit(MOST_WORDS) + SHORT / F.sqrt(F.greatest(F.lit(1), "n_words")), REACH * reach)
    near = (F.coalesce("js_classes", F.lit(0.0)) <= MOST_CLASSES) & (F.coalesce("js_words", F.lit(0.0)) <= most)
    out = out.withColumn("kept", ~F.col("base_failed") & near)
    return out.drop(*[c for c in out.columns if c.startswith("__q_")])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, references(docs)).drop("text", "lang")
