"""Search, concordance, similarity, navigation and verification over verses and chapters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.ranges import numbered
from quire.plans.sorted import looked_up, write_sorted
from quire.plans.store import materialize, plan_bytes, small, source_bytes

INDEX_ORDER = ("work_id", "chapter_id", "section_idx", "verse_idx")
SEARCH_LIMIT, POPOVER, PREVIEW, HISTORY = 100, 5, 25, 10


# ---------------------------------------------------------------- search


def search(verses: DataFrame, query: str, work: str | None = None, book: str | None = None, chapter: str | None = None, books: DataFrame | None = None) -> DataFrame:
    """Verses that contain ``query`` in any case; a blank query finds nothing. The cheap filters come first.

    A book counts only within a chosen work, and, with the manifests' ``books`` at hand, only if that work has it.
    """
    q = query.strip().lower()
    out = verses if q else verses.limit(0)
    if work is not None:
        out = out.where(F.col("work_id") == work)
        if book is not None and books is not None:
            known = books.where((F.col("work_id") == work) & (F.col("book_id") == book)).agg((F.count("*") > 0).alias("__q_known"))
            out = out.crossJoin(F.broadcast(known)).where(~F.col("__q_known") | (F.col("book_id") == book)).drop("__q_known")
        elif book is not None:
            out = out.where(F.col("book_id") == book)
    if chapter is not None:
        out = out.where(F.col("chapter_id") == chapter)
    return out.where(F.contains(F.lower("text"), F.lit(q)))


def first_hits(hits: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first hits in index order: each task keeps ``limit`` rows at most."""
    return hits.orderBy(*INDEX_ORDER).limit(limit)


def group_hits(hits: DataFrame) -> DataFrame:
    """Hits of each work, with the first one's reference."""
    key = F.struct("chapter_id", "section_idx", "verse_idx")
    return hits.groupBy("work_id").agg(F.count("*").alias("hits"), F.min_by("ref", key).alias("first_ref"))


# ---------------------------------------------------------------- concordance


def word_rows(verses: DataFrame, stopwords: list[str]) -> DataFrame:
    """One row for each word of each verse record: letters with an inner apostrophe, over one character, no stopword."""
    rows = verses.select(*[c for c in verses.columns if c != "text"], F.explode(F.array_distinct(T.concordance_tokens(F.col("text")))).alias("word"))
    return rows.where((F.length("word") > 1) & ~F.col("word").isin(stopwords))


#: Estimated bytes of texts whose words a task holds at once.
WORD_BYTES = 4 << 20


def word_parts(texts: DataFrame) -> int:
    """Partitions of ``texts`` in which the words of each fit a task's memory, never fewer than the session's shuffle partitions."""
    size = source_bytes(texts)
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // WORD_BYTES) if size < 1 << 60 else 0)


def by_chapter(verses: DataFrame) -> DataFrame:
    """``verses`` dealt by chapter: what groups their words by chapter then does so where they are, so texts travel and not their words."""
    return verses.repartition(word_parts(verses), "work_id", "chapter_id")


def concordance(words: DataFrame) -> DataFrame:
    """The inverted index as posting lists, one for each word and chapter, so that no word's list outgrows a row."""
    refs = F.array_sort(F.collect_list(F.struct("section_idx", "verse_idx", "ref")))
    lists = words.groupBy("word", "work_id", "chapter_id").agg(refs.alias("r"))
    return lists.select("word", "work_id", "chapter_id", F.array_join("r.ref", " ").alias("refs"), F.size("r").alias("verse_count"))


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("verse_count"))


def lookup(verses: DataFrame, word: str, stopwords: list[str]) -> DataFrame:
    """The verses that hold a word of the concordance, with their texts. Only verses that contain its letters are tokenized."""
    some = verses.where(F.contains(F.lower("text"), F.lit(word)))
    found = F.array_contains(T.concordance_tokens(F.col("text")), word)
    return some.where(found & F.lit(len(word) > 1 and word not in stopwords))


def write_index(verses: DataFrame, stopwords: list[str], folder: str, files: int | None = None) -> None:
    """The concordance sorted by word, and the verses by chapter, each with a sparse index for ``stored_lookup``."""
    write_sorted(concordance(word_rows(by_chapter(verses), stopwords)), ["word", "work_id", "chapter_id"], f"{folder}/words", files)
    write_sorted(verses.withColumn("chapter", F.concat_ws(":", "work_id", "chapter_id")), ["chapter", *INDEX_ORDER[2:]], f"{folder}/verses", files)


def stored_lookup(spark: SparkSession, folder: str, word: str, most: int = POPOVER) -> DataFrame:
    """The first ``most`` verses that hold ``word``, in index order: ``ref``, ``text``, and ``verse_count`` of all.

    Only the files that hold the word are read, and of the verses those that hold the chapters of its first ``most`` references.
    """
    lists = looked_up(spark, f"{folder}/words", "word", word)
    first = lists.orderBy("work_id", "chapter_id").limit(most).select("work_id", "chapter_id", F.slice(F.split("refs", " "), 1, most).alias("refs"))
    rows = first.collect()  # no more than ``most`` chapters
    if not rows:
        return lists.select(F.lit("").alias("ref"), F.lit("").alias("text"), F.lit(0).cast("long").alias("verse_count")).limit(0)
    refs = [r for row in rows for r in row["refs"]][:most]
    total = lists.agg(F.sum("verse_count").cast("long").alias("verse_count"))
    verses = looked_up(spark, f"{folder}/verses", "chapter", *sorted({f"{r['work_id']}:{r['chapter_id']}" for r in rows}))
    return verses.where(F.col("ref").isin(refs)).crossJoin(F.broadcast(total)).orderBy(*INDEX_ORDER).select("ref", "text", "verse_count")


def unknown_words(texts: DataFrame, words: DataFrame, stopwords: list[str]) -> DataFrame:
    """Words of ``texts`` that the concordance lacks."""
    seen = texts.select(F.explode(F.array_distinct(T.concordance_tokens(F.col("text")))).alias("word")).where(F.length("word") > 1)
    return seen.where(~F.col("word").isin(stopwords)).distinct().join(words.select("word"), "word", "left_anti")


def known_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Words of ``texts`` that the concordance has."""
    seen = texts.select(F.explode(F.array_distinct(T.concordance_tokens(F.col("text")))).alias("word")).distinct()
    return seen.join(words.select("word"), "word", "left_semi")


def hits_by_work(hits: DataFrame, order: DataFrame) -> DataFrame:
    """Hits of each work, sorted by the works' own order (``work_id``, ``ord``); works that have no place come last."""
    per = hits.groupBy("work_id").agg(F.count("*").alias("hits"))
    return per.join(small(order.select("work_id", "ord")), "work_id", "left").sort(F.col("ord").asc_nulls_last(), "work_id")


# ---------------------------------------------------------------- similarity

VOCABULARY, LEAST_SCORE, TOP = 20_000, 0.1, 5
#: Chapters that are compared at once, and bytes of their terms; the most frequent terms, which have a number each in a chapter's
#: sketch, and the numbers for all others; estimated bytes of a strip of blocks, which a task holds.
BLOCK, BLOCK_BYTES, DENSE, GROUPS, STRIP_BYTES = 2048, 8 << 20, 1024, 2048, 256 << 20
#: Estimated bytes of the texts whose chapters one task packs into blocks.
PACK_BYTES = 64 << 20
#: The order of ties, and of chapters in blocks.
CHAPTER_ORDER = ("work_id", "chapter_id", "book_id")


def chapter_vectors(chapters: DataFrame, stopwords: list[str], vocabulary: int = VOCABULARY) -> DataFrame:
    """``work_id``, ``book_id``, ``chapter_id`` and ``l``: a chapter's terms as ``term``, its number ``k`` and ``w``, smoothed tf-idf of unit length.

    Terms are the ``vocabulary`` most frequent ones of the corpus (ties by term), a broadcast of that size; ``k`` counts them
    from the most frequent. They are counted where the texts lie. Then texts are dealt once by chapter, in ranges of their order and in parts whose
    words a task holds: counting, weighting and scaling stay where they are, and who sorts the chapters finds them sorted.
    """
    text = F.array_join(F.flatten(F.transform("sections", lambda s: s["verses"])), " ")
    keys = ["work_id", "book_id", "chapter_id"]
    rows = chapters.select(*keys, text.alias("text")).where(F.trim("text") != "")
    n = rows.agg(F.count("*").alias("n"))
    tokens = lambda: T.tfidf_tokens(F.col("text"))
    # Of a chapter's words in order, the first of each kind counts the chapter.
    marked = T.let(F.sort_array(tokens()), lambda l: F.transform(l, lambda x, i: F.struct(x.alias("term"), F.when(F.get(l, i - 1) == x, 0).otherwise(1).alias("new"))))
    counted = rows.select(F.inline(marked)).where(~F.col("term").isin(stopwords))
    terms = counted.groupBy("term").agg(F.sum("new").alias("df"), F.count("*").alias("cf")).orderBy(F.desc("cf"), "term").limit(vocabulary)
    terms = terms.crossJoin(F.broadcast(n)).select("term", (F.row_number().over(Window.orderBy(F.desc("cf"), "term")) - 1).alias("k"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    words = rows.repartitionByRange(word_parts(rows), *CHAPTER_ORDER).select(*keys, F.explode(tokens()).alias("term")).where(~F.col("term").isin(stopwords))
    tf = words.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    lists = tf.join(F.broadcast(terms), "term").groupBy(*keys).agg(F.collect_list(F.struct("term", "k", (F.col("tf") * F.col("idf")).alias("x"))).alias("l"))
    norm = F.sqrt(F.aggregate("l", F.lit(0.0), lambda a, e: a + e["x"] * e["x"]))
    scaled = T.let(F.struct(F.col("l").alias("l"), norm.alias("n")), lambda z: F.transform(z["l"], lambda e: F.struct(e["term"].alias("term"), e["k"].alias("k"), (e["x"] / z["n"]).alias("w"))))
    return lists.select(*keys, scaled.alias("l"))


def weights(chapters: DataFrame, stopwords: list[str], vocabulary: int = VOCABULARY) -> DataFrame:
    """``chapter_vectors`` as rows: ``work_id``, ``book_id``, ``chapter_id``, ``term``, ``k`` and ``w``."""
    return chapter_vectors(chapters, stopwords, vocabulary).select("work_id", "book_id", "chapter_id", F.inline("l"))


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Chapters (``id``, ``work_id``, ``book_id``, ``chapter_id``, ``t``, ``w``) in rows of a block of at most ``most`` each, with ascending ids."""
    held: list[pa.Table] = []
    count = size = 0

    def whole() -> pa.RecordBatch:
        rows = pa.concat_tables(held).sort_by("id").combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        t, w = column("t"), column("w")
        names = pa.StructArray.from_arrays([column(c) for c in ("id", "work_id", "book_id", "chapter_id")], ["id", "work_id", "book_id", "chapter_id"])
        parts = [column("id").to_numpy().astype("<i8"), np.diff(t.offsets.to_numpy()).astype("<i4"), t.flatten().to_numpy().astype("<i4"), w.flatten().to_numpy().astype("<f8")]
        lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
        return pa.RecordBatch.from_arrays([column("id")[:1], lists, *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["id", "names", "ids", "sizes", "t", "w"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = table.column("t").combine_chunks().offsets.to_numpy()
        at = 0
        while at < table.num_rows:
            fits = int(np.searchsorted(ends, ends[at] + (BLOCK_BYTES - size) // 12, "right")) - 1
            end = min(table.num_rows, at + most - count, max(fits, at + (not count)))
            held.append(table.slice(at, end - at))
            count, size, at = count + end - at, size + 12 * int(ends[end] - ends[at]), end
            if at < table.num_rows or count >= most:
                yield whole()
                held, count, size = [], 0, 0
    if count:
        yield whole()


class _Best:
    """The ``top`` best partners so far of each chapter of a block, by the score to three places and then the smaller id.

    A score within rounding of a border counts on both sides of it. ``sure``: from this score on a pair is wanted, ``tie``: from this one if the
    partner's id is below ``last``.
    """

    def __init__(self, count: int, least: float, top: int) -> None:
        self.least, self.top = least - 1e-9, top
        self.x, self.y, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.sure, self.tie, self.last = np.full(count, self.least), np.full(count, self.least), np.zeros(count, np.int64)

    def add(self, x: np.ndarray, y: np.ndarray, score: np.ndarray) -> None:
        x, y, score = np.concatenate([self.x, x]), np.concatenate([self.y, y]), np.concatenate([self.score, score])
        low, high = np.floor((score - 1e-9) * 1000 + 0.5), np.floor((score + 1e-9) * 1000 + 0.5)
        order = np.lexsort((y, -low, x))
        x, y, score, low, high = x[order], y[order], score[order], low[order], high[order]
        starts = np.flatnonzero(np.diff(x, prepend=-1))
        full = starts[np.diff(starts, append=len(x)) >= self.top] + self.top - 1
        at, border = x[full], low[full]
        place, last = np.full(len(self.sure), -np.inf), np.full(len(self.sure), 0, np.int64)
        place[at], last[at] = border, y[full]
        self.last[at] = y[full]
        self.sure[at], self.tie[at] = np.maximum((border + 0.5) / 1000 - 1e-9, self.least), np.maximum((border - 0.5) / 1000 - 1e-9, self.least)
        keep = (high > place[x]) | ((high == place[x]) & (y <= last[x]))
        self.x, self.y, self.score = x[keep], y[keep], score[keep]

    def wanted(self, bound: np.ndarray, ids: np.ndarray, slack: float) -> np.ndarray:
        """Which pairs with the chapters ``ids`` (ascending), of scores up to ``bound``, may be among the best."""
        out = bound >= (self.sure - slack).astype(np.float32)[:, None]
        tied = np.flatnonzero(self.last > ids[0])
        if len(tied):
            out[tied] |= (bound[tied] >= (self.tie - slack)[tied].astype(np.float32)[:, None]) & (ids[None, :] < self.last[tied][:, None])
        return out


class _Block:
    """A block's chapters: their terms in rows, and sketches whose product with another's is no less than the cosine.

    A sketch has the weights of the ``DENSE`` most frequent terms and, for all others, the lengths of what falls to each of ``GROUPS`` groups.
    """

    def __init__(self, ids: np.ndarray, books: np.ndarray, sizes: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
        self.ids, self.books, self.sizes, self.t, self.w = ids, books, sizes, t, w
        self.starts = np.cumsum(sizes) - sizes
        row, often = np.repeat(np.arange(len(sizes)), sizes), t < DENSE
        self.sketch = np.zeros((len(sizes), DENSE + GROUPS), np.float32)
        self.sketch[row[often], t[often]] = w[often]
        rest = ~often
        self.sketch[:, DENSE:] = np.sqrt(np.bincount(row[rest] * GROUPS + t[rest] % GROUPS, w[rest] ** 2, len(sizes) * GROUPS)).reshape(-1, GROUPS)

    def scores(self, other: _Block, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The cosines of the chapters ``r`` with those ``c`` of another block; ``r`` ascends."""
        out, row = np.empty(len(r)), np.zeros(int(max(self.t.max(), other.t.max())) + 1)
        rows, starts = np.unique(r, return_index=True)
        for x, low, high in zip(rows, starts, np.append(starts[1:], len(r)), strict=True):
            mine = slice(self.starts[x], self.starts[x] + self.sizes[x])
            row[self.t[mine]] = self.w[mine]
            some = c[low:high]
            if 4 * len(some) > len(other.sizes):
                out[low:high] = np.add.reduceat(row[other.t] * other.w, other.starts)[some]
            else:
                n = other.sizes[some]
                take = _ranges(other.starts[some], n)
                out[low:high] = np.add.reduceat(row[other.t[take]] * other.w[take], np.cumsum(n) - n)
            row[self.t[mine]] = 0
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _meet(a: _Block, b: _Block, best_a: _Best, best_b: _Best) -> None:
    """Adds the pairs of two blocks, or of a block with itself, to the best of both: a pair is computed if its bound is no worse than a chapter's ``top``."""
    other = a.books[:, None] != b.books[None, :]
    if not other.any():
        return
    bound = a.sketch @ b.sketch.T
    bound[~other] = -1
    same, slack = a is b, (a.sketch.shape[1] + 8) * 2.0**-23
    top = best_a.top

    def add(r: np.ndarray, c: np.ndarray) -> None:
        if same:  # both orders of a pair are there
            r, c = np.divmod(np.unique(np.minimum(r, c) * len(b.ids) + np.maximum(r, c)), len(b.ids))
        score = a.scores(b, r, c)
        bound[r, c] = -1
        if same:
            bound[c, r] = -1
        good = score >= best_a.least
        r, c, score = r[good], c[good], score[good]
        best_a.add(r, b.ids[c], score)
        best_b.add(c, a.ids[r], score)

    for best, m, ids in ((best_a, bound, b.ids), (best_b, bound.T, a.ids)):
        # Chapters of which many pairs are wanted yet: their best by the bound, and the first ones as good as these, raise the border.
        many = np.flatnonzero(best.wanted(m, ids, slack).sum(axis=1) > 4 * top)
        if len(many):
            some = m[many]
            near = np.argpartition(some, -top, axis=1)[:, -top:]
            tied = some >= (np.take_along_axis(some, near, 1).min(axis=1) - 2 * slack)[:, None]
            pick = tied & (np.cumsum(tied, axis=1) <= top)
            np.put_along_axis(pick, near, True, 1)
            x, y = np.nonzero(pick & (some >= 0))
            r, c = (many[x], y) if m is bound else (y, many[x])
            order = np.argsort(r, kind="stable")
            add(r[order], c[order])
    r, c = np.nonzero(best_a.wanted(bound, b.ids, slack) | best_b.wanted(bound.T, a.ids, slack).T)
    if len(r):
        add(r, c)


def similar_chapters(vectors: DataFrame, least: float = LEAST_SCORE, top: int = TOP, strip_bytes: int = STRIP_BYTES, block: int = BLOCK) -> DataFrame:
    """For each chapter of ``chapter_vectors`` the ``top`` most similar ones of other books with a cosine of at least ``least``.

    Every pair counts, so the work grows with the square of the chapters. Chapters are written once, in blocks and in the order of ties, and
    strips of blocks meet strips as Spark's tasks read them: no vector is shuffled. Blocks are compared by a product of sketches, an upper
    bound; cosines are computed where the bound may change a chapter's ``top`` of the task, which is what a task returns.
    """
    spark = vectors.sparkSession
    named = vectors.select("work_id", "book_id", "chapter_id", F.col("l.k").alias("t"), F.col("l.w").alias("w"))
    sorted_ = named.sort(*CHAPTER_ORDER).select(F.monotonically_increasing_id().alias("id"), "*")
    cores, size = spark.sparkContext.defaultParallelism, source_bytes(vectors)
    # The parts in which chapters were dealt are put together, so that blocks fill up.
    sorted_ = sorted_.coalesce(max(cores, size // PACK_BYTES if size < 1 << 60 else 0))
    chapter = "struct<id:long,work_id:string,book_id:string,chapter_id:string>"
    blocks = materialize(sorted_.mapInArrow(lambda batches: _packed(batches, block), f"id long, names array<{chapter}>, ids binary, sizes binary, t binary, w binary"), "blocks")
    names = blocks.select(F.inline("names")).drop("book_id")
    # Two strips to a task: as many that all cores have work, more where a strip would be too large.
    strips = max(1, math.isqrt(6 * cores), -(-plan_bytes(blocks) // strip_bytes))
    books = F.transform("names", lambda c: F.concat_ws("\u0000", c["work_id"], c["book_id"]))
    packed = blocks.select("id", books.alias("books"), "ids", "sizes", "t", "w").coalesce(strips)
    one, two = (packed.select(*[F.col(c).alias(f"{p}_{c}") for c in packed.columns]) for p in "ab")
    # Of the two orders of a pair of blocks one is left, by the parity of a hash, so that all tasks have work.
    odd = F.xxhash64("a_id").bitwiseXOR(F.xxhash64("b_id")).bitwiseAND(1) == 1
    met = one.hint("shuffle_replicate_nl").join(two, (F.col("a_id") == F.col("b_id")) | ((F.col("a_id") < F.col("b_id")) == odd))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book_of: dict[str, int] = {}
        bests: dict[int, _Best] = {}
        ids_of: dict[int, np.ndarray] = {}
        left = None

        def loaded(batch: pa.RecordBatch, i: int, at: int) -> _Block:
            first, books, *parts = (batch.column(at + c)[i] for c in range(6))
            ids, sizes, t, w = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(parts, ("<i8", "<i4", "<i4", "<f8"), strict=True))
            codes = np.array([book_of.setdefault(x, len(book_of)) for x in books.as_py()], np.int32)
            bests.setdefault(first.as_py(), _Best(len(sizes), least, top))
            ids_of[first.as_py()] = ids.copy()
            return _Block(ids_of[first.as_py()], codes, sizes.astype(np.int64), t.astype(np.int64), w.copy())

        for batch in batches:
            for i in range(batch.num_rows):
                first, second = batch.column(0)[i].as_py(), batch.column(6)[i].as_py()
                if left is None or left.ids[0] != first:
                    left = loaded(batch, i, 0)
                right = left if second == first else loaded(batch, i, 6)
                _meet(left, right, bests[first], bests[second])
        for first, best in bests.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids_of[first][best.x]), pa.array(best.y), pa.array(best.score)], names=["x", "y", "score"])

    pairs = met.mapInArrow(compared, "x long, y long, score double").withColumn("score", F.round("score", 3))
    best = Window.partitionBy("x").orderBy(F.desc("score"), "y")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    name = lambda p: names.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "work_id", "chapter_id")])
    full = ranked.join(name("a"), F.col("x") == F.col("a_id")).join(name("b"), F.col("y") == F.col("b_id"))
    return full.select(F.col("a_work_id").alias("work_id"), F.col("a_chapter_id").alias("chapter_id"), "rank", F.concat_ws(":", "b_work_id", "b_chapter_id").alias("ref"), F.col("b_work_id").alias("ref_work"), "score")


def related_by_work(similar: DataFrame) -> DataFrame:
    matches = F.array_sort(F.collect_list(F.struct("rank", "ref")))
    return similar.groupBy("work_id", "chapter_id", "ref_work").agg(matches.alias("m")).select("work_id", "chapter_id", "ref_work", F.array_join("m.ref", " ").alias("refs"))


def related_by_title(similar: DataFrame, titles: DataFrame) -> DataFrame:
    """A chapter's similar ones in groups by work, with the group's place in order of the works' titles (``work_id``, ``title``)."""
    groups = related_by_work(similar).join(small(titles.select(F.col("work_id").alias("ref_work"), "title")), "ref_work", "left")
    by_title = Window.partitionBy("work_id", "chapter_id").orderBy(F.coalesce("title", "ref_work"), "ref_work")
    return groups.withColumn("place", F.row_number().over(by_title))


# ---------------------------------------------------------------- order without a task per work

RANGE = 4096


def reading_order(chapters: DataFrame) -> DataFrame:
    """Chapters with the previous and next one of their work, and their place in the book.

    Neighbours are found within ranges of ``RANGE`` chapter numbers of a book; the ends of ranges come from a table with one
    row for each range. So a work of any size is dealt over many tasks. Unknown chapters have no neighbours.
    """
    rows = chapters.select("work_id", "book_id", "chapter_id", "chapter_num").withColumn("part", F.floor(F.col("chapter_num") / RANGE))
    near = Window.partitionBy("work_id", "book_id", "part").orderBy("chapter_num")
    parts = rows.groupBy("work_id", "book_id", "part").agg(F.min_by("chapter_id", "chapter_num").alias("first"), F.max_by("chapter_id", "chapter_num").alias("last"), F.count("*").alias("n"))
    of_work = Window.partitionBy("work_id").orderBy("book_id", "part")
    of_book = Window.partitionBy("work_id", "book_id").orderBy("part")
    ends = parts.select(
        "work_id", "book_id", "part",
        F.lag("last").over(of_work).alias("before"), F.lead("first").over(of_work).alias("after"),
        (F.sum("n").over(of_book) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy("work_id", "book_id")).alias("chapters"),
    )
    rows = rows.select("*", F.lag("chapter_id").over(near).alias("p"), F.lead("chapter_id").over(near).alias("q"), F.row_number().over(near).alias("k"))
    out = rows.join(ends, ["work_id", "book_id", "part"])
    return out.select("work_id", "book_id", "chapter_id", F.coalesce("p", "before").alias("prev_id"), F.coalesce("q", "after").alias("next_id"), (F.col("offset") + F.col("k")).alias("position"), "chapters")


def expand_books(books: DataFrame) -> DataFrame:
    """A row for each chapter that a manifest promises; a book without chapters gives none."""
    n = F.when(F.col("chapters") > 0, F.sequence(F.lit(0), F.col("chapters").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    rows = books.select("work_id", "book_id", F.coalesce("start", F.lit(1)).alias("start"), "names", F.explode(n).alias("i"))
    number = F.col("start") + F.col("i")
    return rows.select("work_id", "book_id", F.concat_ws("-", "book_id", number).alias("chapter_id"), number.alias("chapter_num"), F.get("names", F.col("i")).alias("name"))


# ---------------------------------------------------------------- segmentation


#: Elements that a fold gathers before it adds them to its result: appending one by one would copy the result each time.
RUN = 256


def scan(values: Column, start: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The states of a fold after each element of an array; ``kind`` is the state's type. Linear in the elements."""
    none = F.array().cast(f"array<{kind}>")

    def element(a: Column, x: Column) -> Column:
        return T.let(step(a["s"], x), lambda s: F.struct(s.alias("s"), F.concat(a["o"], F.array(s)).alias("o")))

    def stretch(v: Column, a: Column, at: Column) -> Column:
        run = F.aggregate(F.slice(v, at, RUN), F.struct(a["s"].alias("s"), none.alias("o")), element)
        return T.let(run, lambda r: F.struct(r["s"].alias("s"), F.concat(a["o"], F.array(r["o"])).alias("o")))

    def whole(v: Column) -> Column:
        begin = F.struct(start.cast(kind).alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, begin, lambda a, at: stretch(v, a, at), lambda a: F.flatten(a["o"]))

    return T.let(values, whole)


def places(flags: Column) -> Column:
    """The places (from 0) of the true elements of a bound array of booleans, in order."""
    return F.filter(F.transform(flags, lambda s, i: F.when(s, i)), lambda i: i.isNotNull())


def pieces(values: Column, starts: Column, join: Callable[[Column], Column]) -> Column:
    """``join`` of the elements from each start to the next; ``values`` and ``starts`` (booleans) are arrays of one length.

    What stands before the first start is a piece of its own. Linear within the row.
    """

    def cut(b: Column) -> Column:
        begins = places(F.transform(b["s"], lambda s, i: s | (i == 0)))
        return T.let(begins, lambda p: F.transform(p, lambda x, k: join(F.slice(b["v"], x + 1, F.coalesce(F.get(p, k + 1), F.size(b["v"])) - x))))

    return T.let(F.struct(values.alias("v"), starts.alias("s")), cut)


def islands(lines: Column, starts: Column) -> Column:
    """Lines joined by a space from each start to the next; empty lines at a piece's head don't count."""

    def joined(part: Column) -> Column:
        first = F.array_position(F.transform(part, lambda x: x != ""), F.lit(True)).cast("int")
        return F.when(first > 0, F.array_join(F.slice(part, F.greatest(first, F.lit(1)), F.size(part)), " ")).otherwise("")

    return pieces(lines, starts, lambda part: T.let(part, joined))


def numbered_verses(lines: Column, marker: str = r"^(\d+)\.\s*") -> Column:
    """Verses of lines of which some begin with a number and a point; blank lines and empty verses don't count."""
    real = F.filter(F.transform(lines, T.strip), lambda x: x != "")
    marks = F.transform(real, lambda x: x.rlike(marker))
    return F.filter(islands(F.transform(real, lambda x: F.regexp_replace(x, marker, "")), marks), lambda x: x != "")


def merged_paragraphs(paragraphs: Column, ends: str = r"[.!?\"”]$") -> Column:
    """Paragraphs joined to the one before while that does not end a sentence."""

    def merged(p: Column) -> Column:
        return T.let(F.transform(p, lambda x: x.rlike(ends)), lambda e: islands(p, F.transform(p, lambda x, i: (i == 0) | F.coalesce(F.get(e, i - 1), F.lit(False)))))

    return T.let(paragraphs, merged)


def sections_of_numbers(numbers: Column, filled: Column | None = None) -> Column:
    """Section of each verse number: a number that is not above the one before begins the next section.

    With ``filled`` (whether the verse has any text, for each number), it does so only if a verse of its section has text.
    """
    if filled is not None:
        kind = "struct<last:bigint,section:int,some:boolean>"
        start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("section"), F.lit(False).alias("some"))

        def step(a: Column, x: Column) -> Column:
            new = a["some"] & F.coalesce(x["n"] <= a["last"], F.lit(False))
            some = F.when(new, x["f"]).otherwise(a["some"] | x["f"])
            return F.struct(x["n"].cast("bigint").alias("last"), (a["section"] + new.cast("int")).alias("section"), some.alias("some"))

        pairs = F.zip_with(numbers, filled, lambda n, f: F.struct(n.alias("n"), f.alias("f")))
        return F.transform(scan(pairs, start, kind, step), lambda s: s["section"])

    def falls(n: Column) -> Column:
        return F.transform(n, lambda x, i: (i > 0) & F.coalesce(x <= F.get(n, i - 1), F.lit(False)))

    sizes = T.let(numbers, lambda n: pieces(n, falls(n), F.size))
    return F.flatten(F.transform(sizes, lambda size, k: F.array_repeat(k, size)))


def sequential_markers(numbers: Column) -> Column:
    """Places of the numbers that count 1, 2, 3... in order; others are no markers."""

    def found(n: Column) -> Column:
        wanted = scan(n, F.lit(1), "bigint", lambda want, x: F.when(x.cast("long") == want, want + 1).otherwise(want))
        return T.let(wanted, lambda w: places(F.transform(w, lambda x, i: x > F.coalesce(F.get(w, i - 1), F.lit(1).cast("long")))))

    return T.let(numbers, found)


def filled_forward(values: Column) -> Column:
    """Each value, or where it is null the last one before it."""
    return scan(values, F.lit(None), "string", lambda last, x: F.coalesce(x, last))


# ---------------------------------------------------------------- verification


def verify(works: DataFrame, books: DataFrame, chapters: DataFrame, expected: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Errors of a corpus, as text. ``expected`` has book_id, idx and verses; ``books`` has work_id, book_id, chapters, start.

    Works without manifest, books with another number of chapters than expected, chapters that are promised and missing,
    other verse counts than expected, and blank verses. All that is known of a chapter, book or work meets in one aggregate over one ledger,
    so each table is read once and a chapter is a row of a few numbers. ``seen``, if given, learns on the way how many chapters, verses and
    blank verses there are.
    """
    number = F.aggregate("sections", F.lit(0), lambda a, s: a + F.size(s["verses"]))
    blank = F.aggregate("sections", F.lit(0), lambda a, s: a + F.size(F.filter(s["verses"], lambda v: F.trim(v) == "")))
    have = chapters.select("work_id", "book_id", F.col("chapter_num").cast("long").alias("number"), "chapter_id", number.alias("verses"), blank.alias("blank"))
    if seen is not None:
        have = have.observe(seen, F.count("*").alias("chapters"), F.sum("verses").alias("verses"), F.sum("blank").alias("blank"))
    promised = expand_books(books.withColumn("names", F.lit(None).cast("array<string>")) if "names" not in books.columns else books)
    starts = books.select("work_id", "book_id", F.coalesce("start", F.lit(1)).alias("start"))
    asked = expected.select("book_id", "idx", F.col("verses").cast("long").alias("want")).join(small(starts), "book_id")
    kinds = {
        "work": works.select("work_id"),
        "manifest": books.select("work_id", "book_id", F.col("chapters").cast("long").alias("chapters")),
        "promised": promised.select("work_id", "book_id", F.col("chapter_num").cast("long").alias("number")),
        "asked": asked.select("work_id", "book_id", (F.col("start") + F.col("idx")).cast("long").alias("number"), "want"),
        "there": have,
    }
    ledger = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()])
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(kind)
    most = [F.max(c).alias(c) for c in ("chapters", "want", "verses", "blank", "chapter_id")]
    level = F.grouping_id().alias("level")
    met = ledger.rollup("work_id", "book_id", "number").agg(level, *[of(k) for k in kinds], *most)
    chapter, book, work = (F.col("level") == x for x in (0, 1, 3))
    path = F.concat("work_id", F.lit("/"), "book_id")
    messages = F.array(
        F.when(work & (F.col("work") > 0) & (F.col("manifest") == 0), F.concat("work_id", F.lit(": manifest missing"))),
        F.when(book & (F.col("asked") > 0) & (F.col("chapters") != F.col("asked")), F.concat(path, F.lit(": "), "chapters", F.lit(" chapters, expected "), "asked")),
        F.when(chapter & (F.col("promised") > 0) & (F.col("there") == 0), F.concat(path, F.lit("-"), "number", F.lit(": chapter missing"))),
        F.when(chapter & (F.col("verses") != F.col("want")), F.concat("work_id", F.lit("/"), "chapter_id", F.lit(": "), "verses", F.lit(" verses, expected "), "want")),
        F.when(chapter & (F.col("blank") > 0), F.concat("work_id", F.lit("/"), "chapter_id", F.lit(": "), "blank", F.lit(" blank verses"))),
    )
    return met.select(F.explode(F.filter(messages, lambda m: m.isNotNull())).alias("message"))


def sorted_errors(errors: DataFrame) -> DataFrame:
    """Errors in order as text, sorted over the cluster."""
    return errors.sort("message")


def tallies(chapters: DataFrame) -> DataFrame:
    """Chapters and verses of each parsed work; a chapter is counted by its id."""
    verses = F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.size(s["verses"]))
    each = chapters.groupBy("work_id", "chapter_id").agg(F.sum(verses).alias("v"))
    return each.groupBy("work_id").agg(F.count("*").alias("chapters"), F.sum("v").alias("verses"))


def corpus_stats(chapters: DataFrame) -> DataFrame:
    verses = F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.size(s["verses"]))
    books = chapters.groupBy("work_id", "book_id").agg(F.count("*").alias("c"), F.sum(verses).alias("v"))
    return books.agg(F.count_distinct("work_id").alias("works"), F.count("*").alias("books"), F.sum("c").alias("chapters"), F.sum("v").alias("verses"))


# ---------------------------------------------------------------- manifests


def books_of(chapters: DataFrame) -> DataFrame:
    """A manifest's rows from chapters: how many a book has, its first number, and its first chapter's id."""
    return chapters.groupBy("work_id", "book_id").agg(F.count("*").alias("chapters"), F.min("chapter_num").alias("start"), F.min_by("chapter_id", "chapter_num").alias("first_id"))


def with_book(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters with the name of their book and the title of their work, empty where the manifests don't know them."""
    known = books.select("work_id", "book_id", F.col("book_name").alias("__q_name"), F.col("title").alias("__q_title"))
    rows = chapters.drop("book_name", "title").join(known, ["work_id", "book_id"], "left")
    return rows.withColumns({"book_name": F.coalesce("__q_name", F.lit("")), "title": F.coalesce("__q_title", F.lit(""))}).drop("__q_name", "__q_title")


def chapter_title(title: Column, book_name: Column, number: Column, chapters: Column, books: Column) -> Column:
    """A book of one chapter is called by its name, a chapter of a work with one book by the work's, any other by its book's."""
    return F.when(chapters == 1, book_name).when(books == 1, F.concat_ws(" ", title, number)).otherwise(F.concat_ws(" ", book_name, number))


def resolve_routes(routes: DataFrame, books: DataFrame) -> DataFrame:
    """Chapter routes whose book exists and whose number lies in it."""
    b = books.select("work_id", "book_id", F.coalesce("start", F.lit(1)).alias("__q_start"), F.col("chapters").alias("__q_n"))
    found = routes.join(b, ["work_id", "book_id"])
    return found.where(F.col("chapter_num").between(F.col("__q_start"), F.col("__q_start") + F.col("__q_n") - 1)).drop("__q_start", "__q_n")


def with_overrides(names: DataFrame, overrides: DataFrame, key: str = "num", name: str = "name") -> DataFrame:
    """Names as listed, without their article, or as overridden."""
    own = overrides.select(key, F.col(name).alias("__q_name"))
    return names.join(small(own), key, "left").select(key, F.coalesce("__q_name", F.regexp_replace(name, "^The ", "")).alias(name))


def verse_changes(verses: DataFrame, other: DataFrame, key: str = "ref") -> DataFrame:
    """Verses whose words differ from another edition's, with the other's text; marks and case don't count."""
    right = other.select(key, F.col("text").alias("new_text"))
    return verses.select(key, "text").join(right, key).where(T.words_differ(F.col("text"), F.col("new_text")))


def patched(verses: DataFrame, changes: DataFrame, key: str = "ref") -> DataFrame:
    """Verses with changed ones replaced."""
    return verses.join(changes.select(key, "new_text"), key, "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def ranges_replaced(lines: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Lines (``key``, ``i`` from 0, ``line``) with ranges replaced by other lines, however many; numbered anew.

    ``changes`` has ``key``, ``first``, ``end`` (exclusive) and ``lines``; ranges of a key must not overlap, in any order. A range is put
    where it begins, so a range beyond the end of a text changes nothing. Ranges meet lines by key and line number, not by search.
    """
    numbers = F.when(F.col("end") > F.col("first"), F.sequence("first", F.col("end") - 1)).otherwise(F.array().cast("array<int>"))
    covered = changes.select(F.col(key).alias("__q_key"), F.explode(numbers).alias("__q_i"), "first", "lines")
    met = lines.join(covered, (F.col(key) == F.col("__q_key")) & (F.col("i") == F.col("__q_i")), "left")
    own = F.when(F.col("first").isNull(), F.array("line")).when(F.col("i") == F.col("first"), F.col("lines")).otherwise(F.array().cast("array<string>"))
    rows = met.select(key, F.col("i").alias("__q_at"), F.posexplode(own).alias("__q_k", "line"))
    return numbered(rows, [key], [F.col("__q_at"), F.col("__q_k")], "i").select(key, (F.col("i") - 1).alias("i"), "line")


def occurrences(text: Column, words: list[str]) -> Column:
    """How many whole words of ``words`` a text holds."""
    pattern = T.whole_word("(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")")
    return F.regexp_count(text, F.lit(pattern))


def substrings(text: Column, key: str) -> Column:
    """How often a text holds ``key``, left to right without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(key), F.lit("")))) / len(key)).cast("long")


def patched_count(before: Column, after: Column, keys: list[str]) -> Column:
    """How many of ``keys``, as substrings, a patch has taken away."""
    each = [substrings(before, k) - substrings(after, k) for k in keys]
    return sum(each[1:], each[0])
