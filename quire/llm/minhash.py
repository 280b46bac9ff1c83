"""MinHash near-dedup with BagMinHash: weighted Jaccard of the multisets of five-word shingles.

A shingle with weight w owns the level interval [0, w), cut into [0, 1), [1, 2), [2, 4), [4, 8)... Each interval is a
Poisson process in time that depends on the shingle and the interval alone; its points carry a level and a slot of the
signature, and count if their level lies below w. A slot's first point is then equal in two documents with exactly the
probability of their weighted Jaccard similarity. Points are made in order of time and only until every slot has one.

A slot is kept as 16 bits, and four slots are a band. Texts that share a band meet in its bucket, in tiles of bounded size:

1. Each tile gives a spanning forest of its most similar texts by signature, so a bucket sends fewer pairs than it has
   members. Those pairs are verified on the texts' shingles; what they link are the first components.
2. In buckets that still hold several components, tiles meet tiles. Pairs of different components whose signatures agree
   in ``AGREE`` slots are verified in place: a tile's texts travel together, once for all their pairs.

Nothing is left after that: every pair that shares a band and agrees in ``AGREE`` slots is linked, or in one component
by other links, or verified to be no link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import FEW, FILES, NULL_ID, discard, files_for, held, hot_lookup, materialize, mix, plan_bytes, release, released, rolling
from quire.llm.components import components
from quire.llm.repeats import Chunk, chunks, runs, spread

SHINGLE, SIMILARITY = 5, 0.8
#: Bands, and slots of a band: a pair at the threshold shares no band with a chance of 3e-6.
BANDS, ROWS = 24, 4
#: Slots of all in which candidates agree: a pair at the threshold has fewer with a chance of 3e-5.
AGREE = 60 / 96
#: Texts of a tile, and shingles of a tile, about.
TILE, TILE_SHINGLES = 256, 1 << 19
#: Bucket entries that one task compares, and bytes of text that one task verifies, about.
ENTRIES, BYTES = 1 << 14, 4 << 20
#: Partners of a text from which its pairs are dealt over several tasks.
PARTNERS = 64


def shingles(chunk: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multiset of each document of a chunk: document, shingle hash, weight; sorted. Shorter texts are one shingle."""
    counts = np.diff(chunk.first)
    number = np.where(counts >= size, counts - size + 1, 0)
    h = rolling(chunk.tokens, size)
    at = spread(chunk.first[:-1], number)
    doc, x = np.repeat(np.arange(len(counts)), number), h[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        lone = np.array([int(mix(rolling(chunk.tokens[chunk.first[i] : chunk.first[i + 1]], int(counts[i])) + np.uint64(counts[i]))[0]) for i in short], np.uint64)
        doc, x = np.concatenate((doc, short)), np.concatenate((x, lone))
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[new], x[new], np.diff(np.append(new, len(x)))


def signatures(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """BagMinHash signatures (docs x slots) of multisets given as (document, shingle, weight); +inf for empty ones."""
    out = np.full((docs, slots), np.inf)
    total = np.bincount(doc, weight, docs)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(docs)
    limit[todo] = slots * (math.log(slots) + 4) / total[todo]
    while len(todo):
        active = np.zeros(docs, bool)
        active[todo] = True
        pick = np.flatnonzero(active[doc])
        _points(doc[pick], x[pick], weight[pick], limit, out, slots)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        limit[todo] *= 2
    return out


def _points(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, limit: np.ndarray, out: np.ndarray, slots: int) -> None:
    flat = out.reshape(-1)
    level = 0
    while len(x):  # the dyadic intervals
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        state = mix(x + np.uint64((level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        time, who, top = np.zeros(len(x)), doc, weight
        while len(state):
            state = mix(state + np.uint64(0x632BE59BD9B4E019))
            time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
            alive = time <= limit[who]
            state, time, who, top = state[alive], time[alive], who[alive], top[alive]
            more = mix(state ^ np.uint64(0xD1B54A32D192ED03))
            slot = (more >> np.uint64(32)) % np.uint64(slots)
            place = low + ((more & np.uint64(0xFFFFFFFF)).astype(float) * (width / 2.0**32)).astype(np.int64)
            hit = place < top
            np.minimum.at(flat, who[hit] * slots + slot[hit].astype(np.int64), time[hit])
        level += 1
        more_levels = weight > (1 << (level - 1))
        doc, x, weight = doc[more_levels], x[more_levels], weight[more_levels]


def lanes(sig: np.ndarray) -> np.ndarray:
    """Signatures as one 64-bit value a band, 16 bits a slot; equal slots have equal bits."""
    bits = mix(np.ascontiguousarray(sig).view(np.uint64)) >> np.uint64(48)
    return np.ascontiguousarray(bits.astype(np.uint16)).view(np.int64).reshape(len(sig), -1)


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``key`` (of the word sequence; null without words), ``n`` (shingles) and ``bands`` of each row."""
    base = docs.select(*_named(id_col, text_col), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for row, chunk in chunks(texts, True):
                n = len(chunk.first) - 1
                doc, x, w = shingles(chunk, size)
                keys = lanes(signatures(doc, x, w, n, bands * ROWS))
                raw = chunk.buf.tobytes()
                names = [hashlib.blake2b(raw[chunk.starts[a] : chunk.ends[b - 1]], digest_size=16).digest() if b > a else None for a, b in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                total = np.bincount(doc, w, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(names, pa.binary()), pa.array(total), lists], names=["id", "h", "key", "n", "bands"])
        release()

    return base.mapInArrow(run, "id long, h long, key binary, n long, bands array<long>")


def _named(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("h")]


# ---------------------------------------------------------------- within a task


class Elements:
    """The multisets of some texts as sets: equal shingles are numbered, so overlaps count with multiplicity."""

    def __init__(self, texts: list[bytes], size: int) -> None:
        xs, lengths = [], np.zeros(len(texts), np.int64)
        for row, chunk in chunks(texts, True):
            doc, x, w = shingles(chunk, size)
            number = spread(np.zeros(len(w), np.int64), w)
            xs.append(mix(np.repeat(x, w) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            n = len(chunk.first) - 1
            lengths[row : row + n] = np.bincount(doc, w, n)
        every, self.x = np.unique(np.concatenate(xs) if xs else np.empty(0, np.uint64), return_inverse=True)
        self.mark = np.zeros(len(every), bool)
        self.n = lengths
        self.first = np.cumsum(lengths) - lengths

    def similarities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of the texts ``a`` and ``b``, pair by pair: shared shingles over all, with multiplicity."""
        out = np.zeros(len(a))
        order = np.argsort(a, kind="stable")
        at = runs(a[order])
        for s, e in zip(at.tolist(), [*at[1:].tolist(), len(a)] if len(at) else [], strict=True):
            me = int(a[order[s]])
            own = self.x[self.first[me] : self.first[me] + self.n[me]]
            self.mark[own] = True
            while s < e:  # about 4 million elements of partners at a time
                size = np.cumsum(self.n[b[order[s:e]]])
                take = order[s : s + max(1, int(np.searchsorted(size, 1 << 22, side="right")))]
                s += len(take)
                other = self.n[b[take]]
                hits = np.concatenate(([0], np.cumsum(self.mark[self.x[spread(self.first[b[take]], other)]])))
                ends = np.cumsum(other)
                shared = hits[ends] - hits[ends - other]
                total = self.n[me] + other - shared
                out[take] = shared / np.maximum(1, total)
            self.mark[own] = False
        return out


def similarities(left: list[bytes], right: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard of each pair of texts."""
    n = len(left)
    return Elements([*left, *right], size).similarities(np.arange(n), np.arange(n) + n)


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Which of the edges, the best ones first, make a spanning forest."""
    label, chosen = np.arange(nodes), np.zeros(len(a), bool)
    alive = np.arange(len(a))
    while True:
        la, lb = label[a[alive]], label[b[alive]]
        apart = la != lb
        alive, la, lb = alive[apart], la[apart], lb[apart]
        if not len(alive):
            return chosen
        best = np.full(nodes, len(a), np.int64)
        np.minimum.at(best, la, alive)
        np.minimum.at(best, lb, alive)
        pick = np.unique(best[best < len(a)])
        chosen[pick] = True
        label = _joined(label, a[pick], b[pick])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        before = label
        label = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if (label == before).all():
            return label


class Met:
    """The entries of some tiles (or pairs of tiles), and the candidate pairs in them."""

    def __init__(self, table: pa.Table, tiles: list[str]) -> None:
        keys = [table.column(c).to_numpy() for c in tiles]
        order = np.lexsort((table.column("node").to_numpy(), *keys[::-1]))
        self.table = table.take(pa.array(order))
        keys = [k[order] for k in keys]
        self.group = np.cumsum(np.any([np.concatenate(([False], k[1:] != k[:-1])) for k in keys], axis=0)) if len(order) else order
        lists = self.table.column("bands").combine_chunks()
        self.bands = lists.flatten().to_numpy().reshape(len(order), -1)
        self.slots = np.ascontiguousarray(self.bands).view(np.uint16)
        self.size = self.column("n")

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def pairs(self, similarity: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a group that can be links by size and signature, the most alike first.

        ``across``: of different components, in the first band that they share; in a pair of tiles, one of each.
        """
        need = math.ceil(AGREE * self.slots.shape[1])
        found = []
        n = len(self.group)
        if across:
            root, band, tile, mixed = self.column("root"), self.column("band"), self.column("tile"), self.column("i") != self.column("j")
        for d in range(1, int(np.bincount(self.group).max(initial=0))):
            ok = self.group[d:] == self.group[: n - d]
            small, large = np.minimum(self.size[d:], self.size[: n - d]), np.maximum(self.size[d:], self.size[: n - d])
            ok &= small >= similarity * large - 1e-6
            if across:
                ok &= (root[d:] != root[: n - d]) & (~mixed[d:] | (tile[d:] != tile[: n - d]))
            x = np.flatnonzero(ok)
            agree = (self.slots[x] == self.slots[x + d]).sum(axis=1)
            x, agree = x[agree >= need], agree[agree >= need]
            if across and len(x):
                first = (self.bands[x] == self.bands[x + d]).argmax(axis=1)
                x, agree = x[first == band[x]], agree[first == band[x]]
            if len(x):
                found.append((x.astype(np.int32), (x + d).astype(np.int32), agree.astype(np.int16)))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b, agree = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(-agree, kind="stable")
        return a[order].astype(np.int64), b[order].astype(np.int64)


# ---------------------------------------------------------------- over the cluster


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """For each row ``id``, ``h`` (hash of its text), ``class_id`` and ``class_h``: the id and hash of its class's representative.

    Null ids are ``NULL_ID`` here. A class is a connected component of links; its representative is the text with the
    smallest id (of several texts with that id, the one with the smallest hash).
    """
    base = docs.select(id_col, text_col)
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketched = materialize(sketch(base, id_col, text_col, size, bands), "sketch", max(FILES, plan_bytes(base) >> 21))
    count = sketched.count()
    # A node is a word sequence, whatever the ids of the rows that have it.
    reps = sketched.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "h")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("node"), "key", "rep.id", "rep.h", "copies", "n", "bands"), "reps", files_for(count))
    signed = reps.select("node", "bands")

    entries = reps.select("node", "n", F.posexplode("bands").alias("band", "v"))
    sizes = entries.groupBy("band", "v").agg(F.count("*").alias("g"), F.sum("n").alias("s")).where("g > 1")
    sizes = sizes.select("band", "v", F.ceil(F.greatest(F.col("g") / TILE, F.least(F.col("g") / 2, F.col("s") / TILE_SHINGLES))).cast("int").alias("tiles"))
    shared = entries.join(sizes, ["band", "v"]).withColumn("tile", F.pmod(F.xxhash64("node", "band"), F.col("tiles")).cast("int"))
    shared = materialize(shared, "shared", files_for(count * bands, 500_000))
    met_rows = shared.count()

    @released
    def linked(table: pa.Table) -> pa.Table:
        met = Met(table, ["band", "v", "tile"])
        a, b = met.pairs(similarity, False)
        pick = forest(a, b, len(met.group))
        node = met.column("node")
        a, b = node[a[pick]], node[b[pick]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    slot = lambda keys, slots: F.pmod(F.xxhash64(*keys), F.lit(slots))
    slots = max(least, met_rows // ENTRIES)
    dealt = shared.join(signed, "node").select(slot(["band", "v", "tile"], slots).alias("slot"), "band", "v", "tile", "node", "n", "bands")
    pairs = materialize(dealt.groupBy("slot").applyInArrow(linked, "a long, b long").distinct(), "pairs", files_for(met_rows, least=FEW))

    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).unionAll(shared.where("tiles > 1").select("node")).distinct()
    wanted = reps.join(nodes, "node", "left_semi").select("node", "id", "h")
    texts = base.select(*_named(id_col, text_col), F.col(text_col).cast("binary").alias("text")).join(wanted, ["id", "h"])
    texts = materialize(texts.groupBy("node").agg(F.min("text").alias("text")), "texts", files_for(count, 10_000))

    links = materialize(verified(pairs, texts, similarity, size), "links", files_for(met_rows, 5_000))
    roots = components(links)
    placed = shared.join(roots.withColumnRenamed("node", "__q_node"), F.col("node") == F.col("__q_node"), "left").drop("__q_node").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("band", "v").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band", "v")
    rest = materialize(placed.join(several, ["band", "v"], "left_semi"), "rest", files_for(met_rows))
    # Tile i meets tile j: an entry goes to as many blocks as its bucket has tiles.
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    blocks = rest.withColumn("m", F.explode(meets)).select("band", "v", "m.i", "m.j", "tile", "node", "root", "n")
    slots = max(least, (rest.agg(F.sum("tiles")).first()[0] or 0) // ENTRIES)
    schema = "band int, v long, i int, j int, tile int, node long, root long, n long, bands array<long>"

    @released
    def doubted(table: pa.Table) -> pa.Table:
        met = Met(table.drop_columns(["slot"]), ["band", "v", "i", "j"])
        a, b = met.pairs(similarity, True)
        return met.table.take(pa.array(np.unique(np.concatenate((a, b)))))

    dealt = blocks.join(signed, "node").select(slot(["band", "v", "i", "j"], slots).alias("slot"), "band", "v", "i", "j", "tile", "node", "root", "n", "bands")
    doubt = materialize(dealt.groupBy("slot").applyInArrow(doubted, schema), "doubt", files_for(met_rows, 5_000))

    @released
    def settled(table: pa.Table) -> pa.Table:
        met = Met(table, ["band", "v", "i", "j"])
        a, b = met.pairs(similarity, True)
        node, root = met.column("node"), met.column("root")
        _, one, which = np.unique(node, return_index=True, return_inverse=True)
        blobs = met.table.column("text").take(pa.array(one)).to_pylist()
        good = Elements(blobs, size).similarities(which[a], which[b]) >= similarity
        a, b = root[a[good]], root[b[good]]
        some, label = np.unique(np.concatenate((a, b)), return_inverse=True)
        pick = forest(label[: len(a)], label[len(a) :], len(some))
        return pa.table({"a": a[pick], "b": b[pick]})

    in_doubt = doubt.agg(F.sum("n")).first()[0]
    if in_doubt:
        slots = max(least, 8 * in_doubt // BYTES)
        dealt = doubt.join(texts, "node").withColumn("slot", slot(["band", "v", "i", "j"], slots))
        more = materialize(dealt.groupBy("slot").applyInArrow(settled, "a long, b long").distinct(), "more", files_for(met_rows, 5_000))
        again = components(more).toDF("__q_node", "__q_root")
        known = roots.unionAll(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))).distinct()
        roots = known.join(again, F.col("root") == F.col("__q_node"), "left").select("node", F.coalesce("__q_root", "root").alias("root"))
        roots = materialize(roots.distinct(), "roots", files_for(met_rows, least=FEW))
    discard(doubt, rest, shared, pairs, texts)

    members = reps.join(roots, "node").select("node", "root", "id", "h")
    heads = members.groupBy("root").agg(F.min(F.struct("id", "h")).alias("head"))
    named = reps.select("node", "key", "copies", "id", "h").join(members.join(heads, "root").select("node", "head"), "node", "left")
    named = named.select("key", "copies", F.coalesce("head.id", "id").alias("class_id"), F.coalesce("head.h", "h").alias("class_h"))
    with_words = hot_lookup(sketched.where("key IS NOT NULL").select("id", "h", "key"), named, "key", "copies").select("id", "h", "class_id", "class_h")
    return with_words.unionByName(sketched.where("key IS NULL").select("id", "h", F.col("id").alias("class_id"), F.col("h").alias("class_h")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """``id_col``, ``class_id``, ``kept`` (it has the id of the class's representative) for each row of ``docs``.

    A class is a connected component of links between texts whose multisets of ``size``-word shingles have a weighted
    Jaccard similarity of at least ``similarity`` (shingles are compared by 64-bit hashes); its id is its smallest document
    id. Texts with equal words are one text. Texts of fewer than ``size`` words are one shingle. Null, empty and blank
    texts link with nothing. Null ids come after all others and give a null ``class_id`` where no other id is in the class.
    Rows are classed by their texts, not by their ids: different texts with one id (or none) can be in different classes,
    and a row is ``kept`` if its id is its class's. Other columns are ignored; an empty table gives an empty one.
    """
    found = classes(docs, id_col, text_col, similarity, size, bands)
    real = lambda c: F.when(F.col(c) != int(NULL_ID), F.col(c))
    return found.select(real("id").alias(id_col), real("class_id").alias("class_id"), (F.col("id") == F.col("class_id")).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of ``near_duplicates``: that of its representative.

    Of rows with the representative's id and text, the smallest by its other columns in order. Null, empty and blank texts
    with one id count as one class for each text.
    """
    heads = classes(docs, id_col, text_col).select(F.col("class_id").alias("id"), F.col("class_h").alias("h")).distinct()
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*_named(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in (*others, text_col)]).alias("__q_row"))
    rows = rows.join(heads, ["id", "h"]).groupBy("id", "h").agg(F.min("__q_row").alias("__q_row"))
    return rows.select(*[F.col("__q_row").getField(c).alias(c) for c in docs.columns])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar.

    Pairs are dealt by ``a``, those of a text with many partners over several tasks; each task gets the texts that its
    pairs name, once.
    """
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.count("*").alias("d")).where(F.col("d") > PARTNERS)
    count, mean = pairs.count(), texts.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(2 * count * mean) // BYTES)
    salt = F.when(F.col("d").isNotNull(), F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / PARTNERS))).otherwise(0)
    dealt = materialize(pairs.join(many, "a", "left").select(F.pmod(F.xxhash64("a", salt), F.lit(slots)).alias("slot"), "a", "b"), "dealt", files_for(count, least=FEW))
    need = dealt.select(F.col("slot").alias("at"), F.explode(F.array("a", "b")).alias("node")).distinct()

    @released
    def judge(asked: pa.Table, named: pa.Table) -> pa.Table:
        node = named.column("node").to_numpy()
        order = np.argsort(node)
        blobs = named.column("text").take(pa.array(order)).to_pylist()
        a, b = (np.searchsorted(node[order], asked.column(c).to_numpy()) for c in ("a", "b"))
        good = Elements(blobs, size).similarities(a, b) >= similarity
        return asked.select(["a", "b"]).filter(pa.array(good))

    return dealt.groupBy("slot").cogroup(need.join(texts, "node").groupBy("at")).applyInArrow(judge, "a long, b long")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
