"""Windows of ``window`` consecutive tokens that repeat across documents: the distributed part of both substring dedups.

Tokens are the bytes of a text or its words. Suffixes are sampled: every window chooses the run of ``ANCHOR`` tokens in it
with the smallest hash, its *anchor*. Equal windows choose equal runs at the same place, so a window can repeat only where
its anchor, as the prefix of the suffix that begins there, does; suffixes are divided among tasks by that prefix. The
plan, all over one shuffle of the documents into *blocks* of bounded size:

1. ``anchors``: a block sends each distinct prefix's hash once to a bucket.
2. ``shared``: a bucket tells the blocks which of their prefixes occur in two documents or more, and which are *hot*
   (more than ``HOT`` different surroundings).
3. ``suffixes``: a block sends each distinct run of windows with one shared prefix, as the tokens that they span, once to
   the bin of the prefix, with the smallest and the largest document that has it. For hot prefixes the prefix is made
   longer, to the whole window, so no bin gathers a common phrase.
4. ``resolve``: a bin divides all windows into classes by the caller's method (a suffix tree, a radix sort) and answers, for
   each content, the smallest document in which its windows start.
5. ``last``: a block finds its contents again and marks the tokens that windows of larger documents cover.

Every message is a compressed pack per (block, bucket): a key or a passage that a third of all documents hold is one entry
for each block. Hashes only choose places, and tokens decide equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BYTE_HASH, IS_SEP, NULL_ID, held, mix, parts_for, release, released, rolling, sized, word_hashes, word_spans

ANCHOR = 16
#: Different surroundings of an anchor from which the prefix is the whole window.
HOT = 1024
CHUNK = 1 << 18
BLOCK_BYTES = 8 << 20
LOW = np.uint64(0xFFFFFF)

#: (tokens' bytes, offsets of the contents, windows of each content, anchor group of each content) -> class of each window. It decides
#: alone which tokens are equal; an attribute ``same`` takes (bytes, starts, lengths, group) of whole runs -> class of each run.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message; each keeps its type and length."""
    head = np.array([len(arrays), *[len(a) for a in arrays], *[ord(a.dtype.char) for a in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)
    at, out = 8 * (1 + 2 * n), []
    for size, kind in zip(head[1 : 1 + n], head[1 + n :], strict=True):
        a = np.frombuffer(raw, np.dtype(chr(kind)), int(size), at)
        at += a.nbytes
        out.append(a)
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all segments, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


def segments(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs of equal neighbours."""
    at = runs(values)
    return zip(at.tolist(), [*at[1:].tolist(), len(values)] if len(at) else [], strict=True)


class Chunk:
    """Some whole documents, tokenized: bytes, token spans and each document's first token."""

    def __init__(self, texts: list[bytes], words: bool) -> None:
        sizes = np.array([len(t) + words for t in texts], np.int64)
        buf = np.frombuffer((b" ".join(texts) + b" ") if words else b"".join(texts), np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes)))
        self.words = words
        if words:
            is_sep = IS_SEP[buf]
            keep = ~is_sep
            keep[1:] |= ~is_sep[:-1]  # a word and one separator after it
            self.buf = np.where(is_sep, np.uint8(0x20), buf)[keep]
            self.starts, self.ends = word_spans(self.buf)
            where, _ = word_spans(buf)
            self.first = np.searchsorted(where, first)
            self.tokens = word_hashes(self.buf, self.starts, self.ends)
        else:
            self.buf, self.first = buf, first
            self.tokens = BYTE_HASH[buf]
        self.n = len(self.tokens)

    def contents(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``count`` tokens from each of ``at``, and their lengths."""
        if self.words:
            starts = self.starts[at]
            lengths = self.ends[at + count - 1] - starts
        else:
            starts, lengths = at, count
        return self.buf[spread(starts, lengths)], lengths

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: its hash, the first window (token), how many, and the hash of all anchors."""
        k = min(ANCHOR, window)
        h = rolling(self.tokens, k)
        none = np.empty(0, np.int64)
        if self.n < window:
            return np.empty(0, np.uint64), none, none, h
        key = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        span, least = 1, key
        want = window - k + 1
        while span * 2 <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < want:
            least = np.minimum(least[: -(want - span)], least[want - span :])
        pos = (least & LOW).astype(np.int64)
        counts = np.diff(self.first)
        first = spread(self.first[:-1], np.maximum(0, counts - window + 1))  # windows that end in their document
        pos = pos[first]
        doc_edge = np.zeros(len(first), bool)
        doc_edge[1:] = first[1:] != first[:-1] + 1
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(pos)), bool), (pos[1:] != pos[:-1]) | doc_edge[1:])))
        return h[pos[new]], first[new], np.diff(np.append(new, len(pos))), h


def chunks(texts: list[bytes], words: bool) -> Iterator[tuple[int, Chunk]]:
    """``texts`` in chunks of about ``CHUNK`` bytes, a text always whole; positions in a chunk stay under 2**24 unless one text is longer."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, Chunk(texts[at:i], words)
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, Chunk(texts[at:], words)


def _pieces(texts: list[bytes], words: bool, window: int) -> Iterator[tuple[int, int, Chunk]]:
    """Chunks whose token positions fit 24 bits: a longer text comes in pieces that overlap by a window less one token.

    Gives the row of the first text, the tokens that come before the piece, and the chunk.
    """
    for row, chunk in chunks(texts, words):
        limit = 1 << 23
        if chunk.n <= limit:
            yield row, 0, chunk
            continue
        for j in range(len(chunk.first) - 1):
            a, b = int(chunk.first[j]), int(chunk.first[j + 1])
            for at in range(a, max(a + 1, b - window + 1), limit):
                piece = Chunk.__new__(Chunk)
                end = min(b, at + limit + window - 1)
                piece.words, piece.buf = words, chunk.buf
                piece.tokens = chunk.tokens[at:end]
                piece.n, piece.first = end - at, np.array([0, end - at])
                if words:
                    piece.starts, piece.ends = chunk.starts[at:end], chunk.ends[at:end]
                else:
                    piece.buf = chunk.buf[at:end]
                yield row + j, at - a, piece


def _around(h: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """A hash of what a run of windows spans, to tell surroundings apart: its first and last anchors and its length."""
    k = min(ANCHOR, window)
    last = first + count - 1 + window - k
    return mix(h[first] ^ (h[last] * np.uint64(3)) ^ count.astype(np.uint64))


def _rows(table: pa.Table) -> tuple[np.ndarray, list[bytes], list[int]]:
    """A block's ids and texts in an order that does not hang on the order of arrival."""
    ids = table.column("__q_id").to_pylist()
    texts = [t or b"" for t in table.column("__q_text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return np.array([NULL_ID if ids[i] is None else ids[i] for i in order], np.int64), [texts[i] for i in order], order


def _split_rows(block: int, bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """One message for each bucket; ``arrays`` and ``bucket`` must be sorted by bucket."""
    for a, b in segments(bucket):
        yield int(bucket[a]), block, pack(*[x[a:b] for x in arrays])


def _batch(rows: list[tuple[int, int, bytes]], names: tuple[str, str]) -> pa.Table:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({names[0]: pa.array(a, pa.int64()), names[1]: pa.array(b, pa.int64()), "__q_blob": pa.array(c, pa.binary())})


MESSAGE = "__q_bucket long, __q_block long, __q_blob binary"
ANSWER = "__q_block long, __q_bucket long, __q_blob binary"


def _doc_of(chunk: Chunk, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(chunk.first, first, side="right") - 1


def repeated(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    window: int,
    words: bool,
    resolver: Resolver,
    finish: Callable[[pa.Table, list[np.ndarray]], pa.Table],
    schema: str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Documents with the tokens that repeat an earlier document's windows, as ``finish`` reports them.

    ``finish(block, removed)`` gets a block's rows (``__q_id``, ``__q_text`` as bytes, and the columns ``keep`` renamed
    ``__q_k0``, ``__q_k1``...) and, for each row, the boolean mask of its removed tokens; it returns a table of ``schema``.
    Null texts have no tokens. A null id counts as larger than all ids. Rows with equal ids never remove one another's
    tokens. Nothing depends on the order of rows.
    """
    docs = sized(docs.select(id_col, text_col, *(c for c in keep if c not in (id_col, text_col))))
    extra = [F.col(f"`{c}`").alias(f"__q_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("__q_id"), F.col(text_col).cast("binary").alias("__q_text"), *extra)
    blocks = parts_for(docs.select(id_col, text_col), BLOCK_BYTES)
    buckets, bins = blocks, 4 * blocks
    rows = rows.withColumn("__q_block", F.pmod(F.xxhash64("__q_id", "__q_text"), F.lit(blocks)).cast("long"))
    rows = rows.repartition(blocks, "__q_block")

    def anchors(table: pa.Table) -> pa.Table:
        block = table.column("__q_block")[0].as_py()
        ids, texts, _ = _rows(table)
        hs, docs_, arounds = [], [], []
        for row, _, chunk in _pieces(texts, words, window):
            h, first, count, every = chunk.anchors(window)
            hs.append(h)
            docs_.append(ids[row + _doc_of(chunk, first)])
            arounds.append(_around(every, first, count, window))
        h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
        if not len(h):
            return _batch([], ("__q_bucket", "__q_block"))
        doc, around = np.concatenate(docs_), np.concatenate(arounds)
        order = np.argsort(h, kind="stable")
        h, doc, around = h[order], doc[order], around[order]
        at = runs(h)
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        size = np.diff(np.append(at, len(h)))
        kinds = np.ones(len(at), np.int64)
        many = np.flatnonzero(size > 1)
        if len(many):  # different surroundings, counted only where there can be any
            idx = spread(at[many], size[many])
            group, a = np.repeat(np.arange(len(many)), size[many]), around[idx]
            o = np.lexsort((a, group))
            new = np.concatenate(([True], (group[o][1:] != group[o][:-1]) | (a[o][1:] != a[o][:-1])))
            kinds[many] = np.bincount(group[o][new], minlength=len(many))
        h = h[at]
        bucket = ((h & LOW) % np.uint64(buckets)).astype(np.int64)
        flag = np.minimum(kinds, 127).astype(np.uint8) | (several.astype(np.uint8) << 7)
        order = np.argsort(bucket, kind="stable")
        bucket, rest, flag = bucket[order], (h >> np.uint64(24))[order], flag[order]
        low, high = rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)
        return _batch(list(_split_rows(block, bucket, [low, high, flag])), ("__q_bucket", "__q_block"))

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole blocks; each is handled by itself."""
        held()
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        number = table.column("__q_block").to_numpy()
        for b in np.unique(number):
            yield from anchors(table.filter(pa.array(number == b))).combine_chunks().to_batches()
        release()

    def shared(table: pa.Table) -> pa.Table:
        bucket = table.column("__q_bucket")[0].as_py()
        block = table.column("__q_block").to_numpy()
        parts = [unpack(x) for x in table.column("__q_blob").to_pylist()]
        rest = np.concatenate([p[0].astype(np.uint64) | (p[1].astype(np.uint64) << np.uint64(32)) for p in parts])
        flag = np.concatenate([p[2] for p in parts])
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(rest, kind="stable")
        at = runs(rest[order])
        size = np.diff(np.append(at, len(rest)))
        is_shared = (size > 1) | (np.maximum.reduceat(flag[order], at) >= 128)
        hot = np.add.reduceat((flag[order] & 127).astype(np.int64), at) > HOT
        pick = np.repeat(is_shared, size)
        chosen, heat = order[pick], np.repeat(hot, size)[pick]
        by = np.argsort(owner[chosen], kind="stable")
        chosen, heat = chosen[by], heat[by]
        who = owner[chosen]
        out = []
        for a, b in segments(who):
            r = rest[chosen[a:b]]
            out.append((int(block[who[a]]), bucket, pack(r.astype(np.uint32), (r >> np.uint64(32)).astype(np.uint8), heat[a:b].astype(np.uint8))))
        return _batch(out, ("__q_block", "__q_bucket"))

    def contents(texts: list[bytes], ids: np.ndarray, blobs: list[tuple[int, bytes]]) -> Contents | None:
        """The distinct contents of a block's runs of windows with a shared prefix; the same ones in the same order each time."""
        if not blobs or not texts:
            return None
        keys, heats = [], []
        for bucket, blob in blobs:
            low, high, heat = unpack(blob)
            keys.append((low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))) * np.uint64(buckets) + np.uint64(bucket))
            heats.append(heat)
        known, heat = np.concatenate(keys), np.concatenate(heats)
        order = np.argsort(known)
        known, heat = known[order], heat[order]
        parts: list[tuple] = []
        for row, before, chunk in _pieces(texts, words, window):
            h, first, count, every = chunk.anchors(window)
            key = (h >> np.uint64(24)) * np.uint64(buckets) + (h & LOW) % np.uint64(buckets)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            found = known[at] == key
            h, first, count, hot = h[found], first[found], count[found], heat[at[found]].astype(bool)
            if hot.any():  # the prefix is the whole window
                single = spread(first[hot], count[hot])
                k = min(ANCHOR, window)
                own = every[single]
                for step in range(k, window, k):
                    own = mix(own * np.uint64(5) + every[single + min(step, window - k)])
                h = np.concatenate((h[~hot], own))
                first = np.concatenate((first[~hot], single))
                count = np.concatenate((count[~hot], np.ones(len(single), np.int64)))
            if not len(h):
                continue
            local = _doc_of(chunk, first)
            content, lengths = chunk.contents(first, count + window - 1)
            parts.append((h, count, (row + local).astype(np.int64), first - chunk.first[local] + before, lengths, content))
        if not parts:
            return None
        h, count, row, pos, lengths = (np.concatenate([p[i] for p in parts]) for i in range(5))
        content = np.concatenate([p[5] for p in parts])
        return Contents(h, count, row, pos, ids, lengths, content, bins, resolver)

    @released
    def suffixes(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return _batch([], ("__q_bucket", "__q_block"))
        block = table.column("__q_block")[0].as_py()
        ids, texts, _ = _rows(table)
        c = contents(texts, ids, _by_bucket(told))
        out = []
        for a, b in segments(c.bucket) if c else ():  # contents are gathered bucket by bucket
            o = c.lead[a:b]
            out.append((int(c.bucket[a]), block, pack(c.h[o], c.count[o].astype(np.uint16), c.least[a:b], c.most[a:b], c.lengths[o].astype(np.uint32), c.content[spread(c.starts[o], c.lengths[o])])))
        return _batch(out, ("__q_bucket", "__q_block"))

    @released
    def resolve(table: pa.Table) -> pa.Table:
        bucket = table.column("__q_bucket")[0].as_py()
        block = table.column("__q_block").to_numpy()
        parts = [unpack(x) for x in table.column("__q_blob").to_pylist()]
        sizes = np.array([len(p[0]) for p in parts])
        h, count, least, most, lengths, content = (np.concatenate([p[i] for p in parts]) for i in range(6))
        del parts
        entry, start, number, doc = answers(h, count.astype(np.int64), least, most, lengths.astype(np.int64), content, resolver)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        within = spread(np.zeros(len(sizes), np.int64), sizes)
        who = owner[entry]
        out = []
        for a, b in segments(who):
            out.append((int(block[who[a]]), bucket, pack(within[entry[a:b]].astype(np.uint32), start[a:b].astype(np.uint16), number[a:b].astype(np.uint16), doc[a:b])))
        return _batch(out, ("__q_block", "__q_bucket"))

    names = ["__q_id", "__q_text", *[f"__q_k{i}" for i in range(len(keep))]]

    def apply(table: pa.Table, heard: pa.Table) -> pa.Table:
        ids, texts, order = _rows(table)
        table = table.select(names).take(pa.array(order, pa.int64()))
        answered = heard.column("__q_answer").to_numpy(zero_copy_only=False).astype(bool)
        c = contents(texts, ids, _by_bucket(heard.filter(pa.array(~answered)))) if answered.any() else None
        row, pos, number = c.covered(_by_bucket(heard.filter(pa.array(answered))), ids) if c else (np.empty(0, np.int64),) * 3
        edge = np.searchsorted(row, np.arange(len(texts) + 1))
        removed = []
        for i, t in enumerate(texts):
            n = len(word_spans(np.frombuffer(t, np.uint8))[0]) if words else len(t)
            a, b = edge[i], edge[i + 1]
            if a == b:
                removed.append(np.zeros(n, bool))
                continue
            delta = np.bincount(pos[a:b], minlength=n + 1) - np.bincount(pos[a:b] + number[a:b] + window - 1, minlength=n + 1)
            removed.append(np.cumsum(delta[:-1]) > 0)
        return finish(table, removed)

    sent = rows.mapInArrow(by_block, MESSAGE)
    told = sent.groupBy("__q_bucket").applyInArrow(shared, ANSWER)
    grouped = rows.groupBy("__q_block")
    spans = grouped.cogroup(told.groupBy("__q_block")).applyInArrow(suffixes, MESSAGE)
    marks = spans.groupBy("__q_bucket").applyInArrow(resolve, ANSWER)
    heard = told.withColumn("__q_answer", F.lit(False)).unionByName(marks.withColumn("__q_answer", F.lit(True)))

    @released
    def last(table: pa.Table, heard: pa.Table) -> pa.Table:
        return apply(table, heard) if table.num_rows else finish(table.select(names), [])

    return grouped.cogroup(heard.groupBy("__q_block")).applyInArrow(last, schema)


def _by_bucket(messages: pa.Table) -> list[tuple[int, bytes]]:
    return sorted(zip(messages.column("__q_bucket").to_pylist(), messages.column("__q_blob").to_pylist(), strict=True))


class Contents:
    """Runs of windows of a block, and their distinct contents sorted by bin.

    ``lead``: the first run of each content; ``bucket``, ``least`` and ``most``: its bin, and the smallest and largest ids
    of documents that have it; ``kind``: the content of each run.
    """

    def __init__(self, h: np.ndarray, count: np.ndarray, row: np.ndarray, pos: np.ndarray, ids: np.ndarray, lengths: np.ndarray, content: np.ndarray, bins: int, resolver: Resolver) -> None:
        self.h, self.count, self.row, self.pos, self.lengths, self.content = h, count, row, pos, lengths, content
        self.starts = np.cumsum(lengths) - lengths
        kind, lead = kinds(resolver, h, self.starts, lengths, content)
        bucket = (mix(h[lead]) % np.uint64(bins)).astype(np.int64)
        order = np.lexsort((lead, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.kind, self.lead, self.bucket = place[kind], lead[order], bucket[order]
        self.least, self.most = np.full(len(lead), NULL_ID, np.int64), np.full(len(lead), np.iinfo(np.int64).min, np.int64)
        np.minimum.at(self.least, self.kind, ids[row])
        np.maximum.at(self.most, self.kind, ids[row])

    def covered(self, told: list[tuple[int, bytes]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first window and how many windows that also start in a smaller document, sorted by row."""
        base = dict(zip(self.bucket[runs(self.bucket)].tolist(), runs(self.bucket).tolist(), strict=True))
        got = [(base[bucket], unpack(blob)) for bucket, blob in told]
        kind = np.concatenate([b + p[0].astype(np.int64) for b, p in got])
        start, number, least = (np.concatenate([p[i] for _, p in got]) for i in (1, 2, 3))
        by = np.argsort(self.kind, kind="stable")
        first = np.searchsorted(self.kind[by], np.arange(len(self.lead) + 1))
        copies = first[kind + 1] - first[kind]
        run = by[spread(first[kind], copies)]
        start, number, least = (np.repeat(x.astype(np.int64), copies) for x in (start, number, least))
        yes = least < ids[self.row[run]]
        run, start, number = run[yes], start[yes], number[yes]
        order = np.argsort(self.row[run], kind="stable")
        run, start, number = run[order], start[order], number[order]
        return self.row[run], self.pos[run] + start, number


DIGIT = 8


def by_prefix(content: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The class of each run, equal for runs of one group with equal bytes: the prefix that runs share grows until each is alone or ends.

    A pass takes the next ``DIGIT`` bytes of the runs that still share all before them, so a group of runs is split as the
    branches below a node of their tree are, and a run that is alone leaves. Runs of one length that are read to their end are equal.
    """
    classes = np.full(len(starts), -1, np.int64)
    padded = np.concatenate((content, np.zeros(DIGIT, np.uint8)))
    words = np.ndarray((len(content) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    done, depth, alive, parent, digit = 0, 0, np.arange(len(starts)), group, lengths
    while len(alive):
        order = np.lexsort((digit, parent))
        g, d = parent[order], digit[order]
        edge = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]))))
        size = np.diff(np.append(edge, len(order)))
        alone = np.repeat(size == 1, size)
        lone = alive[order[alone]]
        classes[lone] = done + np.arange(len(lone))
        done += len(lone)
        alive, parent = alive[order[~alone]], np.repeat(np.arange(len(edge)), size)[~alone]
        left = lengths[alive] - depth
        ended = left <= 0
        if ended.any():
            names, number = np.unique(parent[ended], return_inverse=True)
            classes[alive[ended]] = done + number
            done += len(names)
            alive, parent, left = alive[~ended], parent[~ended], left[~ended]
        digit = words[starts[alive] + depth]
        short = left < DIGIT
        digit[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        depth += DIGIT
    return classes


def kinds(resolver: Resolver, h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each run, equal for runs that the resolver finds equal (its ``same``, else ``by_prefix``), and the first run of each kind."""
    same = getattr(resolver, "same", by_prefix)
    _, lead, kind = np.unique(same(content, starts, lengths, np.unique(h, return_inverse=True)[1]), return_index=True, return_inverse=True)
    return kind, lead


def answers(h: np.ndarray, count: np.ndarray, least: np.ndarray, most: np.ndarray, lengths: np.ndarray, content: np.ndarray, resolver: Resolver) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each entry, runs of windows that start in a smaller document than its largest: (entry, first window, how many, document)."""
    starts = np.cumsum(lengths) - lengths
    kind, lead = kinds(resolver, h, starts, lengths, content)
    smallest = np.full(len(lead), NULL_ID, np.int64)
    np.minimum.at(smallest, kind, least)
    n, windows = lengths[lead], count[lead]
    text = content[spread(starts[lead], n)]
    classes = resolver(text, np.concatenate(([0], np.cumsum(n))), windows, np.unique(h[lead], return_inverse=True)[1])
    first = np.cumsum(windows) - windows
    best = np.full(int(classes.max()) + 1, NULL_ID, np.int64)
    np.minimum.at(best, classes, np.repeat(smallest, windows))
    answer = best[classes]
    out = []
    for a in range(0, len(h), 1 << 16):
        m = np.arange(a, min(len(h), a + (1 << 16)))
        w = count[m]
        got = answer[spread(first[kind[m]], w)]
        run_of = np.repeat(np.arange(len(m)), w)
        edge = np.flatnonzero(np.concatenate(([True], (got[1:] != got[:-1]) | (run_of[1:] != run_of[:-1]))))
        long = np.diff(np.append(edge, len(got)))
        keep = got[edge] < most[m][run_of[edge]]
        edge, long = edge[keep], long[keep]
        base = (np.cumsum(w) - w)[run_of[edge]]
        out.append((m[run_of[edge]], edge - base, long, got[edge]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))  # type: ignore[return-value]
