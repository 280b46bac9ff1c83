"""Substring dedup: words covered by a window of 50 words that also starts in an earlier document.

Prefix-partitioned suffix trees: ``quire.llm.repeats`` divides suffixes among tasks by their prefixes, which are longer
where many suffixes share one. Within a task, prefixes grow by a word until the suffixes that share one fit ``GROUP``; each
such group gets its own subtree, built from its sorted suffixes and their common prefix lengths. The internal nodes at
the window's depth or below are the repeats: the leaves under the highest of them start with the same window. Every
window that may repeat is a leaf of one subtree, whatever the number of documents that have it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import word_spans
from quire.llm.repeats import repeated, runs, spread

WINDOW = 50
#: Suffixes that one subtree may hold in memory.
GROUP = 1 << 17


def tree_classes(window: int, most: int = GROUP):
    """A resolver: the class of each window from suffix trees over groups of suffixes with one variable-length prefix.

    Prefixes that few suffixes share are grouped together; of one that too many share, a word longer ones are taken.
    """

    def resolve(text: np.ndarray, offsets: np.ndarray, windows: np.ndarray, group: np.ndarray) -> np.ndarray:
        raw = np.insert(text, offsets[1:-1], 0x20).astype(np.uint8)  # a space between contents
        starts, _ = word_spans(raw)
        numbers: dict[bytes, int] = {}
        word = np.array([numbers.setdefault(w, len(numbers)) for w in raw.tobytes().split(b" ") if w], np.int64)
        names = Names(word, window)
        first = np.searchsorted(starts, offsets[:-1] + np.arange(len(windows)))
        at = spread(first, windows)
        classes = np.full(len(at), -1, np.int64)
        done = 0
        stack = [(np.arange(len(at)), 0)]
        while stack:
            suffixes, depth = stack.pop()
            if len(suffixes) > most and depth < window:
                key = word[at[suffixes] + depth]
                order = np.argsort(key, kind="stable")
                edge = runs(key[order])
                size = np.diff(np.append(edge, len(order)))
                own = size > most  # such a prefix is a group of its own, to be split again
                shelf = np.cumsum(np.where(own, 0, size)) // most
                new = np.concatenate(([True], (shelf[1:] != shelf[:-1]) | own[1:] | own[:-1]))
                parts = np.split(order, edge[new][1:])
                stack += [(suffixes[part], depth + 1 if alone else window) for part, alone in zip(parts, own[new].tolist(), strict=True)]
                continue
            leaves, lcp = names.subtree(at[suffixes])
            label = np.arange(len(leaves))
            left, right = deep_nodes(lcp, window)
            label[spread(left, right - left)] = np.repeat(left, right - left)
            classes[suffixes[leaves]] = done + label
            done += len(leaves)
        return classes

    return resolve


class Names:
    """Numbers for the stretches of 1, 2, 4, 8... words at each place of a text, equal and ordered as the stretches are."""

    def __init__(self, word: np.ndarray, window: int) -> None:
        self.window, self.of, size = window, {1: word}, 1
        while 2 * size <= window:
            have = self.of[size]
            after = np.concatenate((have[size:], np.full(min(size, len(have)), -1, np.int64)))
            size *= 2
            self.of[size] = np.unique(have * (int(have.max(initial=0)) + 2) + after + 1, return_inverse=True)[1]

    def subtree(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves of the tree of some suffixes in order, and the depth of the lowest common node of each two neighbours, to the window."""
        keys, depth = [], 0
        for size in sorted(self.of, reverse=True):
            if depth + size <= self.window:
                keys.append(self.of[size][at + depth])
                depth += size
        order = np.lexsort(keys[::-1])
        a, b = at[order][:-1], at[order][1:]
        lcp = np.zeros(len(a), np.int64)
        for size in sorted(self.of, reverse=True):
            fits = np.flatnonzero(lcp + size <= self.window)
            x, y = a[fits] + lcp[fits], b[fits] + lcp[fits]
            lcp[fits] += size * (self.of[size][x] == self.of[size][y])
        return order, lcp


def deep_nodes(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest internal nodes at depth ``least`` or below: the first leaf under each, and the one after its last."""
    deep = np.concatenate(([False], lcp >= least, [False])).astype(np.int8)
    edge = np.diff(deep)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Each row of ``docs`` without the words covered by a ``window``-word sequence that starts in a smaller document too.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Returns ``id_col``, ``n_words``, ``n_removed`` and ``kept`` (binary: kept
    words joined by one space, UTF-8). Null, empty and blank texts have no words. Texts shorter than the window lose
    nothing. A null id is larger than every id; rows with one id never remove one another's words. Other columns are
    ignored. Windows are judged on the input.
    """

    def finish(table: pa.Table, removed: list[np.ndarray]) -> pa.Table:
        kept = [b" ".join(w for w, m in zip(_words(t or b""), mask.tolist(), strict=True) if not m) for t, mask in zip(table.column("__q_text").to_pylist(), removed, strict=True)]
        return pa.table({"__q_id": table.column("__q_id"), "n_words": pa.array([len(m) for m in removed], pa.int64()), "n_removed": pa.array([int(m.sum()) for m in removed], pa.int64()), "kept": pa.array(kept, pa.binary())})

    out = repeated(docs, id_col, text_col, window, True, tree_classes(window), finish, "__q_id long, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("__q_id", id_col)


_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _words(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_SPACES).split(b" ") if w]


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
