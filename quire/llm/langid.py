"""Language identification by cross-parsing: the language whose text needs fewest phrases to spell a document wins.

A suffix automaton of each language's labelled text recognises every substring of it. A document is parsed greedily: a
phrase is the longest match from where the last one ended. Phrases are normalised by the document's length and the bits
that name a place in the language's text. Symbols are the UTF-8 bytes of letters in lower case, so any script is learned
whole; a run of other characters is one symbol. All automata lie in one dense table and step through many documents at
once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quire.llm.common import held, release
from quire.llm.sample import held_out, labelled_sample

#: The bounds of the learning sample: rows of a language, characters of a row; bytes of a language's automaton, and of all.
ROWS, ROW_CHARS, BYTES, ALL_BYTES = 80, 600, 24_000, 1 << 18
#: Symbols of a piece; the pieces of a very long text are parsed side by side.
SEGMENT = 8192
UNKNOWN = "und"


class Automata:
    """Suffix automata of several texts over one alphabet, as a transition table with phrase counts."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        self.letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        spelled = [self.spelled(texts[k])[0] for k in self.langs]
        self.symbol = np.zeros(256, np.int32)  # 0: a byte that was not learned
        seen = np.unique(np.concatenate(spelled)) if spelled else np.empty(0, np.uint8)
        self.symbol[seen] = 1 + np.arange(len(seen))
        width = self.width = 1 + len(seen)
        tables, self.roots, self.bits, base = [], [], [], 0
        for data in spelled:
            table = automaton(self.symbol[data], width)
            root = table[0].copy()
            known = root >= 0
            # A missing step ends a phrase and begins the next one, or is a phrase by itself where the symbol is unknown.
            step = np.where(table >= 0, table * 4, np.where(known, np.where(known, root, 0) * 4 + 1, 2))
            step[0] = np.where(known, root * 4, 1)
            tables.append(((step.astype(np.int64) >> 2) + base) * width * 4 + (step & 3))
            self.roots.append(base * width)
            self.bits.append(math.log2(len(data) + 2))
            base += len(table)
        self.table = np.concatenate(tables).ravel().astype(np.int64 if base * width * 4 >= 1 << 31 else np.int32) if tables else np.zeros(0, np.int32)

    def spelled(self, text: str) -> tuple[np.ndarray, bool]:
        """Bytes of ``text`` in lower case, runs of other characters as one space, and whether it has a letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = self.letter[codes]
        codes = np.where(letter, codes, np.uint32(0x20))[np.concatenate((np.ones(min(1, len(codes)), bool), letter[1:] | letter[:-1]))]
        return np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), bool(letter.any())

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        data, has_letter = self.spelled(text)
        return self.symbol[data], has_letter

    def phrases(self, texts: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
        """Phrases of each text (row) in each language (column).

        Pieces of a long text are parsed side by side, each as if a phrase began with it. Then each piece is begun again in
        the state in which the piece before it ends, until both parses are in one state: what follows is the same. A
        text of which a piece is over before that is parsed again in one.
        """
        roots = np.array(self.roots, self.table.dtype)[:, None]
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = np.maximum(1, -(-sizes // segment))
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        flat = np.concatenate(texts) if texts else np.empty(0, np.int32)
        starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + number * segment
        lengths = np.minimum(segment, sizes[owner] - number * segment)
        state, total = self.parse(flat, starts, lengths, np.repeat(roots, len(owner), axis=1))
        later = np.flatnonzero(number > 0)
        lost = np.zeros(len(texts), bool)
        if len(later):
            last = number[later] == pieces[owner[later]] - 1
            more, end, met = self.resume(flat, starts[later], lengths[later], state[:, later - 1], np.repeat(roots, len(later), axis=1))
            total[:, later] += more
            cut = ~met.all(axis=0)
            state[:, later] = np.where(met, state[:, later], end)  # a last piece that is over too soon ends in the true state
            lost[owner[later[cut & ~last]]] = True
        finals = np.cumsum(pieces) - 1
        count = np.stack([np.bincount(owner, total[k], len(texts)) for k in range(len(self.langs))], axis=1).astype(np.int64) if self.langs else np.zeros((len(texts), 0), np.int64)
        count += (state[:, finals] != roots).T  # the phrase that the end cuts off
        for i in np.flatnonzero(lost).tolist():
            count[i] = self.phrases([texts[i]], max(segment, len(texts[i])))[0]
        return count

    def parse(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states in which pieces end, and how many phrases end in them."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], np.ascontiguousarray(state[:, order])
        total = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")
        for j, a in enumerate(active.tolist()):
            v = self.table[state[:, :a] + flat[starts[:a] + j]]
            total[:, :a] += v & 3
            state[:, :a] = v >> 2
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[:, back], total[:, back]

    def resume(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases more if pieces begin in ``state`` than in ``fresh``, the states at the end or meeting, and which met."""
        state, fresh, more = state.copy(), fresh.copy(), np.zeros(state.shape, np.int64)
        met, j = state == fresh, 0
        while True:
            at = np.flatnonzero((lengths > j) & ~met.all(axis=0))
            if not len(at):
                return more, state, met
            symbol = flat[starts[at] + j]
            v, w = self.table[state[:, at] + symbol], self.table[fresh[:, at] + symbol]
            more[:, at] += (v & 3).astype(np.int64) - (w & 3)
            state[:, at], fresh[:, at] = v >> 2, w >> 2
            met[:, at] |= state[:, at] == fresh[:, at]
            j += 1


def automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of ``codes`` as a table state x symbol -> state, -1 where there is none."""
    size = 2 * len(codes) + 2
    step = [None] * size
    link, length = [-1] * size, [0] * size
    step[0] = {}
    last, used = 0, 1
    for c in codes.tolist():
        cur = used
        used += 1
        length[cur], step[cur] = length[last] + 1, {}
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = used
                used += 1
                length[clone], step[clone], link[clone] = length[p] + 1, dict(step[q]), link[q]
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((used, width), -1, np.int32)
    for s in range(used):
        d = step[s]
        table[s, list(d.keys())] = list(d.values())
    return table


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Text of each language: up to ``ROW_CHARS`` characters of each of at most ``ROWS`` rows that are not held out.

    A language gets about ``BYTES`` bytes, less where all would get more than ``ALL_BYTES``; its rows give equal parts of that.
    Labels of which no chosen row has a letter are not learned.
    """
    rows = labelled_sample(docs, ROWS, ROW_CHARS, id_col, text_col, lang_col, ~held_out(id_col)).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["__q_lang"], r["__q_rank"])):
        if any(c.isalpha() for c in r["__q_sample"]):
            found.setdefault(r["__q_lang"], []).append(r["__q_sample"])
    room = min(BYTES, ALL_BYTES // max(1, len(found)))
    texts = {}
    for lang, parts in found.items():
        joined, size = [], 0
        for part in parts:
            joined.append(part[: max(16, room // 4)])
            size += len(joined[-1].encode("utf-8", "replace"))
            if size >= room:
                break
        texts[lang] = "\n".join(joined)
    return texts


def identify(docs: DataFrame, model: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``phrase_rate``; columns of these names are replaced.

    ``lang_pred`` is a key of ``model`` or ``und`` for a null text, a text without letters, or an empty model. ``score`` is
    the margin, 1 - best / second best (1 if one language is known, 0 for ``und`` and ties). ``phrase_rate`` is the
    best language's phrases for each symbol. Ties go to the first language in order of name. The whole text is parsed.
    """
    key = hash(tuple(sorted(model.items())))
    out = docs.drop("lang_pred", "score", "phrase_rate")
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("phrase_rate", DoubleType())]
    schema = StructType([*out.schema.fields, *made])
    at = out.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held("langid")
        if key not in known:
            known.clear()
            known[key] = Automata(model)
            release()
        m = known[key]
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                yield judged(m, some, some.column(at).to_pylist())
        release()

    def judged(m: Automata, some: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        made = [m.symbols(t or "") for t in texts]
        n = np.array([max(1, len(s)) for s, _ in made], float)
        names, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if m.langs:
            count = m.phrases([s for s, _ in made])
            cost = count * np.array(m.bits) / n[:, None]
            best = cost.argmin(axis=1)
            least = cost.min(axis=1)
            if len(m.langs) > 1:
                second = np.partition(cost, 1, axis=1)[:, 1]
                scores = np.where(second > 0, 1 - least / np.where(second > 0, second, 1), 0.0)
            else:
                scores = np.ones(len(texts))
            rates = count[np.arange(len(texts)), best] / n
            some_letter = np.array([x for _, x in made], bool)
            names = [m.langs[b] if x else UNKNOWN for b, x in zip(best.tolist(), some_letter.tolist(), strict=True)]
            scores = np.where(some_letter, np.clip(scores, 0, 1), 0.0)
        return pa.RecordBatch.from_arrays([*some.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(rates)], names=schema.names)

    return out.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
