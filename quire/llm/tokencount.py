"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton finds every vocabulary piece in a word; dynamic programming keeps, for each place, the best score
and the number of pieces of the path that has it. No path is stored. Ties and unknown characters follow the tokenizers
library's unigram model: a later path must be better to win, so of equal ones that with the earliest start of its last
piece stays; a character without a piece of its own costs the smallest score less ten; unknown characters that follow
one another count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held

PIECES = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBER = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's ordinary pieces.

    No unigram file is at hand, so the scores of this vocabulary are a stand-in: the logarithm of a Zipf share of the piece's
    rank in the file. ``count_tokens`` takes any pieces and scores in its place.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return [(model.id_to_piece(i), -math.log(k + 2.0)) for k, i in enumerate(ranked)]


class Counter(dict):
    """Pieces of a word (what stands between two spaces), by word; long words are counted and not kept."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        super().__init__()
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            self.find.add_word(piece, (len(piece), score))
        if pieces:
            self.find.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        n = self.pieces_of(SPACE + word)
        if len(word) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = n
        return n

    def pieces_of(self, text: str) -> int:
        """Pieces of a text; matches are taken as the automaton finds them, by the place where they end."""
        size, keep = len(text), self.longest
        # Of the places before, only as many as the longest piece has characters are remembered.
        score, count, lost = [0.0] * (keep + 1), [0] * (keep + 1), [False] * (keep + 1)
        found = iter(self.find.iter(text) if len(self.find) else ())
        end, match = next(found, (size, None))
        for at in range(1, size + 1):
            best, start, single = -math.inf, -1, False
            while end == at - 1 and match is not None:
                length, value = match
                end, match = next(found, (size, None))
                if length == 1:
                    single = True
                s = at - length
                got = value + score[s % (keep + 1)]
                if got > best or (got == best and s < start):
                    best, start = got, s
            if not single:  # the last to be tried, so it must be better
                last = (at - 1) % (keep + 1)
                got = self.unknown + score[last]
                if got > best or start < 0:
                    here = at % (keep + 1)
                    score[here], count[here], lost[here] = got, count[last] + (0 if lost[last] else 1), True
                    continue
            here = at % (keep + 1)
            score[here], count[here], lost[here] = best, count[start % (keep + 1)] + 1, False
        return count[size % (keep + 1)]

    def tokens(self, text: str) -> tuple[int, int]:
        """Words and pieces of a text."""
        if not text:
            return 0, 0
        words = text.replace(" ", SPACE).split(SPACE)
        if not words[0]:
            words = words[1:]
        return len(words), sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """``id_col``, ``n_words`` (stretches that begin at a space or at the start) and ``n_tokens`` of each row's whole text.

    The vocabulary is ``pieces`` (with their log probabilities) or that of the file ``path``, whose scores are a stand-in (see
    ``vocabulary``). Null and empty texts have none. A text of any length needs memory for one word's automaton only. Rows are counted one by one: repeated rows and null ids stay, other columns are ignored.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("__q_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__q_text"))
    schema = rows.drop("__q_text").schema.add("n_words", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = path if pieces is None else str(hash(tuple(pieces)))
        known = held("tokencount")
        if name not in known:
            known.clear()
            known[name] = Counter(vocabulary(path) if pieces is None else pieces)
        counter = known[name]
        for batch in batches:
            found = [counter.tokens(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("__q_id", id_col)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
