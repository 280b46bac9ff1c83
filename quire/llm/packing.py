"""Packing documents into sequences along a space-filling curve.

A document's tokens are hashed into a vector of signed counts, which a fixed random matrix projects to a few dimensions; its place on
the Hilbert curve through them is its key. Documents are sorted into ranges of keys, and each range is packed one document
after another along the curve, so a sequence holds neighbours. Sequences are filled to the last token; what a range has left at
its end becomes sequences of powers of two, so that nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import byte_letters
from quire.llm.common import held, materialize, mix, parts_for

TOKENIZER = "word_bpe_49k.json"
LONGEST, END = 2048, 1
#: Values of a hashed vector, dimensions of the curve, bits of each.
HASHED, DIMENSIONS, BITS = 1024, 4, 12
#: Bytes of tokens in a range, about.
RANGE_BYTES = 4 << 20
#: Pieces whose tokens a worker remembers; when full it forgets them all. Pieces of over ``SHORT`` letters are not remembered.
REMEMBER, SHORT = 400_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# ---------------------------------------------------------------- tokens


class WordTokens:
    """Ids of a word-level BPE file as bytes, piece by piece: the split pattern parts words that never influence each other.

    Texts of Latin letters and common punctuation are lower-cased and split here, and the library's model encodes each distinct piece.
    Every other text goes to the library whole.
    """

    #: White space, ASCII and the letters of Latin-1; such letters, Latin Extended-A but for the one that lower-cases to two
    #: characters, and common punctuation.
    LATIN1 = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0x100)])
    OTHER = "[^\t\n\r -~À-įı-ſ‐-‧]"
    LETTERS = "a-zß-öø-ſ"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = self.is_known(spec)
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.other = re.compile(self.OTHER).search
        # What the file's pattern finds in such texts; only the contractions must come before other signs.
        self.find = re.compile(rf"[{self.LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9{self.LETTERS}]+").findall
        self.known: dict[str, bytes] = {}

    @staticmethod
    def is_known(spec: dict) -> bool:
        """Whether the file normalises and splits as is supposed here."""
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = next((p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), {})
        # The pattern in the file (fixed value).
        return kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def simple(self, text: str) -> bool:
        """Whether ``text`` is split here. Special tokens begin with ``<|``."""
        if not self.plain or "<|" in text:
            return False
        try:
            return not text.encode("latin-1").translate(None, self.LATIN1)
        except UnicodeEncodeError:
            return self.other(text) is None

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, piece: str) -> bytes:
        """The ids of a piece, from the file's model alone; it is remembered if it is short."""
        if len(self.known) >= REMEMBER:
            self.known.clear()
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        found = array(self.dtype.char, [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(piece) <= SHORT:
            self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        if not self.simple(text):
            return self.whole(text)
        pieces, get = self.find(text.lower()), self.known.get
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            return b"".join([get(p) or self.learn(p) for p in pieces])


def opened(path: str) -> WordTokens:
    known = held("packing")
    if path not in known:
        known[path] = WordTokens(path)
    return known[path]


# ---------------------------------------------------------------- the curve


def hilbert(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position of each row of ``places`` (whole numbers of ``bits`` bits, one column a dimension) on the Hilbert curve.

    Axes are turned into the transposed index from the highest bit down (Skilling, 2004), and its bits interleaved.
    """
    x = places.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = np.int64(1) << b, (np.int64(1) << b) - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1, (np.int64(1) << b) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and sign of each id in a hashed vector, and the matrix from hashed vectors to the curve's dimensions."""
    h = mix(np.arange(1, vocabulary + 1, dtype=np.uint64))
    return (h % np.uint64(HASHED)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), np.random.default_rng(7).normal(size=(HASHED, DIMENSIONS))


def curve_keys(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The key of each hashed vector: damped counts of length 1, projected, each dimension by its rank in the normal distribution."""
    v = np.sign(vectors) * np.sqrt(np.abs(vectors))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    z = v @ matrix
    share = 1 / (1 + np.exp(-1.702 * z))
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


# ---------------------------------------------------------------- packing


def powers(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Pieces of documents that come one after another. The sequence being filled is held until it is full or the range ends."""

    def __init__(self, longest: int, dtype: np.dtype, first: int) -> None:
        self.longest, self.dtype, self.sequence, self.used = longest, dtype, first, 0
        self.held: list[tuple[int | None, int, bytes, int]] = []

    def piece(self, doc: int | None, start: int, ids: bytes, total: int, offset: int) -> tuple:
        wide = np.frombuffer(ids, self.dtype).astype("<u4").tobytes()
        return doc, start, len(wide) // 4, zlib.crc32(wide), total, self.sequence, offset

    def close(self, sizes: list[int]) -> Iterator[tuple]:
        """The held pieces, cut into sequences of ``sizes``."""
        width, at, room, offset = self.dtype.itemsize, 0, sizes[0], 0
        for doc, start, ids, total in self.held:
            taken = 0
            while taken < len(ids):
                some = min(len(ids) - taken, room * width)
                yield self.piece(doc, start + taken // width, ids[taken : taken + some], total, offset)
                taken += some
                room -= some // width
                offset += some // width
                if not room:
                    self.sequence += 1
                    at, offset = at + 1, 0
                    room = sizes[at] if at < len(sizes) else 0
        self.held.clear()
        self.used = 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        width, at = self.dtype.itemsize, 0
        total = len(ids) // width
        while at < total:
            some = min(self.longest - self.used, total - at)
            part = ids[at * width : (at + some) * width]
            if self.used == 0 and some == self.longest:
                yield self.piece(doc, at, part, total, 0)
                self.sequence += 1
            else:
                self.held.append((doc, at, part, total))
                self.used += some
                if self.used == self.longest:
                    yield from self.close([self.longest])
            at += some

    def end(self) -> Iterator[tuple]:
        if self.used:
            yield from self.close(powers(self.used))


PIECES = "__q_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, longest: int = LONGEST, end: int = END) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids are those of the tokenizers library for its whole text, then ``end``; special tokens in a text are recognised,
    none is added; a null text is empty, so every document has at least one id. ``longest`` must be a power of two. Every
    sequence is full, but for at most one of each smaller power of two at the end of a range of the curve: nothing is padded.
    ``sequence_id`` names a sequence, ``offset`` is gapless within it. Repeated rows are packed as often as they occur; null ids are
    kept; an empty table gives an empty one; other columns are ignored. Which documents share a range depends on how Spark
    divides the keys, so sequence ids may differ from run to run; each run's answer is whole.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("__q_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__q_text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = opened(path)
        last = np.array([end], words.dtype).tobytes()
        place, sign, matrix = projection(max(words.library.get_vocab_size(), end + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [words.encode(t) for t in some.column(1).to_pylist()]
                vectors = np.zeros((len(ids), HASHED))
                for i, x in enumerate(ids):
                    have = np.frombuffer(x, words.dtype)
                    vectors[i] = np.bincount(place[have], sign[have], HASHED)
                tie = mix(np.arange(at, at + len(ids), dtype=np.uint64) ^ np.uint64(zlib.crc32(b"".join(ids[:1])))).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(curve_keys(vectors, matrix)), pa.array(tie), pa.array([x + last for x in ids], pa.binary())], names=["__q_id", "key", "tie", "ids"])

    written = materialize(rows.mapInArrow(tokens, "__q_id long, key long, tie long, ids binary"), "tokens")
    # Copies have one key: the id, and a number for rows that are equal in all, divide what a key holds among ranges.
    order = ["key", F.xxhash64("__q_id"), "tie"]
    ranged = written.repartitionByRange(parts_for(written, RANGE_BYTES), *order).sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(longest, opened(path).dtype, TaskContext.get().partitionId() << 40)

        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            found: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found += packer.add(doc, ids.as_py())
            if found:
                yield table(found)
        if found := list(packer.end()):
            yield table(found)

    return ranged.select("__q_id", "ids").mapInArrow(packed, PIECES).withColumnRenamed("__q_id", id_col)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
