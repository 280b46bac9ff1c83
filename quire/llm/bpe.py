"""BPE encoding and decoding by tree concatenation, equal to the tokenizers library's result.

A long text is cut into parts that are encoded in parallel as rows of their own. Where the vocabulary's split pattern cuts
it, parts are simply put side by side. A piece that the pattern does not cut (a very long run of letters, say) is halved,
again and again, at any byte, and neighbours are joined pairwise: a window of tokens around each join is encoded again
and grows until its first and last tokens are those of both sides. Two sides that agree with the window on a whole token
each are exact: neighbours in a BPE sequence that are right pairwise are right as a whole.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of an uncut piece that one leaf encodes, and bytes of a text that one row encodes.
LEAF, PART = 2048, 1 << 16
#: Pieces whose tokens a worker remembers; when full it forgets them all.
REMEMBER = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes as themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """Results by piece, kept for short pieces; a full memory is emptied."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        got = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBER:
                self.clear()
            self[piece] = got
        return got


class TreeBPE:
    """A byte-level BPE vocabulary file (tokenizers' JSON) with tree concatenation for what is long."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        # The byte-level pre-tokenizer's pattern (fixed value).
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        self.find = regex.compile(pattern).findall
        # The same pattern for texts of ASCII and Latin letters and common punctuation only, where the faster engine agrees.
        letters_ = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        self.other = re.compile(f"[^\t\n\r {letters_}!-@\\[-`{{-~\u00d7\u00f7\u2010-\u2027]").search
        self.find_latin = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters_}]+| ?[0-9]+| ?[^\s0-9{letters_}]+|\s+(?!\S)|\s+").findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.core = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.added.items()}
        self.leaf = leaf
        self.csv_of, self.text_of = _Known(self.piece_csv), _Known(self.piece_bytes)

    # -- one uncut piece

    def piece(self, data: bytes) -> list[int]:
        """Tokens of bytes that the pattern does not cut."""
        if len(data) <= self.leaf:
            return self.core._encode_single_piece(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]), self.core._encode_single_piece)

    def join(self, left: list[int], right: list[int], encode: Callable[[bytes], list[int]]) -> list[int]:
        """``left`` and ``right`` as the tokens of the whole: windows around the join grow until both sides agree."""
        if not left or not right:
            return left + right
        m = 4
        while True:
            a, b = left[-m:], right[:m]
            again = encode(b"".join(self.bytes_of[i] for i in a + b))
            if (m >= len(left) or again[0] == a[0]) and (m >= len(right) or again[-1] == b[-1]):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            m *= 2

    # -- texts

    def piece_csv(self, piece: str) -> str:
        return ",".join(map(str, self.piece(piece.encode())))

    def piece_bytes(self, piece: str) -> bytes:
        return self.decode(list(map(int, self.csv_of[piece].split(","))))

    def csv(self, text: str) -> tuple[str, bytes]:
        """All ids of ``text``, decimal and joined by commas, and the bytes that they decode to."""
        if self.specials is not None and "<" in text:
            sections = self.specials.split(text)
            if len(sections) > 1:
                found = [(str(self.added[t]), t.encode()) if k % 2 else self.csv(t) for k, t in enumerate(sections)]
                return ",".join([x[0] for x in found if x[0]]), b"".join([x[1] for x in found])
        pieces = (self.find if self.other(text) else self.find_latin)(text)
        return ",".join(map(self.csv_of.__getitem__, pieces)), b"".join(map(self.text_of.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        ids = self.csv(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def opened(path: str) -> TreeBPE:
    known = held("bpe")
    if path not in known:
        known[path] = TreeBPE(path)
    return known[path]


def halves(data: bytes, most: int = PART) -> list[bytes]:
    """``data`` cut in halves until no part is over ``most`` bytes."""
    if len(data) <= most:
        return [data]
    mid = len(data) // 2
    return halves(data[:mid], most) + halves(data[mid:], most)


def cuts(bpe: TreeBPE, text: str, most: int = PART) -> list[tuple[int, bytes]]:
    """``text`` in parts of about ``most`` bytes or less, with the number of the run to which a part belongs.

    A run is a stretch between two places where the pattern cuts; only a piece that it does not cut has several parts.
    """
    out: list[tuple[int, bytes]] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            out.append((len(out), "".join(held).encode()))
            held.clear()
            size = 0

    sections = bpe.specials.split(text) if bpe.specials is not None else [text]
    for k, section in enumerate(sections):
        for piece in [section] if k % 2 else (bpe.find if bpe.other(section) else bpe.find_latin)(section):
            if len(piece) > most // 4:
                data = piece.encode()
                if len(data) > most:
                    close()
                    run = len(out)
                    out += [(run, part) for part in halves(data, most)]
                    continue
            held.append(piece)
            size += len(piece)
            if size >= most // 2:
                close()
    close()
    return out


def encode_documents(docs: DataFrame, columns: Callable[[str, bytes], tuple], schema: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, part: int = PART, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and what ``columns(ids joined by commas, decoded bytes)`` makes of its text.

    ``schema`` lists the columns that ``columns`` returns. Null and empty texts have no ids. Repeated rows give repeated
    results; null ids are kept; of the other columns those of ``keep`` follow, which must be of types that can be grouped by.
    Special tokens in a text are recognised, none is added.
    """
    path = path or default_path()
    kept = [f"__q_keep{k}" for k in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long").alias("__q_id"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("__q_text"))
    head = ["__q_id", *kept]
    kinds = dict(rows.dtypes)
    key = ", ".join(f"{c} {kinds[c]}" for c in head)
    full = f"{key}, {schema}"
    names = [*head, *[c.split()[0] for c in schema.split(",")]]

    def again(of: pa.RecordBatch, times: int, columns: list[str]) -> list[pa.Array]:
        """``columns`` of the first row of ``of``, ``times`` over."""
        return of.select(columns).take(pa.array([0] * times, pa.int64())).columns

    def table(heads: list[pa.Array], found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([*heads, *[pa.array(c) for c in cols]], names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                yield table(some.columns[:-1], [columns(*bpe.csv(t)) for t in some.column("__q_text").to_pylist()])

    leaf_names = [*head, "__q_key", "__q_no", "__q_run"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path)
        for batch in batches:
            for at, t in enumerate(batch.column("__q_text").to_pylist()):
                digest = hashlib.sha256(t.encode()).digest()
                found = cuts(bpe, t, part)
                many = Counter(r for r, _ in found)
                yield pa.RecordBatch.from_arrays([*again(batch.slice(at, 1), len(found), head), pa.array([digest] * len(found), pa.binary()), pa.array(range(len(found)), pa.int64()), pa.array([r for r, _ in found], pa.int64()), pa.array([many[r] == 1 for r, _ in found]), pa.array([p for _, p in found], pa.binary())], names=[*leaf_names, "__q_alone", "__q_part"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a part that is a run by itself its text is encoded, of a part of a longer piece its bytes."""
        bpe = opened(path)
        for batch in batches:
            for at, row in enumerate(batch.select(["__q_alone", "__q_part"]).to_pylist()):
                ids = bpe.encode(row["__q_part"].decode()) if row["__q_alone"] else bpe.piece(row["__q_part"])
                yield pa.RecordBatch.from_arrays([*again(batch.slice(at, 1), 1, leaf_names), pa.array([ids], pa.list_(pa.int32()))], names=[*leaf_names, "__q_ids"])

    def joined(t: pa.Table) -> pa.Table:
        bpe = opened(path)
        t = t.sort_by("__q_no")
        number, run, ids = (t.column(c).to_pylist() for c in ("__q_no", "__q_run", "__q_ids"))
        copies = number.count(0)
        run, ids = run[::copies], ids[::copies]  # repeated rows have equal parts
        whole: list[int] = []
        for _, group in itertools.groupby(zip(run, ids, strict=True), key=lambda x: x[0]):
            sides = [x for _, x in group]
            while len(sides) > 1:
                sides = [bpe.join(sides[k], sides[k + 1], bpe.core._encode_single_piece) if k + 1 < len(sides) else sides[k] for k in range(0, len(sides), 2)]
            whole += sides[0]
        got = columns(",".join(map(str, whole)), bpe.decode(whole))
        return pa.Table.from_batches([table(again(t.slice(0, 1).combine_chunks().to_batches()[0], copies, head), [got] * copies)])

    long = F.length("__q_text") > part
    parts = rows.where(long).mapInArrow(cut, f"{key}, __q_key binary, __q_no long, __q_run long, __q_alone boolean, __q_part binary")
    dealt = parts.repartition("__q_id", "__q_key", "__q_no")
    encoded = dealt.mapInArrow(leaves, f"{key}, __q_key binary, __q_no long, __q_run long, __q_ids array<int>")
    whole = encoded.groupBy(*head, "__q_key").applyInArrow(joined, full)
    out = rows.where(~long).mapInArrow(short, full).unionByName(whole)
    made = [c for c in names if c not in head]
    return out.select(F.col("__q_id").alias(id_col), *made, *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])


def digests(ids: str, decoded: bytes) -> tuple[int, str, str]:
    """n_tokens, ids_sha256, decoded_sha256; bytes that are not UTF-8 decode with the replacement character."""
    text = decoded.decode("utf-8", "replace").encode()
    return (ids.count(",") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests, DIGESTS)
