"""Packing against the tokenizers library, piece by piece."""

import random
import zlib

import numpy as np
import pytest

from quire.llm.packing import BITS, DIMENSIONS, LONGEST, Packer, WordTokens, default_path, hilbert, opened, pack, powers
from quire.llm.registry import queries


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.no_padding()
    t.no_truncation()
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def judge(pieces, docs, longest=LONGEST):
    """``pieces`` hold each id of ``docs`` (pairs of id and text) once; sequences are gapless; how many tokens are padded."""
    want = {}
    for (i, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        want.setdefault(i, []).append(ids)
    have, sequences = {}, {}
    for p in pieces:
        have.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert sum(p["length"] for p in pieces) == sum(len(x) for xs in want.values() for x in xs)
    assert {i for i, _ in have} == set(want)
    for i, lists in want.items():
        for n in {len(x) for x in lists}:
            same = [x for x in lists if len(x) == n]
            got = sorted((p["start"], p["length"], p["ids_crc32"]) for p in have[i, n])
            assert sum(x[1] for x in got) == n * len(same)
            for start, length, crc in got:
                assert crc in {zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) for x in same}
            if len(same) == 1:
                assert [x[0] for x in got] == [0, *np.cumsum([x[1] for x in got])[:-1].tolist()]
    padded = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in parts]).tolist()
        assert [p["offset"] for p in parts] == [0, *ends[:-1]] and ends[-1] <= longest
        padded += 0 if ends[-1] & (ends[-1] - 1) == 0 else longest - ends[-1]
    return padded, len(sequences)


def test_query_against_the_library(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    pieces = [r.asDict() for r in queries()["op11_packing"](spark, "/root/testdata/sf0.001").collect()]
    padded, sequences = judge(pieces, docs)
    tokens = sum(p["length"] for p in pieces)
    assert padded == 0 and sequences <= tokens / LONGEST + 12 * 8


ODD = [
    "", " \n\t ", "It's WE'LL 'tis 'theta o'clock!!'s", "naïve Ÿ Œuvre ŉ İstanbul ΑΣ Σ ſ ȺB Ⱦ", "é café  x y", "<|endoftext|> a <| b |> <|startoftext|>x", "1234 12½ ² 三つ 😀😀 a‍b",
    "a\x00b\x1cc\x85d\x7f", "a\x0bb\x0cc\xa0d\xad\xb5\xaa\xdf", "ÀÖØÞßöøÿ ×÷", "Ā\u0149 ĲĳſŠ", "…—–‘’“”•", "x" * 5000, "ab " * 4000, "!?" * 3000, "A\rB\r\nC", "ﬁ ﬂ K Å", "×÷ a×b 5÷2",
]


def test_tokens_of_odd_texts_are_the_librarys():
    words = WordTokens(default_path())
    assert words.plain
    rng = random.Random(3)
    letters = "abcXYZ 's'll'd\n\t.,-_09éÉßœŒſ×“”’—<|>İΣ́日"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    for _ in range(2):  # unknown pieces, then known ones
        assert [[*np.frombuffer(x, words.dtype).tolist(), 1] for x in map(words.encode, texts)] == library_ids(texts)


def test_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (3, ODD[3]), (3, ODD[3]), (3, "another text of the same id"), (99, None)] + [(1000 + i, "one passage that very many documents share") for i in range(700)]
    docs = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], "doc_id long, text string, length int, sequence_id int, __q_key string")
    got = pack(docs)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert judge([r.asDict() for r in got.collect()], rows)[0] == 0
    assert judge([r.asDict() for r in pack(docs.repartition(7), longest=16).collect()], rows, 16)[0] == 0
    assert pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(docs, longest=1000)


def test_the_curve_visits_every_place_and_steps_by_one():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
    assert hilbert(np.zeros((1, DIMENSIONS), int), BITS).tolist() == [0]


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of two vocabularies: almost all sequences hold one of them."""
    rng = random.Random(5)
    vocab = [[f"{a}{b}" for a in "bcdfg" for b in range(40)], [f"{a}{b}{a}" for a in "vwxyz" for b in range(40)]]
    rows = [(i, " ".join(rng.choice(vocab[i % 2]) for _ in range(60))) for i in range(400)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string"), longest=512).collect()
    kinds = {}
    for p in pieces:
        kinds.setdefault(p["sequence_id"], set()).add(p["doc_id"] % 2)
    assert sum(len(k) == 1 for k in kinds.values()) > 0.7 * len(kinds)


def test_powers_and_ends():
    assert powers(1500) == [1024, 256, 128, 64, 16, 8, 4] and powers(0) == []
    p = Packer(8, np.dtype("<u2"), 5)
    rows = [*p.add(1, b"\1\0" * 3), *p.add(2, b"\2\0" * 20), *p.end()]
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in rows] == [(1, 0, 3, 5, 0), (2, 0, 5, 5, 3), (2, 5, 8, 6, 0), (2, 13, 4, 7, 0), (2, 17, 2, 8, 0), (2, 19, 1, 9, 0)]
    assert opened(default_path()) is opened(default_path())
