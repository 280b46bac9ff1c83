import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(3)
    every = [chr(c) for c in [*range(1, 0xD800, 37), *range(0x1F300, 0x1F900, 13)]]
    mixed = ["".join(rng.choice(every + list(" \n\t'abc019!") * 40) for _ in range(400)) for _ in range(60)]
    controls = ["a\x1c\x1d b\x85c  d\xa0 e  f \n\n g", "<|endoftext|>x<|endoftext|><|endoftext|> y <|end", "I'll we've 'sx  ", "", " ", "é" * 3000, "ab" * 5000, "a" * 9001, "".join(rng.choice("abcdefgh") for _ in range(20000)), "!?" * 4000]
    return mixed + controls


def test_equals_library(library):
    tree = bpe.TreeBPE(bpe.default_path(), leaf=64)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert tree.encode(t) == want, t[:80]
        assert tree.csv(t)[1].decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_join_of_any_halves(library):
    tree = bpe.opened(bpe.default_path())
    rng = random.Random(9)
    for _ in range(40):
        word = "".join(rng.choice(["the", "ing", "a", "tion", "x", "é"]) for _ in range(200)).encode()
        at = rng.randrange(len(word))
        both = tree.join(tree.core._encode_single_piece(word[:at]), tree.core._encode_single_piece(word[at:]), tree.core._encode_single_piece)
        assert both == tree.core._encode_single_piece(word)


def test_documents(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "null id", 1), (1000, None, 1), (7, "one two three " * 50, 2), (7, "one two three " * 50, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.encode_documents(df, bpe.digests, bpe.DIGESTS, part=100).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(df.limit(0), bpe.digests, bpe.DIGESTS).count() == 0


def test_long_text_without_white_space(spark, library):
    rng = random.Random(2)
    long = ["".join(rng.choice("abcdefgh") for _ in range(1_000_000)), "é" * 150_001, "x y " * 30_000 + "z" * 90_000 + " <|endoftext|>" + "!?" * 50_000]
    tree = bpe.opened(bpe.default_path())
    parts = [bpe.cuts(tree, t) for t in long]
    assert len(parts[0]) >= 16 and len({r for r, _ in parts[0]}) == 1 and max(len(p) for x in parts for _, p in x) <= bpe.PART
    assert [b"".join(p for _, p in x) for x in parts] == [t.encode() for t in long]
    df = spark.createDataFrame(list(enumerate(long)) + [(0, long[0])], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in bpe.encode_documents(df, bpe.digests, bpe.DIGESTS).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(long)}


def test_kept_columns(spark):
    """Columns that are kept stay with their rows, in texts of one part and of several, and where rows are equal but for them."""
    rows = [(i % 9, f"word{i % 9} " * (3 if i % 2 else 300), "k" + str(i % 5) if i % 5 else None, (i, i % 3)) for i in range(60)] + [(1, None, "k", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, name string, place struct<a:int,b:int>")
    out = bpe.encode_documents(df, lambda ids, decoded: (decoded.decode(),), "again string", part=100, keep=("name", "place"))
    assert out.columns == ["doc_id", "again", "name", "place"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, t or "", n, p) for i, t, n, p in rows), key=str)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op8_bpe(spark, sf).collect())) == sorted(want)
