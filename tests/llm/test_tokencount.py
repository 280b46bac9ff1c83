import random

from tokenizers import Tokenizer, models, pre_tokenizers

from quire.llm import tokencount


def library(pieces):
    t = Tokenizer(models.Unigram([("<unk>", 0.0 if not pieces else min(s for _, s in pieces)), *pieces], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.SPACE, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_equals_library():
    pieces = tokencount.vocabulary(tokencount.default_path())
    count, want = tokencount.Counter(pieces), library(pieces)
    rng = random.Random(4)
    letters = list("abcdefghijklmnop  \né中\U0001f600#▁") + ["the", "tion", " of", "க"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in [*texts, "", " ", "  ", "a" * 5000, "கக க"]:
        assert count.tokens(t)[1] == want(t), repr(t)


def test_ties():
    pieces = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aba", -3.0), ("bab", -3.0)]
    count, want = tokencount.Counter(pieces), library(pieces)
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice("ab  z") for _ in range(rng.randint(0, 20)))
        assert count.tokens(t)[1] == want(t), repr(t)


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 1), (2, "", 0)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, tokencount.count_tokens(df).collect()), key=str) == sorted([(1, 2, 2), (1, 2, 2), (None, 0, 0), (2, 0, 0)], key=str)
    assert tokencount.count_tokens(df.limit(0)).count() == 0


def test_query_and_other_pieces(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(8)
    text = " ".join(r.text for r in docs.limit(40).collect())
    own = {text[i : i + rng.randint(1, 6)].replace(" ", tokencount.SPACE) for i in (rng.randrange(len(text)) for _ in range(3000))}
    other = [(p, -rng.random() * 12) for p in sorted(own) if p]
    for pieces, got in ((tokencount.vocabulary(tokencount.default_path()), tokencount.op4_token_counts(spark, sf)), (other, tokencount.count_tokens(docs, pieces=other))):
        want = library(pieces)
        assert {r.doc_id: r.n_tokens for r in got.collect()} == {r.doc_id: want(r.text or "") for r in docs.collect()}
