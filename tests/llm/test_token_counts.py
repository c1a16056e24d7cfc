import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.token_counts import Lengths, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "  a  b\n\n c", "x <|endoftext|> y <|endoftext|>z", "\t a b", "don't  we're 'S", "  a　 b c", "a​ b \u0085 c", "1 a2 b  ", " a", "a ",
    "word " * 5000, "x" * 30000, "हिन्दी text \U0001f600 b",
]


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_whole_texts(direct):
    assert Lengths(PATH).count(ODD) == direct(ODD)


def test_small_calls_and_full_table(direct):
    lengths = Lengths(PATH, call_bytes=7, kept=3)
    assert [lengths.count([t])[0] for t in ODD] == direct(ODD) and len(lengths.seen) <= 3


def test_counts_on_spark(spark, direct):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(None, "a b", None, 1), (3, None, "y", 2), (3, None, "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id long")
    got = sorted(map(tuple, token_counts(df, PATH).collect()), key=str)
    texts = [r[1] or "" for r in rows]
    want = sorted([(r[0], len(t.encode()), n, n > 1024) for r, t, n in zip(rows, texts, direct(texts), strict=True)], key=str)
    assert got == want
    assert token_counts(df.limit(0), PATH).count() == 0
