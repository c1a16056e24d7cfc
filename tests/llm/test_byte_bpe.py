import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken

from quire.llm.byte_bpe import Bpe, Editable, Remembered, bpe_decode, bpe_encode, bpe_round_trip, read_ranks

PATH = public.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "don't  we're\n\n 'S", "x" * 3000, "ab" * 500 + "\t", "हिन्दी \U0001f600\U0001f600", "<|endoftext|> a", "\u0085  é", "Aa1 " * 4000]


@pytest.fixture(scope="module")
def bpe():
    return Bpe(read_ranks(PATH), public.PATTERN)


@pytest.fixture(scope="module")
def direct():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={}).encode_ordinary


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("aaeeiinrst lodA1 9.,\n\tüñéह\U0001f600'") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_equals_merging(bpe, direct):
    for t in ODD + random_texts(500, 1):
        assert bpe.encode(t) == direct(t)
        assert bpe.decode(bpe.encode(t)) == t.encode()


def test_remembered_words(bpe, direct):
    for kept in (5, 10_000):
        enc = Remembered(bpe, kept)
        texts = ODD + random_texts(200, 2)
        assert list(enc.encode(texts)) == [direct(t) for t in texts]
        assert len(enc.ids) <= kept


def test_pairs_are_those_that_merging_keeps(bpe):
    rnd, whole = random.Random(3), list(bpe.whole)
    for _ in range(3000):
        t = rnd.choice(whole)
        c = rnd.randint(1, len(t))
        a, b = t[:c], t[c:] + rnd.choice(whole)[:3]
        if a in bpe.whole and b in bpe.whole:
            assert bpe.valid(bpe.ranks[a], bpe.ranks[b]) == (bpe.merged(a + b) == [a, b])


def test_appends_and_edits(bpe):
    rnd = random.Random(4)
    word = Editable(bpe)
    for _ in range(300):
        more = bytes(rnd.choice(b"abcdefghinorst") for _ in range(rnd.randint(0, 4)))
        if rnd.random() < 0.5:
            word.append(more)
        else:
            a, b = sorted(rnd.randint(0, len(word.data)) for _ in "ab")
            word.edit(a, b, more)
        assert word.ids() == bpe.word(word.data) if word.data else word.ids() == []


def test_on_spark(spark, direct):
    rows = [(i, t, "ids", i) for i, t in enumerate(ODD)] + [(None, None, None, None), (2, "same", "", 0), (2, "same", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, id long")
    encoded = bpe_encode(df, PATH, public.PATTERN)
    want = [(r[0], direct(r[1] or "")) for r in rows]
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == sorted(want, key=str)
    assert {bytes(r.bytes) for r in bpe_decode(encoded, PATH).collect()} == {(r[1] or "").encode() for r in rows}
    got = bpe_round_trip(df, PATH, public.PATTERN).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(map(tuple, got), key=str) == sorted(
        ((r[0], len(i), digest(",".join(map(str, i)).encode()), digest((r[1] or "").encode())) for r, (_, i) in zip(rows, want, strict=True)), key=str
    )
    assert bpe_round_trip(df.limit(0), PATH, public.PATTERN).count() == 0
