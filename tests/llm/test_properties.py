"""Round trips and equalities over generated inputs."""

import numpy as np
import public_tokenizers as public
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import byte_bpe, matroska, ngram_join, suffix_dedup
from quire.llm.token_counts import Lengths

RANKS = byte_bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
BPE = byte_bpe.Bpe(RANKS, public.PATTERN)
DIRECT = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LENGTHS = Lengths(public.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
TEXT = st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_ids(t):
    assert BPE.encode(t) == DIRECT.encode_ordinary(t) and BPE.decode(BPE.encode(t)) == t.encode()


@given(st.lists(TEXT | st.lists(st.sampled_from(["a", " ", "b.", "\n", "<|endoftext|>", "'s", "  ", "é", " ", "1"]), max_size=20).map("".join), max_size=5))
@settings(max_examples=200, deadline=None)
def test_counts(texts):
    assert LENGTHS.count(texts) == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@given(st.binary(max_size=5000))
@settings(max_examples=100, deadline=None)
def test_media(data):
    samples = matroska.padded(data)
    file = matroska.write_pcm(samples)
    media = matroska.parse(file)
    assert media.complete and matroska.payload(file, media, 1) == samples


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=30).map("".join), min_size=1, max_size=6), st.integers(2, 6))
@settings(max_examples=200, deadline=None)
def test_classes_of_windows(texts, length):
    texts = [t for t in texts if len(t) >= length] or ["a" * length]
    data = "".join(texts).encode()
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([np.arange(e - len(t), e - length + 1) for t, e in zip(texts, ends, strict=True)])
    order, cls = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), starts, length)
    windows = [(data[i : i + length], i) for i in starts[order].tolist()]
    assert windows == sorted(windows)
    assert all((x[0] == y[0]) == (i == j) for (x, i), (y, j) in zip(zip(windows, cls, strict=True), zip(windows[1:], cls[1:], strict=True), strict=False))


@given(st.lists(st.sets(st.integers(0, 30), max_size=20), max_size=12), st.integers(50, 100))
@settings(max_examples=200, deadline=None)
def test_tree_groups(sets, percent):
    label = ngram_join.groups_of([np.array(sorted(s), np.uint64) for s in sets], percent)
    up = list(range(len(sets)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x & y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert label == [find(i) for i in range(len(sets))]
