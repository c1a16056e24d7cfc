import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import ngram_join as nj
from quire.llm.components import connected


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return Counter(out)


def corpus(seed, n=120, group=30):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(2, 7)))
    common = [word() for _ in range(25)]
    base = [[word() for _ in range(rnd.randint(8, 70))] for _ in range(8)]
    rows = []
    for i in range(n):
        if i < group:
            w = list(base[0])
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = word()
        elif rnd.random() < 0.5:
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                w += [word() for _ in range(rnd.randint(1, 10))]
        else:
            w = [word() for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.3:
            w += common
        rows.append((i, rnd.choice(["\n", " ", "\t\x0b "]).join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[0][1]), (None, "all alone here"), (5, rows[5][1]), (7, "another text for this id"), (n + 3, "a b"), (n + 4, "A  B"), (n + 5, "x " * 3000)]
    return rows


@pytest.mark.parametrize(("seed", "size", "bytes_"), [(1, 2000, 16 << 20), (2, 4, 16 << 20), (3, 2000, 1500)])
def test_equals_comparing_all_pairs(spark, seed, size, bytes_, monkeypatch):
    monkeypatch.setattr(nj, "BATCH_DOCS", 10)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], "doc_id long, text string, class string, n int, id int").repartition(3)
    got = nj.ngram_components(df, group_size=size, group_bytes=bytes_)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.ngram_components(df).count() == 0
    alone = spark.createDataFrame([(3, "one text only"), (4, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in nj.ngram_components(alone).collect()) == [(3, 1, 3), (4, 0, 4)]
    with pytest.raises(ValueError):
        nj.ngram_components(df, percent=10)


@pytest.mark.parametrize("percent", [60, 75, 90, 100])
def test_trees_equal_pairs(percent):
    rnd = random.Random(percent)
    for _ in range(30):
        base = [rnd.sample(range(200), rnd.randint(1, 40)) for _ in range(4)]
        sets = [np.unique(np.array([x if rnd.random() > 0.08 else rnd.randrange(200) for x in rnd.choice(base)], np.uint64)) for _ in range(40)]
        label = nj.groups_of(sets, percent)
        up = list(range(len(sets)))
        find = lambda i: i if up[i] == i else find(up[i])  # noqa: E731, B023
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        assert label == [find(i) for i in range(len(sets))]


def test_prefixes_of_linking_sets_share_enough():
    rnd = np.random.default_rng(1)
    seen = 0
    for _ in range(3000):
        a = rnd.choice(400, rnd.integers(1, 120), replace=False)
        b = np.unique(np.concatenate([a[rnd.random(len(a)) > 0.1], rnd.choice(400, rnd.integers(0, 12))]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            seen += 1
            p, q = (np.sort(x)[: nj.announced(len(x), 75)] for x in (a, b))
            assert len(np.intersect1d(p, q)) >= max(nj.needed(len(a), 75), nj.needed(len(b), 75))
    assert seen > 500


def test_many_buckets_and_a_long_text(spark):
    """With few buckets a long text has more hashes in one than 16 bits count; with many, rows tell owners one by one."""
    rnd = random.Random(5)
    long = " ".join(str(rnd.randrange(10**9)) for _ in range(220_000))
    rows = [(1, long), (2, long + " x"), (3, "a b c d e f g"), (4, "A b c d e f g h"), (5, "other words are here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for buckets in (1, 700):
        got = sorted(tuple(r)[:3] for r in nj.ngram_components(df.repartition(2, "doc_id"), buckets=buckets).collect())
        assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)] and got[0][1] == 219_996


def test_chained_groups_that_fall_apart(spark):
    """A long chain of candidates without a link between its pieces, in blocks of two: only shared n-grams' lists meet."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    shared = [[word() for _ in range(9)] for _ in range(60)]
    rows = []
    for i in range(59):
        w = shared[i] + [word() for _ in range(4)] + shared[i + 1]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, word()]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nj.ngram_components(df, group_size=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_rows_alike_beyond_number(spark):
    rows = [(None, "one two three four five six seven")] * 100_000 + [(i, "one two three four five six seven") for i in range(20_000, 30_000)] + [(7, "one two three four five six seven eight")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = Counter((r.doc_id is None, r.n_shingles, r.component_id) for r in nj.ngram_components(df).collect())
    assert got == {(True, 3, 7): 100_000, (False, 3, 7): 10_000, (False, 4, 7): 1}
    assert [r.doc_id for r in nj.one_of_each(df).collect()] == [7]


@pytest.mark.parametrize("kind", ["shuffled path", "high star", "random"])
def test_components(spark, kind):
    rnd = random.Random(3)
    n = 120
    ids = list(range(n)) if kind != "shuffled path" else rnd.sample(range(n), n)
    edges = {"star": [(0, i) for i in range(1, n)], "high star": [(n, i) for i in range(n)], "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 2)]}.get(kind, list(zip(ids, ids[1:], strict=False)))
    edges += edges[:5] + [(1000, 1000)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = connected(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.label for r in got.collect()} == {x: find(x) for x in up}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
