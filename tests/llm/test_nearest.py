import math
from collections import Counter

import numpy as np
import pytest

from quire.llm import nearest as ann

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, v int"


def exact(vecs, ids, queries, k):
    x = np.array(vecs, np.float32).astype(np.float64)
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        found = [(-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q]
        out[q] = sorted(found)[:k]
    return out


def run(spark, rows, k=20, **options):
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k, **options).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "lengths"])
def test_recall_against_all_pairs(spark, kind):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 24))
    if kind == "clusters":
        x = x[:30].repeat(30, 0) + 0.2 * x
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(900))
    got = run(spark, list(zip(ids, x.tolist(), strict=True)), index_bytes=250 * 24 * 8, query_bytes=20 * 24 * 8, fitted=300)
    want = exact(x.tolist(), ids, ids[::20], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q in want:
        scores = dict((i, s) for s, i in exact(x.tolist(), ids, [q], 900)[q])
        assert all(math.isclose(s, scores[i], abs_tol=1e-12) for s, i in got[q]) and got[q] == sorted(got[q])


def test_many_copies_and_ties(spark):
    x = [[1.0, 0.0]] * 120 + [[0.0, 1.0]] * 5 + [[1.0, 1.0]]
    got = run(spark, list(enumerate(x)))
    for q in (0, 20, 100):
        # The last vector has the same inner product, 1, and the largest id.
        assert [i for _, i in got[q]] == [i for i in range(120) if i != q][:20]
    assert [i for _, i in got[120]] == [121, 122, 123, 124, 125, *range(15)]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [-1.0, 0.0]), (None, [1.0, 0.0]), (1, [0.5, 0.5]), (20, None)]
    assert {q: [i for _, i in v] for q, v in run(spark, rows).items()} == {0: [1, 8]}
    df = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(df, df).count() == 0
    assert run(spark, [(0, [1.0, 2.0])]) == {}


def test_ids_with_several_vectors(spark):
    """Each row is a query of its own; rows of a query's own id are never its neighbours, whatever their number."""
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.2])], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 1, 1.0), (20, 1, 1, 1.0), (20, 2, 2, 0.2), (20, 2, 2, 0.5)]
    rnd = np.random.default_rng(4)
    near = [(40, (np.array([1.0, 0, 0, 0]) + 0.01 * rnd.normal(size=4)).tolist()) for _ in range(60)]
    far = [(i, rnd.normal(size=4).tolist()) for i in range(41, 60)] + [(50, [9.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(near + near[:3] + far, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 40"), 5).collect()
    assert len(got) == 300 and all(r.vec_id != 40 for r in got) and {r.vec_id for r in got if r["rank"] == 1} == {50}
    want = Counter()
    for _, v in near:
        order = sorted(((-float(np.dot(v, w)), i) for i, w in far))
        want.update((n + 1, i) for n, (_, i) in enumerate(order[:5]))
    assert Counter((r["rank"], r.vec_id) for r in got) == want


def test_all_codes_within_the_radius():
    rnd = np.random.default_rng(1)
    bits = rnd.random((3000, 64)) < 0.5
    bits[:500] = bits[0] ^ (rnd.random((500, 64)) < 0.06)
    index = ann.MultiIndex(bits)
    assert index.width == 13 and index.tables == 5
    for q in bits[:5]:
        apart = (bits ^ q).sum(1)
        for r in (0, 3, 4, 8, 15, 20):
            assert np.array_equal(index.within(q, r), np.flatnonzero(apart <= r))


def test_probes_visit_few_rows_of_clusters():
    """Near neighbours cost probes, not a pass over all rows; the share visited falls as the table grows."""
    rnd = np.random.default_rng(2)
    share = []
    for n in (4000, 32_000):
        centres = rnd.normal(size=(n // 40, 64))
        x = centres.repeat(40, 0) + 0.15 * rnd.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = ann.learn(x[rnd.permutation(n)[:2000]], 1.0, False)
        index = ann.MultiIndex(codes.of(x))
        ask = range(0, n, n // 50)
        right = 0
        for q in ask:
            rows, scores = index.best(codes, x, x[q], codes.of(x[q : q + 1])[0], 20, q)
            right += len(set(rows[np.argsort(-scores)[:20]]) & set(np.argsort(-(x @ x[q]))[:20]))
        assert right / (20 * len(ask)) >= 0.95
        share.append(index.visited / (len(ask) * n))
    assert share[1] < share[0] and share[1] < 0.1
