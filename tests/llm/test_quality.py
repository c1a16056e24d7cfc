import random
import zlib
from itertools import combinations

import numpy as np

from quire.llm.quality import Features, Machine, fit, score, train


def test_linear_time_sum_equals_the_pairs():
    rnd = np.random.default_rng(1)
    m = Machine(0.3, rnd.normal(size=50), rnd.normal(size=(50, 4)))
    rows = [(np.sort(rnd.choice(50, n, replace=False)), rnd.normal(size=n) / 3) for n in (1, 2, 7, 30)]
    for (i, x), got in zip(rows, m.score(rows), strict=True):
        z = 0.3 + m.linear[i] @ x + sum(m.factors[a] @ m.factors[b] * xa * xb for (a, xa), (b, xb) in combinations(zip(i, x, strict=True), 2))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_pairs_are_learnt():
    """Neither feature tells alone; a linear model can't fit it."""
    rnd = random.Random(1)
    rows, y = [], []
    for _ in range(600):
        a, b = rnd.randint(0, 1), rnd.randint(0, 1)
        rows.append((np.array([a, 2 + b]), np.ones(2)))
        y.append(int(a != b))
    m = fit(rows[:400], y[:400], 4, epochs=60)
    assert np.mean((m.score(rows[400:]) >= 0.5) == np.array(y[400:])) > 0.97


def test_features_have_no_doubles():
    f = Features()
    for t in ("", " ", "a", "A! B! " * 99, "x" * 100_000, "é\n" * 50):
        i, v = f.of(t)
        assert len(set(i.tolist())) == len(i) and np.isfinite(v).all() and i.max() < f.dims


def corpus(n=300):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 90))]
        docs.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w), 5, i % 2, "x"))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus()
    schema = "doc_id long, text string, n_chars long, quality int, score string"
    extra = [(None, None, None, None, None), (1000, "", None, 1, "y"), (1000, "", None, 1, "y")]
    df = spark.createDataFrame(docs + extra, schema)
    lab = spark.createDataFrame([*labels, labels[0], (None, 1), (7777, None)], "doc_id long, quality int")
    m = train(df, lab, meta=("n_chars",))
    got = score(df, m, ("n_chars",)).collect()
    assert len(got) == len(docs) + 3
    truth = dict(labels)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    again = train(df.repartition(5), lab.repartition(3), meta=("n_chars",))
    assert np.array_equal(again.linear, m.linear) and score(df.limit(0), m, ("n_chars",)).count() == 0


def test_labels_that_tell_nothing(spark):
    df = spark.createDataFrame(corpus(20)[0], "doc_id long, text string, n_chars long, quality int, score string")
    for rows in ([], [(i, 1) for i in range(20)]):
        m = train(df, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert len({r.score for r in score(df, m).collect()}) == 1
