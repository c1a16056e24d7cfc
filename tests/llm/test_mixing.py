import math
from collections import Counter, defaultdict

import pytest

from quire.llm.mixing import mix, mixed_documents


def filled(sizes, weights=(1, 2, 3), cap=3):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        out = {s: cap * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if s not in capped and out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("scale", [(1, 1, 1), (50, 1, 1), (1, 30, 2), (3, 200, 900)])
def test_targets_and_cut(spark, scale):
    rows = [(i, "w " * (i % 7 + 1) if i % 11 else None, s, 1) for s, n in zip(("a", "b", None), scale, strict=True) for i in range(sum(scale[: ("a", "b", None).index(s)]), sum(scale[: ("a", "b", None).index(s)]) + 5 * n)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size long")).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = Counter(), Counter(), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r["size"] * r.copies and r.copies <= 3
    want = filled(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_edges(spark):
    schema = "doc_id long, text string, source string, of string, range string, copies long, n_chars long"
    empty = spark.createDataFrame([], schema)
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0
    df = spark.createDataFrame([(None, None, None, "x", "y", 1, 2), (1, "", "a", "x", "y", 1, 2), (1, "", "a", "x", "y", 1, 2)], schema)
    assert [tuple(r)[2:] for r in mix(df).collect()] == [(0, 0, 0.0, 0, 0)] * 3
    assert mixed_documents(df).count() == 0


def test_reruns_and_documents_agree(spark):
    rows = [(i, "a b c " * (i % 5 + 1), f"s{i % 3}" if i % 4 else "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(tuple, mix(df).collect()))
    assert first == sorted(map(tuple, mix(df.repartition(7)).collect()))
    times = Counter(r.doc_id for r in mixed_documents(df).collect())
    assert times == Counter({r[0]: r[5] for r in first if r[5]})
    assert mixed_documents(df).columns == df.columns


def test_no_row_is_taken_more_than_cap_times(spark):
    """Empty texts too, in a source that is at its cap."""
    rows = [(i, "", "a") for i in range(30)] + [(30, "one two three", "a")] + [(31 + i, "w " * 50, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    assert max(r.copies for r in got) <= 3 and {r.taken for r in got if r.doc_id == 30} == {9}
    assert max(Counter(r.doc_id for r in mixed_documents(df).collect()).values()) <= 3


@pytest.mark.parametrize("same_text", [True, False])
@pytest.mark.parametrize("ident", [7, None])
def test_rows_of_one_id_keep_the_budget(spark, same_text, ident):
    rows = [(ident, "w " * 10 if same_text else "w " * 9 + f"w{i}", "a", i) for i in range(40)] + [(100 + i, "w " * 10, "b", i) for i in range(20)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    got = mix(df).collect()
    target = {r.source: r.target for r in got}
    assert target == {"a": 200.0, "b": 400.0, None: 0.0} and len(got) == len(rows)
    taken, written = Counter(), Counter()
    for r in got:
        taken[r.source] += r.taken
    out = mixed_documents(df).collect()
    for r in out:
        written[r.source] += len(r.text.split())
    assert abs(taken["a"] - 200) <= 10 and abs(taken["b"] - 400) <= 10 and written == Counter({k: v for k, v in taken.items() if v})
    assert sorted(out, key=str) == sorted(mixed_documents(df.repartition(5)).collect(), key=str)


def test_very_long_texts_and_hot_rows(spark):
    rows = [(1, "word " * 400_000, "a"), *[(None, "x y", "a")] * 3000, *((i, "p q r", "b") for i in range(500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mix(df).collect()
    assert len(got) == len(rows) and all(r.copies <= 3 for r in got)
    taken = sum(r.taken for r in got if r.source == "b")
    assert taken == 4500 and {r["size"] for r in got} == {400_000, 2, 3}
