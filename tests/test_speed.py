"""Work that must not be done twice, or grow with the square of a text."""

import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.functions import lang, text
from quire.operators import languages, retrieval


def test_classes_are_those_of_split(spark):
    """the quicker classes and the list of blanks tell white space as before, for all of the first plane."""
    points = [i for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, chr(i)) for i in points], "i int, c string")
    found = rows.select("i", F.col("c").rlike(text.SPACE).alias("s"), F.col("c").rlike(text.NON_SPACE).alias("n"), (text.strip(F.concat("c", F.lit("x"), "c")) == "x").alias("b"))
    told = {r.i: (r.s, r.n, r.b) for r in found.collect()}
    assert all(told[i] == (chr(i).isspace(), not chr(i).isspace(), chr(i).isspace()) for i in points if chr(i) != "x")


def test_strip_is_linear(spark):
    """300,000 blanks inside a text; from each of them the end of the text was looked for."""
    t = " x" + " " * 300_000 + "x "
    began = time.time()
    assert spark.range(1).select(F.length(text.strip(F.concat(F.lit(t), F.col("id").cast("string"), F.lit(" "))))).first()[0] == len(t)
    assert time.time() - began < 20


def test_evidence_reads_pages_once(spark):
    """with the classifier at hand a page's paragraphs are made once, and what is found is the same."""
    p = spark.createDataFrame([("a", 1, "the cat and the dog is of the house with a garden by the river and this was for it\n\n" + "\u0915\u093f\u0924\u093e\u092c " * 8 + "\n\nshort")], "doc string, page_number int, content string")
    once = languages.evidence(p)
    other = languages.evidence(p, classify=lambda c: lang.by_function_words(c))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    assert sorted(once.collect()) == sorted(other.collect()) and once.count() == 2


def test_embedder_hashes_a_word_once(monkeypatch):
    """500 times the same words take as many hashes as once, and give the same sums."""
    calls = []

    class Counted:
        @staticmethod
        def crc32(b):
            calls.append(b)
            return zlib.crc32(b)

    monkeypatch.setattr(retrieval, "zlib", Counted)
    long, dim = "w" * 60, 64
    got = retrieval.HashingEmbedder(dim).embed(["seldomseenword anotherone " * 500, f"{long} seldomseenword", " "])
    assert len(calls) < 400
    want = np.zeros((3, dim), np.float32)
    for i, t in enumerate([["seldomseenword", "anotherone"] * 500, [long, "seldomseenword"], []]):
        for w in t:
            m = f"<{w}>"
            for g in [m, *(m[a : a + n] for n in (3, 4, 5) for a in range(len(m) - n + 1) if len(m) > n)]:
                h = zlib.crc32(g.encode())
                want[i, (h >> 1) % dim] += 1 if h & 1 else -1
    want[2, 0] = 1
    assert np.array_equal(got, want / np.linalg.norm(want, axis=1, keepdims=True))
