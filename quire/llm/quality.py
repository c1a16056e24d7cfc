"""A quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairs cost no more than the features: their
sum is half of sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2. (Method: Rendle 2010.)

The model is fitted with numpy from a bounded sample of labelled rows and scored in Arrow functions over whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, texts

#: Hashed words, factors, and bins of a statistic.
WORDS, FACTORS, BINS = 1 << 13, 8, 8
#: Labelled rows that a model is fitted on at most, those with the smallest hash of their id.
MAX_LABELLED = 8000

_LETTERS = [*range(65, 91), *range(97, 123), *range(128, 256)]
_CLASSES = {"upper": [*range(65, 91)], "letter": _LETTERS, "digit": [*range(48, 58)], "stop": [*map(ord, ".,;:?")], "mark": [*map(ord, "!")], "symbol": [*map(ord, "#*%$&|~^<>{}[]=+@\\_")], "space": [*map(ord, " \t\n\r\v\f")]}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _codes in enumerate(_CLASSES.values()):
    _TABLE[_codes, _i] = 1
#: Structure statistics, each from 0 to 1.
STATS = ("chars", "words", "word_length", "distinct", "repeats", "top", "upper", "letter", "digit", "stop", "mark", "symbol", "space", "lines", "line_repeats", "ends")


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    data = np.frombuffer(raw(text), np.uint8)
    n, k = max(1, len(data)), max(1, len(words))
    upper, letter, *others = (np.bincount(data, minlength=256) @ _TABLE).tolist()
    lines = text.split("\n")
    return [
        min(1.0, np.log10(len(text) + 1) / 6), min(1.0, np.log10(len(words) + 1) / 5), min(1.0, len(text) / k / 20), len(counts) / k,
        sum(map(eq, words, words[1:])) / k, max(counts.values(), default=0) / k, upper / max(1, letter), letter / n, *(x / n for x in others),
        min(1.0, np.log10(len(text) / len(lines) + 1) / 4), 1 - len(set(lines)) / len(lines), sum(not w[-1].isalnum() for w in words) / k,
    ]


class Features:
    """Sparse features of a text: hashed words of unit length together, and each statistic spread over two
    neighbouring bins. meta: numbers from 0 to 1 or None, which have bins of their own."""

    def __init__(self, words: int = WORDS, meta: int = 0):
        self.words, self.dims = words, words + (len(STATS) + meta) * (BINS + 1)
        self.hashes: dict[str, int] = {}

    def of(self, text: str, meta: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts, hashes = Counter(words), self.hashes
        if len(hashes) > 300_000:
            hashes.clear()
        for w in counts:
            if w not in hashes:
                hashes[w] = zlib.crc32(raw(w.lower())) % self.words
        tf = np.bincount(np.fromiter(map(hashes.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts)), self.words)
        index = np.flatnonzero(tf)
        value = np.sqrt(tf[index] / max(1, len(words)))
        at, extra = [], []
        for i, x in enumerate([*statistics(text, words, counts), *meta]):
            if x is None:
                at.append(self.words + i * (BINS + 1))
                extra.append(1.0)
                continue
            # Finer towards 0, where shares of symbols and repeats tell most.
            low, part = divmod(min(1.0, max(0.0, x)) ** 0.5 * (BINS - 1), 1)
            first = self.words + i * (BINS + 1) + 1 + int(low)
            at += [first, first + 1][: 1 + (part > 0)]
            extra += [1 - part, part][: 1 + (part > 0)]
        return np.concatenate([index, at]).astype(np.int32), np.concatenate([value, extra])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores from 0 to 1, in time linear in the number of features. No row may be without features."""
        if not rows:
            return np.zeros(0)
        index, value = (np.concatenate(x) for x in zip(*rows, strict=True))
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(scaled * scaled, starts)
        z = self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * (sums * sums - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dims: int, factors: int = FACTORS, epochs: int = 15, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> Machine:
    """Logistic loss by Adagrad on small batches. Without rows, or with one class only, the score is a constant."""
    y = np.array(labels, float)
    rnd = np.random.default_rng(seed)
    linear, v = np.zeros(dims), rnd.normal(0, 0.05, (dims, factors))
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(set(labels)) < 2:
        return Machine(bias if len(y) else 0.0, linear, np.zeros_like(v))
    seen = [1e-6, np.full(dims, 1e-6), np.full((dims, factors), 1e-6)]
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for at in range(0, len(y), 128):
            batch = order[at : at + 128]
            columns = np.unique(np.concatenate([rows[i][0] for i in batch]))
            x = np.zeros((len(batch), len(columns)))
            for r, i in enumerate(batch):
                x[r, np.searchsorted(columns, rows[i][0])] = rows[i][1]
            vc = v[columns]
            sums, x2 = x @ vc, x * x
            z = bias + x @ linear[columns] + 0.5 * ((sums * sums).sum(1) - (x2 @ (vc * vc)).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[batch]) / len(batch)
            gb, gl = g.sum(), x.T @ g + decay * linear[columns]
            gv = x.T @ (g[:, None] * sums) - (x2.T @ g)[:, None] * vc + decay * vc
            seen[0] += gb * gb
            seen[1][columns] += gl * gl
            seen[2][columns] += gv * gv
            bias -= rate * gb / np.sqrt(seen[0])
            linear[columns] -= rate * gl / np.sqrt(seen[1][columns])
            v[columns] -= rate * gv / np.sqrt(seen[2][columns])
    return Machine(float(bias), linear, v)


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def _scaled(meta: tuple[str, ...]) -> list[Column]:
    return [F.least(F.lit(1.0), F.log10(F.greatest(F.col(f"`{c}`").cast("double"), F.lit(0.0)) + 1) / 8).alias(f"meta{i}") for i, c in enumerate(meta)]


def _rows(batch: pa.RecordBatch, features: Features) -> list:
    meta = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True) if batch.num_columns > 2 else [()] * batch.num_rows
    return [features.of(t, m) for t, m in zip(texts(batch.column(1)), meta, strict=True)]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", meta: tuple[str, ...] = (), max_labelled: int = MAX_LABELLED, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine fitted on rows of docs that labels marks 0 or 1, of ids whose fold isn't 0, max_labelled of them at
    most: those with the smallest hash of their id. An id that is labelled twice counts once, with its larger label; one
    that several rows of docs have counts once too, with the row whose features have the smallest hash."""
    chosen = (
        labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("id")) != 0))
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    features_of = Features(words, len(meta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = _rows(batch.select([0, 2, *range(3, batch.num_columns)]), features_of)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float64()))], ["id", "y", "i", "v"])

    own = docs.select(docs[id_col].alias("id"), F.col(f"`{text_col}`").alias("text"), *_scaled(meta))
    # The labelled ids are at most max_labelled, so they are broadcast.
    joined = own.join(F.broadcast(chosen), "id").select("id", "y", "text", *[f"meta{i}" for i in range(len(meta))])
    made = joined.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, y int, i array<int>, v array<double>")
    # A row for each labelled id, however often docs has it, so the driver gets max_labelled rows at most.
    got = made.groupBy("id").agg(F.min(F.struct(F.xxhash64("i", "v").alias("h"), "y", "i", "v")).alias("r")).select("id", "r.y", "r.i", "r.v").toArrow()
    sample = sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), (x.values.to_numpy() for x in got["i"]), (x.values.to_numpy() for x in got["v"]), strict=True), key=lambda r: (r[0], r[1], r[2].tolist(), r[3].tolist()))
    return fit([(r[2], r[3]) for r in sample], [r[1] for r in sample], features_of.dims)


def score(docs: DataFrame, machine: Machine, meta: tuple[str, ...] = (), threshold: float = 0.3, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs, by its whole text.

    Null texts score like empty ones, null metadata has a feature of its own; null ids are held out; repeated rows are
    kept; columns other than id, text and meta are never read. An empty table gives no rows.
    """
    features_of = Features(words, len(meta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = np.concatenate([machine.score(_rows(batch.slice(at, 64), features_of)) for at in range(0, max(1, batch.num_rows), 64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    own = docs.select(docs[id_col].cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *_scaled(meta))
    out = own.mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, meta: tuple[str, ...] = (), threshold: float = 0.3, words: int = WORDS, text_col: str = "text") -> DataFrame:
    """The rows of docs that score threshold or more, all columns as they are; the cases are those of score()."""
    features_of, names = Features(words, len(meta)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = part.select([0, names.index(text_col), *range(len(names), part.num_columns)])
                keep = machine.score(_rows(own, features_of)) >= threshold
                yield part.select(list(range(len(names)))).filter(pa.array(keep))

    scaled = [c.alias(f"_meta{i}") for i, c in enumerate(_scaled(meta))]
    return docs.select(*[docs[c] for c in names], *scaled).mapInArrow(run, docs.schema)


#: The only metadata of the query.
META = ("n_chars",)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"), meta=META), META)
