"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after learned rotations (iterative quantisation, several rotations side by side). A code
is split into substrings, and each substring has a table from its values to the rows that have them. Two codes within a
Hamming radius of m * (a + 1) - 1 differ by at most a bits in one of m substrings, so probing every table for all values
that near finds every code within the radius. Those are ranked by inner products of the original vectors in double
precision.

A query's probes go outwards, a = 0, 1, 2 and so on, each time to new values only; rows they list are scored once. The
score of the k-th best found so far says how many bits of a vector that good differ (an angle's share of the half circle
is the chance of a bit to differ; a margin is added), and once the radius that has been probed covers that many, the
query is done. Near neighbours are thus found with a few probes. Where neighbours are so far that probing up to their
radius takes more probes than there are rows, the codes are compared one by one instead: the same radius, the same result.

The query set meets all rows in blocks of bounded bytes: each pair of an index block and a query block is one task, and
each sends on its best for a query only. Equal vectors are one entry with their smallest ids.
(Methods: Norouzi, Punjani and Fleet 2012; Gong and Lazebnik 2011.)
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Rotations of all dimensions, standard deviations of margin, and vectors rotations are fitted on.
ROTATIONS, MARGIN, FITTED = 4, 1.3, 8192
#: Bits of a substring, at least and at most; between them, as many as a block's rows need to be told apart.
SHORT, LONG = 8, 20
#: Bytes of vectors in an index block and in a query block.
INDEX_BYTES, QUERY_BYTES = 32 << 20, 16 << 20


@dataclass
class Codes:
    """rotations: dims x bits, with one dimension more where vectors differ in length. scale: the largest norm."""

    rotations: np.ndarray
    scale: float
    lift: bool = True

    @property
    def bits(self) -> int:
        return self.rotations.shape[1]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Unit vectors whose cosines have the order of inner products: an index vector's missing length goes into one
        more dimension, which queries leave empty. Vectors of one length need none."""
        if not self.lift:
            return x / np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes, a row of booleans for each vector."""
        return self.lifted(x, query) @ self.rotations > 0

    def radius(self, cosine: float, margin: float = MARGIN) -> int:
        """Differing bits of a vector at this cosine, with a margin."""
        p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
        return math.ceil(self.bits * p + margin * math.sqrt(self.bits * p * (1 - p)))


def learn(sample: np.ndarray, scale: float, lift: bool = True, rotations: int = ROTATIONS, rounds: int = 20, seed: int = 1) -> Codes:
    """Each rotation starts at random and is turned towards the signs it gives."""
    codes = Codes(np.zeros((0, 0)), scale, lift)
    x = codes.lifted(sample)
    dims = x.shape[1]
    rnd = np.random.default_rng(seed)
    found = []
    width = -(-dims // 16) * 16
    for _ in range(rotations):
        r = np.linalg.qr(rnd.normal(size=(dims, dims)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ w
        found.append(np.hstack([r, rnd.normal(size=(dims, width - dims))]))  # random directions fill the last word
    codes.rotations = np.hstack(found)
    return codes


def masks(width: int, near: int) -> np.ndarray:
    """All substrings of so many bits with exactly `near` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), near)], np.int64)


def _words(bits: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view("<u8")


class MultiIndex:
    """Substring tables over one block of codes."""

    def __init__(self, bits: np.ndarray):
        n, self.bits = bits.shape
        wanted = min(max(SHORT, int(n).bit_length() - 1), LONG, self.bits)
        self.tables = self.bits // wanted
        # Substrings of equal length, or one bit more, which the others lack.
        self.width = -(-self.bits // self.tables)
        self.places = np.full((self.tables, self.width), self.bits)
        for t, some in enumerate(np.array_split(np.arange(self.bits), self.tables)):
            self.places[t, : len(some)] = some
        self.words = _words(bits)
        keys = self.substrings(bits) + (np.arange(self.tables) << self.width)
        #: Rows in order of table and value, and where those of each begin.
        self.rows = np.concatenate([np.argsort(k, kind="stable") for k in keys.T]).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(keys.ravel(), minlength=self.tables << self.width))])
        self.asked = np.full(n, -1, np.int64)
        self.masks = [masks(self.width, a) for a in range(3)]
        #: Rows that queries have looked at, by probes or by comparing all.
        self.visited = 0

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        padded = np.pad(bits, ((0, 0), (0, 1)))
        return np.stack([padded[:, p] @ (1 << np.arange(self.width)) for p in self.places], 1)

    def apart(self, rows: np.ndarray | slice, word: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[rows] ^ word).sum(1, dtype=np.int64)

    def covered(self, near: int) -> int:
        """The Hamming radius that probing all tables for values with up to `near` other bits finds completely."""
        return self.tables * (near + 1) - 1

    def probes(self, near: int) -> int:
        return self.tables * sum(math.comb(self.width, a) for a in range(min(near, self.width) + 1))

    def probed(self, values: np.ndarray, near: int, query: int, most: float = math.inf) -> np.ndarray | None:
        """Rows that no probe of this query has found yet, from the values with exactly `near` other bits; none if that
        many values list more than `most` rows."""
        while len(self.masks) <= near:
            self.masks.append(masks(self.width, len(self.masks)))
        keys = ((values[:, None] ^ self.masks[near]) + (np.arange(self.tables) << self.width)[:, None]).ravel()
        a = self.starts[keys]
        n = self.starts[keys + 1] - a
        if n.sum() > most:
            return None
        a, n = a[n > 0], n[n > 0]
        rows = self.rows[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
        rows = np.unique(rows[self.asked[rows] != query])
        self.asked[rows] = query
        self.visited += len(rows)
        return rows

    def within(self, code: np.ndarray, r: int) -> np.ndarray:
        """Rows of all codes that differ from code in at most r bits, by probes alone."""
        query = int(self.asked.max(initial=-1)) + 1
        values, word, found = self.substrings(code[None])[0], _words(code[None])[0], []
        for near in range(self.width + 1):
            rows = self.probed(values, near, query)
            found.append(rows[self.apart(rows, word) <= r])
            if self.covered(near) >= r:
                break
        return np.sort(np.concatenate(found))

    def best(self, codes: Codes, x: np.ndarray, q: np.ndarray, code: np.ndarray, k: int, query: int, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of what is found, the k best among it; barred rows take no part. query numbers the query."""
        n, length = len(x), float(np.linalg.norm(q)) * codes.scale
        values, word = self.substrings(code[None])[0], _words(code[None])[0]
        rows, scores, enough = np.zeros(0, np.int64), np.zeros(0), codes.bits

        def taken(new: np.ndarray, apart: np.ndarray) -> None:
            """Scores new rows, the nearest codes first: they tell how far the others can be."""
            nonlocal rows, scores, enough
            if barred is not None:
                free = ~barred[new]
                new, apart = new[free], apart[free]
            few = 4 * k
            while len(new):
                if few < len(new):
                    some = np.argpartition(apart, few)[:few]
                    rest = np.ones(len(new), bool)
                    rest[some] = False
                else:
                    some, rest = slice(None), np.zeros(len(new), bool)
                rows, scores = np.concatenate([rows, new[some]]), np.concatenate([scores, x[new[some]] @ q])
                if len(rows) >= k:
                    enough = min(enough, codes.radius(np.partition(scores, -k)[-k] / length))
                rest &= apart <= enough
                new, apart, few = new[rest], apart[rest], n

        for near in range(self.width + 1):
            # Where the next probes, or all that are still to come, or the rows they list are more than a pass over the
            # codes is worth, that is done. The first two rounds may not have found the near ones yet.
            if self.probes(near) * 8 > n or (near > 1 and self.probes(enough // self.tables) > n):
                break
            new = self.probed(values, near, query, n / 4)
            if new is None:
                break
            apart = self.apart(new, word)
            taken(new[apart <= enough], apart[apart <= enough])
            if self.covered(near) >= enough:
                return rows, scores
        self.visited += n
        apart = self.apart(slice(None), word)
        left = np.flatnonzero((apart <= enough) & (self.asked != query))
        taken(left, apart[left])
        if len(rows) < k:  # the radius may have left out some
            self.asked[rows] = query
            left = np.setdiff1d(np.arange(n), rows)
            rows, scores = np.concatenate([rows, left]), np.concatenate([scores, x[left] @ q])
            if barred is not None:
                rows, scores = rows[~barred[rows]], scores[~barred[rows]]
        return rows, scores


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", fitted: int = FITTED, index_bytes: int = INDEX_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, id, score): for each row of queries the k rows of vectors with the largest inner products that
    the index finds; ties go to smaller ids. With fewer than k candidates all are returned.

    Vectors that are null, zero, or hold null or non-finite components take no part, neither do those of another length
    than most, nor rows without id. Rows alike in id and vector are one; rows of one id with different vectors are rows
    of their own, as queries (each has its k neighbours, under the same query_id) and as candidates (an id can then be
    found several times), but no row of a query's own id is its neighbour. Other columns are ignored whatever their
    names. Empty tables give no rows. Rotations are fitted on at most `fitted` vectors; every vector is indexed.
    """
    v = F.col("v")

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("v"))
        fine = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return rows.where(fine).withColumn("v", F.transform(v, lambda x: x + F.lit(0.0)))  # no negative zeros

    schema = "query_id long, rank int, id long, score double"
    spark = vectors.sparkSession
    given = usable(vectors)
    lengths = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = lengths[0].n
    # Vectors are called by a digest of their exact components.
    key = F.unhex(F.substring(F.sha2(F.array_join(F.transform(v, lambda x: x.cast("string")), ","), 256), 1, 32))
    given = given.where(F.size("v") == dims).withColumn("key", key)
    # Of equal vectors only the k + 1 smallest ids can be among anyone's k.
    one = Window.partitionBy("key").orderBy("id")
    ids = given.select("key", "id").distinct()
    fewest = ids.withColumn("n", F.row_number().over(one)).where(F.col("n") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = checkpointed(given.groupBy("key").agg(F.first("v").alias("v")).join(fewest, "key"))
    asking = usable(queries).where(F.size("v") == dims).withColumn("key", key).select("id", "key").distinct()
    # Queries of one vector are one search, but those of an id with several vectors have their own, without that id.
    several = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("own"))
    asking = checkpointed(asking.join(several, asking["id"] == several["own"], "left").select("id", "key", "own"))
    asked = checkpointed(asking.select("key", "own").distinct().join(entries.select("key", "v"), "key").withColumn("q", F.xxhash64("key", "own")))

    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    least, scale = entries.agg(F.min(norm), F.max(norm)).first()
    sample = entries.select("v").orderBy(F.xxhash64("key"), "key").limit(fitted).toArrow()
    codes = learn(_vectors(sample["v"]), scale, least < scale * (1 - 1e-6))
    rows, searches = entries.count(), asked.count()
    shards, blocks = (max(1, -(-n * dims * 8 // size)) for n, size in ((rows, index_bytes), (searches, query_bytes)))
    # A table of few blocks is searched by as many tasks as there are cores.
    blocks = max(blocks, min(-(-spark.sparkContext.defaultParallelism // shards), -(-searches // 64)), 1)

    def run(at, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            x, q = _vectors(left["v"]), _vectors(right["asked"])
            index, code, listed = MultiIndex(codes.of(x)), codes.of(q, True), left["ids"].combine_chunks()
            first = listed.values.to_numpy()[listed.offsets.to_numpy()[:-1]]
            single = np.diff(listed.offsets.to_numpy()) == 1
            for i, own in enumerate(right["own"].to_pylist()):
                barred = None if own is None else single & (first == own)
                found, scores = index.best(codes, x, q[i], code[i], k + 1, i, barred)
                top = np.lexsort((first[found], -scores))[: k + 1]
                out[0] += [i] * len(top)
                out[1] += found[top].tolist()
                out[2] += scores[top].tolist()
            who, what = pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())
            return pa.table({"q": right["key"].take(who), "own": right["own"].take(who), "ids": listed.take(what).cast(pa.list_(pa.int64())), "score": pa.array(out[2], pa.float64())})
        return pa.table({"q": pa.array([], pa.binary()), "own": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})

    spread = lambda col, n: F.pmod(col, F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select("v", "ids", spread(F.xxhash64("key"), shards).alias("s"), every(blocks).alias("b")).groupBy("s", "b")
    right = asked.select("key", "own", v.alias("asked"), spread(F.xxhash64("q"), blocks).alias("b"), every(shards).alias("s")).groupBy("s", "b")
    hits = left.cogroup(right).applyInArrow(run, "q binary, own long, ids array<long>, score double")

    best = Window.partitionBy("q", "own").orderBy(F.desc("score"), F.col("ids")[0])
    top = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    each = top.select("q", "own", "score", F.explode("ids").alias("id")).where(F.col("own").isNull() | (F.col("id") != F.col("own")))
    cut = each.withColumn("n", F.row_number().over(Window.partitionBy("q", "own").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = cut.groupBy("q", "own").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    own = F.filter("found", lambda x: x["id"] != F.col("query_id"))
    asks = asking.select(F.col("id").alias("query_id"), F.col("key").alias("q"), F.col("own").alias("mine"))
    out = asks.join(lists, (asks["q"] == lists["q"]) & asks["mine"].eqNullSafe(lists["own"])).select("query_id", F.posexplode(F.slice(own, 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    from .common import table

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
