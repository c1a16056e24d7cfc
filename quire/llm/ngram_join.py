"""Self-join of documents by the Jaccard similarity of their word n-gram sets, through prefix trees.

The join is exact: no link between different texts is lost, whatever the sizes of groups. Sets that are equal are one
class from the start. Then:

1. Filter. Two sets that link share at least m of the elements that come first by hash in both (prefixes of adaptive
   length). Tasks announce the distinct prefix hashes of a batch of documents, packed, one row for each bucket of
   hashes, and learn how many of each document's occur elsewhere. Few documents have partners to look for.
2. Prefixes. For those the frequencies of all their n-grams are counted in the same way. The n-grams of a set, rarest
   first, are its globally ordered form; two sets that link share one of the first (1 - t) n + 1. Sets with a shared
   one are candidates, and the connected parts of the candidate graph are groups that links never leave.
3. Trees. The sets of a group are stored in a tree of n-grams in one order. A set is looked up by walking the tree: the
   overlap with a path is computed once for all sets below it, and a subtree is left as soon as the n-grams that
   remain can't bring any of its sets to the threshold. Sets that are found leave the tree and are looked up next, so
   a group of near copies costs little more than its size.

A group too large for one task, in sets or in bytes, is dealt into blocks; see links_in_groups().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, kept, raw, slices, spread_join
from .components import connected

U = np.uint64
#: Documents and characters of a batch whose hashes are announced together.
BATCH_DOCS, BATCH_CHARS = 1500, 8 << 20
#: Sets of a group that meet in one task, and bytes of their hashes.
GROUP, GROUP_BYTES = 2000, 16 << 20


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams. Words are runs without ASCII white space, A-Z in small
    letters. A text with fewer words has its whole sequence as one; one without words has none."""
    words = raw(text).lower().split()  # both know ASCII only, on bytes
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, len(w) if len(w) < width else width, U)
    for j in range(min(width, len(w))):
        h = mixed(h * U(0x9E3779B97F4A7C15) + w[j : j + n])
    return np.unique(h)


def class_of(hashes: np.ndarray) -> str:
    """Equal for equal sets."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of n shares with any set it links to."""
    return -(-n * percent // 100)


def announced(n: int, percent: int) -> int:
    """Length of the prefix that a set of n announces; any two that link share needed() of them or more."""
    return n - least_overlap(n, percent) + 1 + n // 12


def needed(n: int, percent: int) -> int:
    """The smaller of the two sets has least_overlap() elements or more, which sets what is shared."""
    return 1 + least_overlap(n, percent) // 12


# Trees


class Node:
    """A piece of path, the nodes below it by their first n-gram, the sets that end here, and the sizes of all sets
    here and below."""

    __slots__ = ("below", "ends", "high", "low", "path")

    def __init__(self, path: np.ndarray, ends: list[int], size: int):
        self.path, self.ends, self.below, self.low, self.high = path, ends, {}, size, size


class Tree:
    """Sets of ranks in ascending order."""

    def __init__(self, percent: int):
        self.percent, self.root, self.count = percent, Node(np.zeros(0, np.int64), [], 0), 0

    def add(self, ranks: np.ndarray, which: int) -> None:
        self.count += 1
        node, at, size = self.root, 0, len(ranks)
        if self.count == 1:
            node.low = node.high = size
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            if at == size:
                node.ends.append(which)
                return
            child = node.below.get(int(ranks[at]))
            if child is None:
                node.below[int(ranks[at])] = Node(ranks[at:], [which], size)
                return
            n = min(len(child.path), size - at)
            differ = np.flatnonzero(child.path[:n] != ranks[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.path):
                upper = Node(child.path[:same], [], child.low)
                upper.low, upper.high = child.low, child.high
                child.path = child.path[same:]
                upper.below[int(child.path[0])] = child
                node.below[int(ranks[at])] = child = upper
            node, at = child, at + same

    def take(self, ranks: np.ndarray, inside: np.ndarray, upto: np.ndarray) -> list[int]:
        """Removes the sets that link with the set of ranks, and returns them. inside[r] is 1 if r is in the set, and
        upto[r] is how many of its elements are r or before."""
        x, found, p = len(ranks), [], self.percent
        left = self._walk(self.root, 0, 0, ranks, inside, upto, found, x, p)
        if not left:
            self.root = Node(np.zeros(0, np.int64), [], 0)
        self.count -= len(found)
        return found

    def _walk(self, root, shared, depth, ranks, inside, upto, found, x, p) -> bool:
        """Whether anything is left below."""
        # Nodes are visited twice: on the way down for the overlap, on the way up to drop what has become empty.
        stack = [(root, shared, depth, None, None, False)]
        while stack:
            node, shared, depth, parent, key, done = stack.pop()
            if done:
                if not node.ends and not node.below and parent is not None:
                    del parent.below[key]
                continue
            if len(node.path):
                shared += int(inside[node.path].sum())
                depth += len(node.path)
                rest = x - int(upto[node.path[-1]])
            else:
                rest = x
            size = max(node.low, min(node.high, depth + rest))
            if (100 + p) * (shared + min(rest, size - depth)) < p * (x + size):
                continue
            if node.ends and 100 * shared >= p * (x + depth - shared):
                found += node.ends
                node.ends = []
            stack.append((node, 0, 0, parent, key, True))
            for k, child in node.below.items():
                stack.append((child, shared, depth, node, k, False))
        return bool(root.ends or root.below)


def groups_of(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the index of the first set of its connected group."""
    if not sets:
        return []
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -counts))] = np.arange(len(every))  # frequent first, for long common paths
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(rank[inverse[e - len(s) : e]]) for s, e in zip(sets, ends, strict=True)]
    tree = Tree(percent)
    for i, r in enumerate(ranked):
        if len(r):
            tree.add(r, i)
    label = list(range(len(sets)))
    waiting = [len(r) > 0 for r in ranked]
    inside = np.zeros(len(every), np.int64)
    for i in range(len(sets)):
        if not waiting[i]:
            continue
        todo = [i]
        waiting[i] = False
        while todo and tree.count:
            r = ranked[todo.pop()]
            inside[r] = 1
            for j in tree.take(r, inside, np.cumsum(inside)):
                waiting[j] = False
                if j != i:
                    label[j] = i
                    todo.append(j)
            inside[r] = 0
    return label


# Spark


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    claim("ngram_join", _WORDS.clear)
    held, chars = [], 0
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            chars += len(row[-1] or "")
            if len(held) >= BATCH_DOCS or chars >= BATCH_CHARS:
                yield held
                held, chars = [], 0
    if held:
        yield held


def _numbered(batches: Iterator) -> Iterator[tuple[int, object]]:
    start = TaskContext.get().partitionId() << 32
    for i, b in enumerate(batches):
        yield start + i, b


_ASKED = "bucket int, batch long, id array<long>, th array<long>, class array<string>, n array<int>, shared array<int>, dense boolean, owners binary, hashes binary"


def _pack(h: np.ndarray) -> bytes:
    """The low 48 bits of each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _announce(own: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """For each batch a row about its documents (bucket -1), and a row for each bucket of its prefix hashes: first
    those that one document has alone, in order of documents, then those of several. owners tells the former: dense,
    how many each document has, or else whose each is, whatever is shorter, so rows stay small with many buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, docs in _numbered(_batches(batches)):
            sets = [shingles(d[2], width) for d in docs]
            first = [s[: announced(len(s), percent)] for s in sets]
            h = np.concatenate(first)
            who = np.repeat(np.arange(len(docs)), [len(f) for f in first])
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
            times = np.diff(np.append(np.flatnonzero(new), len(h)))
            shared = np.repeat(times > 1, times)
            yield pa.RecordBatch.from_pylist(
                [{"bucket": -1, "batch": number, "id": [d[0] for d in docs], "th": [d[1] for d in docs], "class": [class_of(s) if len(s) else None for s in sets], "n": [len(s) for s in sets], "shared": np.bincount(who[shared], minlength=len(docs)).tolist()}],
                schema,
            )
            h, who = h[new], np.where(shared, len(docs), who)[new]
            bucket = (h % U(buckets)).astype(np.int64)
            order = np.lexsort((who, bucket))
            h, who, bucket = h[order], who[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                x, y = edges[b], edges[b + 1]
                if x < y:
                    alone = who[x:y][who[x:y] < len(docs)]
                    dense = len(alone) > len(docs)
                    owners = np.bincount(alone, minlength=len(docs)) if dense else alone
                    rows.append({"bucket": b, "batch": number, "dense": dense, "owners": owners.astype("<u4").tobytes(), "hashes": _pack(h[x:y])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("id", pa.list_(pa.int64())), ("th", pa.list_(pa.int64())), ("class", pa.list_(pa.string())), ("n", pa.list_(pa.int32())), ("shared", pa.list_(pa.int32())), ("dense", pa.bool_()), ("owners", pa.binary()), ("hashes", pa.binary())])
    return own.select("id", "th", "text").mapInArrow(run, _ASKED)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in slices(batches):
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _elsewhere(asked: DataFrame) -> DataFrame:
    """(batch, found): for each row of a bucket the documents with hashes that other batches have too, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            parts = [_unpack(r["hashes"]) for r in rows]
            _, inverse, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            again, out, at = times[inverse] > 1, [], 0
            for r, p in zip(rows, parts, strict=True):
                owners = np.frombuffer(r["owners"], "<u4")
                if r["dense"]:
                    owners = np.repeat(np.arange(len(owners)), owners)
                which, count = np.unique(owners[again[at : at + len(owners)]], return_counts=True)
                at += len(p)
                if len(which):
                    out.append({"batch": r["batch"], "found": np.stack([which, count], 1).astype("<u4").tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("batch", pa.int64()), ("found", pa.binary())]))

    dealt = asked.select("bucket", "batch", "dense", "owners", "hashes").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "batch long, found binary")


def _survivors(documents: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(id, th, class) of the documents that share enough of their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("class", pa.string())])
        for batch in slices(batches):
            for r in batch.to_pylist():
                total = np.array(r["shared"], np.int64)
                for f in r["found"] or ():
                    pairs = np.frombuffer(f, "<u4").reshape(-1, 2)
                    total[pairs[:, 0]] += pairs[:, 1]
                keep = [i for i, n in enumerate(r["n"]) if n and total[i] >= needed(n, percent)]
                yield pa.RecordBatch.from_pylist([{"id": r["id"][i], "th": r["th"][i], "class": r["class"][i]} for i in keep], schema)

    lists = found.groupBy("batch").agg(F.collect_list("found").alias("found"))
    return documents.join(lists, "batch", "left").select("id", "th", "class", "n", "shared", "found").mapInArrow(run, "id long, th long, class string")


_SETS = "batch long, class array<string>, n array<int>, hashes binary"


def _numbers(batch: int, n: int) -> np.ndarray:
    """Numbers of a batch's sets: its partition, its place there, and theirs in it, which stays below 2 ** 11."""
    return (np.int64(batch >> 32) << 42 | np.int64(batch & 0xFFFFFFFF) << 11) + np.arange(n)


def _sets(own: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """The sets of chosen classes, in batches; the bytes of their hashes one after the other. See _numbers() for what
    they are called from here on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("class", pa.list_(pa.string())), ("n", pa.list_(pa.int32())), ("hashes", pa.binary())])
        for number, docs in _numbered(_batches(batches)):
            sets = [shingles(d[-1], width) for d in docs]
            yield pa.RecordBatch.from_pylist([{"batch": number, "class": [d[0] for d in docs], "n": [len(s) for s in sets], "hashes": np.concatenate(sets).tobytes()}], schema)

    keyed = chosen.select(F.coalesce("id", F.lit(-1)).alias("did"), "th", "class").groupBy("class").agg(F.min(F.struct("did", "th")).alias("k")).select("class", "k.did", "k.th")
    # Rows alike in id and text are one.
    distinct = own.select(F.coalesce("id", F.lit(-1)).alias("did"), "th", "text").dropDuplicates(["did", "th"])
    return distinct.join(keyed, ["did", "th"]).select("class", "text").mapInArrow(run, _SETS)


def _in_buckets(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order of bucket, and how often each occurs."""
    h, times = np.unique(hashes, return_counts=True)
    order = np.argsort(h % U(buckets), kind="stable")
    return h[order], times[order]


def _frequencies(sets: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, often): for each batch and bucket how many sets have each of its hashes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("counts", pa.binary()), ("hashes", pa.binary())])
        for batch in slices(batches):
            for r in batch.to_pylist():
                h, times = _in_buckets(np.frombuffer(r["hashes"], U), buckets)
                edges = np.searchsorted((h % U(buckets)).astype(np.int64), np.arange(buckets + 1))
                yield pa.RecordBatch.from_pylist([{"bucket": b, "batch": r["batch"], "counts": times[x:y].astype("<u4").tobytes(), "hashes": _pack(h[x:y])} for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if x < y], schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("often", pa.binary())])
        for rows in _by_bucket(batches):
            parts = [_unpack(r["hashes"]) for r in rows]
            every, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]), len(every))[inverse]
            ends = np.cumsum([len(p) for p in parts])
            yield pa.RecordBatch.from_pylist([{"batch": r["batch"], "bucket": r["bucket"], "often": np.minimum(total[e - len(p) : e], 2**32 - 1).astype("<u4").tobytes()} for r, p, e in zip(rows, parts, ends, strict=True)], schema)

    dealt = sets.select("batch", "hashes").mapInArrow(ask, "bucket int, batch long, counts binary, hashes binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(answer, "batch long, bucket int, often binary")


def _prefixes(sets: DataFrame, often: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(h, set): the n-grams of each set's prefix, rarest first, that other sets have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for r in batch.to_pylist():
                hashes = np.frombuffer(r["hashes"], U)
                every, _ = _in_buckets(hashes, buckets)
                often = np.concatenate([np.frombuffer(x["often"], "<u4") for x in sorted(r["often"], key=lambda x: x["bucket"])])
                order = np.argsort(every)
                often = often[order][np.searchsorted(every[order], hashes)]
                end, found = 0, []
                for number, n in zip(_numbers(r["batch"], len(r["n"])), r["n"], strict=True):
                    h, f = hashes[end : end + n], often[end : end + n]
                    end += n
                    first = np.lexsort((h, f))[: n - least_overlap(n, percent) + 1]
                    first = first[f[first] > 1]
                    if len(first):
                        found.append((h[first].view(np.int64), np.full(len(first), number)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["h", "set"])

    lists = often.groupBy("batch").agg(F.collect_list(F.struct("bucket", "often")).alias("often"))
    return sets.join(lists, "batch").select("batch", "n", "hashes", "often").mapInArrow(run, "h long, set long")


def _rows_of(sets: DataFrame) -> DataFrame:
    """(set, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for r in batch.to_pylist():
                ends = np.cumsum(r["n"]) * 8
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(r["batch"], len(ends))), pa.array([r["hashes"][e - n * 8 : e] for e, n in zip(ends, r["n"], strict=True)], pa.binary())], ["set", "hashes"])

    return sets.select("batch", "n", "hashes").mapInArrow(run, "set long, hashes binary")


def _names(sets: DataFrame) -> DataFrame:
    """(set, class, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(r["batch"], len(r["class"]))), pa.array(r["class"], pa.string()), pa.array(r["n"], pa.int32())], ["set", "class", "n"])

    return sets.select("batch", "class", "n").mapInArrow(run, "set long, class string, n int")


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of a forest that connects what links connect, inside each (group, block) of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            names = t["set"].to_pylist()
            labels = groups_of([np.frombuffer(x, U) for x in t["hashes"].to_pylist()], percent)
            links = [(names[i], names[j]) for i, j in enumerate(labels) if names[i] != names[j]]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["u", "v"])

        held, last = [], None
        for batch in slices(batches):
            keys = list(zip(batch.column("group").to_pylist(), batch.column("block").to_pylist(), strict=True))
            at = 0
            for i, k in enumerate(keys):
                if k != last:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    if held:
                        yield work(held)
                    held, at, last = [], i, k
            held.append(batch.slice(at))
        if held:
            yield work(held)

    dealt = rows.select("group", "block", "set", "hashes").repartition("group", "block").sortWithinPartitions("group", "block", "set")
    return dealt.mapInArrow(run, "u long, v long")


def links_in_groups(sets: DataFrame, groups: DataFrame, prefixes: DataFrame, percent: int, group_size: int, group_bytes: int, count: int | None = None) -> DataFrame:
    """Edges (u, v) that connect what links connect, for sets (set, hashes), their groups (set, group, n, members, total),
    where total is the sum of n in the group, and the prefixes (h, set) that the groups come from. count: how many sets
    there are, or more.

    A group of more than group_size sets or group_bytes bytes is dealt into blocks that are joined on their own; then the
    first sets of what has been connected are joined across blocks, which connects near copies. Where a group then still
    has several parts, links between them can only be among sets that share an n-gram of their prefixes: each such
    n-gram's sets are joined, if they are of several parts. They are few, as prefixes are of the rarest n-grams; those of
    one that has too many for a task are joined block by block in pairs. Which sets meet is decided on numbers alone;
    hashes join them last.
    """

    def blocks(members: str, total: str):
        return F.ceil(F.greatest(F.col(members) / group_size, F.col(total) * 8 / group_bytes)).cast("int")

    named = groups.withColumn("blocks", blocks("members", "total")).withColumn("number", F.pmod(F.hash("set"), F.col("blocks")))

    def joined(some: DataFrame) -> DataFrame:
        return _joined(sets.join(some.select("set", "group", "block"), "set"), percent)

    edges = kept(joined(named.withColumn("block", F.col("number").cast("string"))))
    large = named.where("blocks > 1")
    if large.isEmpty():
        return edges

    def labelled(edges: DataFrame) -> DataFrame:
        return kept(large.join(connected(edges, count and 2 * count).withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set")), count)

    firsts = labelled(edges).where("set = label").select("set", "group", "n")
    several = kept(firsts.groupBy("group").agg(F.count("*").alias("times"), F.sum("n").alias("sum")).where("times > 1").withColumn("firsts", F.col("times")), count)
    across = spread_join(firsts, several, ["group"], "times", F.hash("set"))
    edges = kept(edges.unionByName(joined(across.withColumn("block", F.pmod(F.hash("set", F.lit(7)), blocks("firsts", "sum")).cast("string")))))
    still = labelled(edges).select("set", "label", "n")
    shared = kept(prefixes.join(still, "set"))
    lists = shared.groupBy("h").agg(F.count("*").alias("times"), F.sum("n").alias("sum"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    lists = kept(lists.select("h", "times", F.col("times").alias("listed"), "sum"))
    if lists.isEmpty():
        return edges
    met = spread_join(shared.select("h", "set"), lists, ["h"], "times", F.hash("set")).withColumn("blocks", blocks("listed", "sum")).withColumn("number", F.pmod(F.hash("set", F.lit(3)), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("number"))
    pairs = met.withColumn("other", F.explode(F.when(F.col("blocks") > 1, others).otherwise(F.array(F.lit(0)))))
    block = F.concat_ws("-", F.least("number", "other"), F.greatest("number", "other"))
    return kept(edges.unionByName(joined(pairs.select("set", F.col("h").alias("group"), block.alias("block")))))


def _classes(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str, group_size: int, group_bytes: int, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """(id, th, class, n) for each row, class null without words; and for each class (class, times, low, first): how many
    rows it has, the smallest id and the first row (as in one_of_each) of all that links connect it with."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    spark = docs.sparkSession
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(docs[text_col], F.lit(""))
    own = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    asked = kept(_announce(own, buckets, width, percent))
    documents = asked.where("bucket = -1").select("batch", "id", "th", "class", "n", "shared")
    chosen = _survivors(documents, _elsewhere(asked.where("bucket >= 0")), percent)
    sets = kept(_sets(own, chosen, width))
    prefixes = kept(_prefixes(sets, _frequencies(sets, buckets), buckets, percent))
    listed = prefixes.count()
    least = kept(prefixes.groupBy("h").agg(F.min("set").alias("v"), F.count("*").alias("times")).where("times > 1"), listed // 2)
    candidates = spread_join(prefixes, least, ["h"], "times", F.hash("set")).select(F.col("set").alias("u"), "v").where("u <> v").distinct()
    names = kept(_names(sets))
    count = names.count()
    groups = kept(connected(candidates, listed).select(F.col("node").alias("set"), F.col("label").alias("group")).join(names.select("set", "n"), "set"), count)
    sizes = kept(groups.groupBy("group").agg(F.count("*").alias("times"), F.sum("n").alias("total")).withColumn("members", F.col("times")), count)
    sized = kept(spread_join(groups, sizes, ["group"], "times", F.hash("set")), count)
    edges = links_in_groups(_rows_of(sets), sized, prefixes, percent, group_size, group_bytes, count)
    labels = connected(edges).withColumnRenamed("node", "set").join(names, "set").select("class", F.col("label").cast("string"))
    flat = documents.select(F.explode(F.arrays_zip("id", "th", "class", "n")).alias("d")).select("d.id", "d.th", "d.class", F.col("d.n").cast("long").alias("n"))
    first = F.struct(F.col("id").isNull().alias("x"), "id", "th")
    classes = flat.where("class is not null").groupBy("class").agg(F.count("*").alias("rows"), F.min("id").alias("low"), F.min(first).alias("first"))
    called = kept(classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")))
    linked = kept(called.groupBy("label").agg(F.count("*").alias("times"), F.min("low").alias("low"), F.min("first").alias("first")))
    found = spread_join(called.select("class", "label", F.col("rows")), linked, ["label"], "times", F.hash("class"))
    return flat, kept(found.select("class", F.col("rows").alias("times"), "low", "first"))


def ngram_components(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text", group_size: int = GROUP, group_bytes: int = GROUP_BYTES, buckets: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id, class) for each row of docs.

    Two rows link when 100 * intersection >= percent * union of their n-gram sets; component_id is the smallest id that
    links reach, its own included. Rows of equal sets have equal classes. Null and empty texts, and those without
    words, have no n-grams and link with nothing, so their component is their own id. Null ids are linked like others
    but are never a component's id: it is null where a component has no other. Rows may repeat, in id or whole; other
    columns are ignored whatever their names. An empty table gives no rows.
    """
    flat, classes = _classes(docs, percent, width, id_col, text_col, group_size, group_bytes, buckets)
    worded = spread_join(flat.where("class is not null"), classes.select("class", "times", "low"), ["class"], "times", F.hash("id", "th"))
    out = worded.select("id", "n", F.col("low").alias("component_id"), "class").unionByName(flat.where("class is null").select("id", "n", F.col("id").alias("component_id"), "class"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "class")


def one_of_each(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text", group_size: int = GROUP, group_bytes: int = GROUP_BYTES, buckets: int | None = None) -> DataFrame:
    """docs with one row of each connected group, that of the smallest id; null ids come last, of equal ids a hash of
    the text decides. Rows without words stay, all of them. Columns stay as they are; otherwise as ngram_components."""
    first = _classes(docs, percent, width, id_col, text_col, group_size, group_bytes, buckets)[1].select(F.col("first.id").alias("_id"), F.col("first.th").alias("_th")).distinct()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(worded).withColumns({"_id": F.col(f"`{id_col}`").cast("long"), "_th": F.xxhash64(text)})
    # Null ids get a number to join on; what is null is part of the key as well.
    key = lambda df: df.withColumns({"_null": F.col("_id").isNull(), "_id": F.coalesce("_id", F.lit(-1))})
    kept = key(keyed).join(key(first), ["_id", "_null", "_th"], "left_semi").dropDuplicates(["_id", "_null", "_th"])
    return kept.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(~worded))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return ngram_components(table(spark, sf_dir, "documents")).drop("class")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i : i + 4], ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(l) - 3, 2))) AS i) WHERE len(l) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM b JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(v) FROM r WHERE r.u = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
