"""Removal of repeated passages by longest previous factors in suffix order.

A byte goes if a string of min_len bytes that covers it starts at another position too: if the longest factor that the
suffix at that string's start shares with a previous (or next) suffix has min_len bytes or more. The suffix order of all
documents isn't needed at once, only the parts of it where such factors can be:

1. Anchors. Of the k-grams inside every min_len-byte window the one with the smallest hash is the window's anchor
   (winnowing), so equal windows have equal anchors at equal places. Anchors are counted over all documents with
   pre-aggregation; windows whose anchor occurs once share no long factor with any other and go no further.
2. Suffixes. The bytes of the windows around each anchor that occurs again are dealt out by the anchor's hash, so all
   suffixes that can share a long factor meet. Stretches of equal bytes are one entry with all its places; the suffixes
   that start in different stretches are put in order of their first min_len bytes by prefix doubling, ties by position.
   Among suffixes that share min_len bytes the previous smaller position is then the neighbour before, and the next
   larger one the neighbour after; beyond them factors are shorter than min_len. All comparisons are of bytes.
3. Documents get their repeated runs back and drop them.

Nothing grows with a hot key: rows of equal text are one entry from the start; a run of windows with one anchor (a text
of one byte, say) is one stretch, cut into pieces; an anchor with more bytes than a task should have is dealt out by
document and place, and whatever meets in one task is ordered in units of bounded size. Units of one anchor meet through
one suffix for each class of equal windows, by a 128-bit cryptographic digest of its bytes (BLAKE2).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, claim, raw, sha256, slices, spread_join, texts

U = np.uint64
#: Length of the k-grams that anchors are chosen from.
GRAM = 32
#: Bytes of a text handled at once, and the bits of a place inside them.
BLOCK, BITS = 1 << 18, U(19)
#: Windows of one stretch.
PIECE = 4096
#: Bytes put in order at once: about so many, and at most, where one anchor has more. Half the latter is dealt to a part.
UNIT, MOST = 1 << 20, 4 << 20
_P = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    """Powers of the anchors' polynomial, and of its inverse."""
    claim("suffix_dedup", _tables.clear)
    if not _tables:
        _tables.extend(_powers(p, BLOCK + 4096) for p in (_P, pow(_P, -1, 1 << 64)))
    return _tables


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes, by differences of one running sum."""
    up, down = tables()
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, from running minima inside blocks of w from both sides."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, U(2**64 - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: bytes, min_len: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, count, several) of stretches of windows with one anchor hash: the first window, how many follow it
    (PIECE at most), and whether they have several anchors (the same k bytes at several places)."""
    found = []
    for at in range(0, len(data) - min_len + 1, BLOCK):
        part = np.frombuffer(data, np.uint8, min(BLOCK + min_len - 1, len(data) - at), at)
        h = grams(part, k)
        # The place below the hash makes the leftmost of equal k-grams the anchor.
        packed = (h >> BITS << BITS) | np.arange(len(h), dtype=U)
        least = window_min(packed, min_len - k + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[first] & ((U(1) << BITS) - U(1))).astype(np.int64)
        found.append((h[place].view(np.int64), first + at, np.diff(np.append(first, len(least)))))
    if not found:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
    h, first, count = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    if len(new) < len(h):
        several = np.diff(np.append(new, len(h))) > 1
        h, first, count = h[new], first[new], np.add.reduceat(count, new)
    else:
        several = np.zeros(len(h), bool)
    pieces = -(-count // PIECE)
    if pieces.max() > 1:
        row = np.repeat(np.arange(len(h)), pieces)
        ahead = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        h, first, count, several = h[row], first[row] + ahead, np.minimum(count[row] - ahead, PIECE), several[row]
    return h, first, count, several


# Suffix order


def _ranks(rank: np.ndarray, at: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders positions `at` by their rank and that of the position `ahead`, ties by place in `at`: (order, class)."""
    bits = int(rank.max()).bit_length()
    key = (rank[at] << bits) | rank[at + ahead]
    low = len(at).bit_length()
    if 2 * bits + low <= 63:
        packed = np.sort((key << low) | np.arange(len(at)))
        order, key = packed & ((1 << low) - 1), packed >> low
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))


def suffix_order(data: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): the suffixes at starts in order of their first limit bytes, all of which data has; ties in order
    of starts. Suffixes of one class share limit bytes.

    Prefix doubling: from the order by the first n bytes follows that by 2 n, at the positions where it will be needed.
    """
    if not len(starts):
        return starts, starts
    symbols, letters = np.unique(data, return_inverse=True)
    width = max(1, int(len(symbols) - 1).bit_length())
    steps = [min(limit, max(1, (63 - int(len(data)).bit_length()) // width))]
    while 2 * steps[-1] < limit:
        steps.append(2 * steps[-1])
    needed = [np.zeros(len(data) + 1, bool)]
    needed[0][starts] = True
    needed[0][starts + limit - steps[-1]] = True
    for n in reversed(steps[:-1]):
        needed.append(needed[-1].copy())
        needed[-1][n:] |= needed[-2][:-n]
    # What is needed near the end of data only because a neighbour is, is never compared.
    rank = np.zeros(len(data) + steps[-1] + 1, np.int64)
    letters = np.concatenate([letters.astype(np.int64), np.zeros(steps[0], np.int64)])
    at = np.flatnonzero(needed.pop()[: len(data)])
    key = np.zeros(len(at), np.int64)
    for j in range(steps[0]):
        key = (key << width) | letters[at + j]
    low = len(at).bit_length()
    packed = np.sort((key << low) | np.arange(len(at))) if width * steps[0] + low <= 63 else None
    order = np.argsort(key, kind="stable") if packed is None else packed & ((1 << low) - 1)
    key = key[order] if packed is None else packed >> low
    rank[at[order]] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
    for n in steps[:-1]:
        at = np.flatnonzero(needed.pop()[: len(data)])
        order, cls = _ranks(rank, at, n)
        rank = np.zeros_like(rank)
        rank[at[order]] = cls + 1
    return _ranks(rank, starts, limit - steps[-1])


def factors(data: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later): whether the longest factor that the suffix at each of starts shares with one at a smaller or a
    larger one of starts has limit bytes. starts are in order of position.

    Suffixes that share limit bytes are neighbours in suffix order. As ties are in order of position, the previous
    smaller position of a suffix is its neighbour before, if that is of its class; otherwise both its previous and its
    next smaller position are outside the class, and its longest previous factor is shorter."""
    order, cls = suffix_order(data, starts, limit)
    same = cls[1:] == cls[:-1]
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def runs(row: np.ndarray, place: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of neighbouring windows that are hit."""
    r, p = row[hit], place[hit]
    if not len(r):
        return r, p, p
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)])
    last = np.append(np.flatnonzero(new)[1:], len(r)) - 1
    return r[new], p[new], p[last]


def _counting(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 to n[i] - 1 for each i, one after the other, and i."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


# Spark

_KEY = ["k1", "k2"]
#: A span is one number: its start above these bits, its end in them.
SHIFT = 32
_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("span", pa.int64()), ("did", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _anchor_rows(own: DataFrame, min_len: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [anchors(raw(t), min_len, k) for t in texts(batch.column("text"))]
            n = np.array([len(f[0]) for f in found])
            h, first, count, several = (np.concatenate(c) for c in zip(*found, strict=True))
            keys = [np.repeat(batch.column(c).to_numpy(), n) for c in _KEY]
            count = count << 1 | several
            for at in range(0, len(h), 100_000):
                to = at + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(h[at:to]), *(pa.array(c[at:to]) for c in keys), pa.array(first[at:to], pa.int32()), pa.array(count[at:to], pa.int32())], ["h", *_KEY, "first", "n"])

    return own.select(*_KEY, "text").mapInArrow(run, "h long, k1 long, k2 long, first int, n int")


def _stretches(rows: DataFrame, min_len: int, part: int) -> DataFrame:
    """The bytes of the stretches listed in `at`, from rows (k1, k2, did, text, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            at = batch.column("at")
            for i, t in enumerate(texts(batch.column("text"))):
                data, own = raw(t), at[i].values
                h, first, n, weight = (own.field(c).to_numpy(zero_copy_only=False) for c in ("h", "first", "n", "weight"))
                k1, k2, did = (batch.column(c)[i].as_py() for c in (*_KEY, "did"))
                # Parts are chosen by text and place, so no anchor's bytes stay together beyond a part's size.
                salt = mixed(first.astype(U) ^ U(k1 & (2**64 - 1))) % np.maximum(1, -(-weight // part)).astype(U)
                for x in range(0, len(h), 2000):
                    y = min(x + 2000, len(h))
                    same = lambda v, kind, size=y - x: pa.array(np.full(size, v), kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[x:y]), pa.array(np.where(weight > 2 * part, salt.astype(np.int64), -1)[x:y], pa.int32()), same(k1, pa.int64()), same(k2, pa.int64()), same(did, pa.int64()), pa.array(first[x:y], pa.int32()), pa.array(n[x:y], pa.int32()),
                         pa.array([data[a : a + (c >> 1) + min_len - 1] for a, c in zip(first[x:y].tolist(), n[x:y].tolist(), strict=True)], pa.binary())],
                        ["h", "part", *_KEY, "did", "first", "n", "blob"],
                    )

    return rows.mapInArrow(run, "h long, part int, k1 long, k2 long, did long, first int, n int, blob binary")


def _ordered(t: pa.Table, shared: np.ndarray, min_len: int, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows in one unit of stretches. shared tells those whose anchor is in other units too: of
    their windows the first of each class is returned as well, with its digest."""
    rank = np.lexsort([t[c].to_numpy() for c in ("first", "k2", "k1", "did")])
    t, shared = t.take(rank), shared[rank]
    h, k1, k2, did, first, n = (t[c].to_numpy() for c in ("h", *_KEY, "did", "first", "n"))
    several, n = (n & 1).astype(bool), (n >> 1).astype(np.int64)
    first = first.astype(np.int64)
    # Equal stretches are one, with the place of the first.
    blobs, distinct = t["blob"].to_pylist(), {}
    which = np.fromiter((distinct.setdefault(b, len(distinct)) for b in blobs), np.int64, len(blobs))
    one = np.unique(which, return_index=True)[1]
    times = np.bincount(which)
    blobs, size = [blobs[i] for i in one.tolist()], n[one]
    # Only suffixes of anchors with several different stretches, or that occur several times in one, need an order.
    _, group, alike = np.unique(h[one], return_inverse=True, return_counts=True)
    some = np.flatnonzero((alike[group] > 1) | several[one])
    row, place = _counting(size)
    earlier, later = np.zeros(len(row), bool), np.zeros(len(row), bool)
    if len(some):
        data = np.frombuffer(b"".join([blobs[i] for i in some.tolist()]), np.uint8)
        length = size[some] + min_len - 1
        mine, inside = _counting(size[some])
        at = np.isin(row, some)
        earlier[at], later[at] = factors(data, (np.cumsum(length) - length)[mine] + inside, min_len)
    hit = earlier if first_stays else earlier | later | (times > 1)[row]
    r, x, y = runs(row, place, hit)
    # Each stretch has the runs of its bytes; where the first stays, every other one is repeated whole.
    whole = np.ones(len(which), bool) if first_stays else np.zeros(len(which), bool)
    whole[one] = False
    own = np.flatnonzero(~whole)
    begin, end = np.searchsorted(r, which[own]), np.searchsorted(r, which[own], "right")
    i, j = _counting(end - begin)
    j += begin[i]
    rows = np.concatenate([own[i], np.flatnonzero(whole)])
    low, high = np.concatenate([x[j], np.zeros(whole.sum(), np.int64)]), np.concatenate([y[j], n[whole] - 1])
    for z in range(0, len(rows), 100_000):
        s = slice(z, z + 100_000)
        span = (first[rows[s]] + low[s]) << SHIFT | (first[rows[s]] + high[s] + min_len)
        nothing = pa.nulls(len(span), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(k1[rows[s]]), pa.array(k2[rows[s]]), pa.array(span), nothing, nothing, nothing], schema=_FOUND)
    left = np.flatnonzero(~earlier & shared[one][row])
    for z in range(0, len(left), 50_000):
        w = left[z : z + 50_000]
        source = one[row[w]]
        digest = np.frombuffer(b"".join([hashlib.blake2b(blobs[a][b : b + min_len], digest_size=16).digest() for a, b in zip(row[w].tolist(), place[w].tolist(), strict=True)]), np.int64).reshape(-1, 2)
        start = first[source] + place[w]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1[source], k2[source], start << SHIFT | (start + min_len), did[source], digest[:, 0], digest[:, 1])], schema=_FOUND)


def _units(batches: Iterator[pa.RecordBatch], unit: int, most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of anchor and part, in units, each with marks on the rows whose anchor is in several units. A unit
    ends with an anchor once it has `unit` bytes, or inside one once it has `most`."""
    held, size, last, cut = [], 0, None, False  # held: [rows, anchor and part, shared]

    def flush():
        t = pa.Table.from_batches([x[0] for x in held]).combine_chunks()
        return t, np.repeat([x[2] for x in held], [x[0].num_rows for x in held])

    for batch in slices(batches, 4096):
        h, part = (batch.column(c).to_numpy() for c in ("h", "part"))
        blob = batch.column("blob")
        ends = np.frombuffer(blob.buffers()[1], np.int32, batch.num_rows + 1, blob.offset * 4).astype(np.int64)
        cuts = np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = (h[a], part[a])
            if key != last:
                if size >= unit:
                    yield flush()
                    held, size = [], 0
                last, cut = key, False
            while a < b:
                c = max(a + 1, int(np.searchsorted(ends[: b + 1], ends[a] + most - size, "right")) - 1)
                held.append([batch.slice(a, c - a), key, cut or bool(part[a] >= 0)])
                size += int(ends[c] - ends[a])
                a = c
                if a < b or size >= most:
                    # The anchor may go on.
                    for x in held:
                        x[2] = x[2] or x[1] == key
                    yield flush()
                    held, size, cut = [], 0, True
    if held:
        yield flush()


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, text): k1 and k2 are the first 128 bits of the text's SHA-256, which texts are called by."""
    text = F.coalesce(docs[text_col], F.lit(""))
    part = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    return docs.select(docs[id_col].cast("long").alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text")).select("id", part(1).alias("k1"), part(17).alias("k2"), "text")


def _repeated(own: DataFrame, classes: DataFrame, min_len: int, keep: str, gram: int, unit: int, most: int) -> DataFrame:
    """(k1, k2, spans) of the texts with windows that repeat, also inside themselves; copies don't count here."""
    first_stays = keep == "first"
    found = _anchor_rows(own.where(F.octet_length("text") >= min_len), min_len, gram)
    windows = F.shiftright("n", 1)
    several = F.col("n").bitwiseAND(1) == 1
    often = checkpointed(found.groupBy("h").agg(F.count("*").alias("times"), F.sum(windows + F.lit(min_len - 1)).cast("long").alias("weight"), F.max(several).alias("several")).where("times > 1 or several").drop("several"))
    some = spread_join(found, often.select("h", "times", "weight"), ["h"], "times", F.hash(*_KEY, "first"))
    listed = some.groupBy(*_KEY).agg(F.collect_set(F.struct("h", "first", "n", "weight")).alias("at"))
    rows = own.select(*_KEY, "text").dropDuplicates(_KEY).join(listed, _KEY).join(classes.select(*_KEY, "did"), _KEY)
    dealt = _stretches(rows.select(*_KEY, "did", "text", "at"), min_len, most // 2).repartition("h", "part").sortWithinPartitions("h", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, shared in _units(batches, unit, most):
            yield from _ordered(t, shared, min_len, first_stays)

    got = checkpointed(dealt.mapInArrow(run, "k1 long, k2 long, span long, did long, a long, b long"))
    sure, met = got.where("a is null").select(*_KEY, "span"), got.where("a is not null")
    place = F.struct("did", *_KEY, "span")
    again = checkpointed(met.groupBy("a", "b").agg(F.count("*").alias("times"), F.min(place).alias("lowest")).where("times > 1"))
    more = spread_join(met, again, ["a", "b"], "times", F.hash("did", *_KEY, "span"))
    if first_stays:
        more = more.where(place != F.col("lowest"))
    return sure.unionByName(more.select(*_KEY, "span")).groupBy(*_KEY).agg(F.collect_list("span").alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, min_len: int = 200, keep: str = "none", digest: bool = False, gram: int = GRAM, unit: int = UNIT, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row: its text without repeated passages, as bytes, or with
    digest kept_sha256 in place of kept. n_spans counts the maximal removed runs.

    keep: "none" removes every occurrence, "first" all but the first, in order of id (null last), text and place; rows
    alike in id and text are one document then. Texts are UTF-8 bytes, null ones empty; matches don't cross texts; texts
    shorter than min_len stay whole. Rows of equal text repeat each other, rows of equal ids with other texts are
    documents of their own, null ids stay null; other columns are ignored whatever their names. An empty table gives no
    rows. unit and most bound the bytes that are put in order at once.
    """
    if not 1 <= gram <= min_len or min_len > 4000 or keep not in ("none", "first") or not 0 < unit <= most:
        raise ValueError("1 <= gram <= min_len <= 4000, keep is none or first, and 0 < unit <= most")
    own = _prepared(docs, id_col, text_col)
    # Null ids come last, as the largest number.
    did = F.coalesce("id", F.lit((1 << 63) - 1))
    classes = checkpointed(own.groupBy(*_KEY).agg(F.count("*").alias("times"), F.min(did).alias("did")))
    spans = _repeated(own, classes, min_len, keep, gram, unit, most)
    # Copies of a text are known by its class alone; only others, and first ones, have spans of their own.
    about = checkpointed(classes.join(spans, _KEY, "left"))
    copies = F.col("copies") > 1 if keep == "none" else did != F.col("did")
    joined = spread_join(own, about.withColumn("copies", F.col("times")), _KEY, "times", F.hash(did))
    rows = joined.select("id", F.octet_length("text").cast("long").alias("size"), copies.alias("copy"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t, copy, s in zip(texts(batch.column("text")), batch.column("copy").to_pylist(), batch.column("spans"), strict=True):
                data, gone = raw(t), []
                if copy and len(data) >= min_len:
                    gone = [(0, len(data))]
                elif s.is_valid:
                    gone = merged([(x >> SHIFT, x & ((1 << SHIFT) - 1)) for x in s.values.to_pylist()])
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else data
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), sha256(kept) if digest else kept))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string() if digest else pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.drop("size").mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.withColumnsRenamed({"id": id_col, "kept": "kept_sha256" if digest else "kept"})


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
