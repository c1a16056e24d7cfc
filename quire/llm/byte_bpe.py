"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a word's bytes there is one token that can be last in the prefix's encoding: a token that ends
there, encodes to itself, and forms a valid pair with the last token of the prefix before it. A pair is valid if
merging its joined bytes gives the pair back. So a word's encoding is found in one pass that stores the last token of
every prefix; a word can be added to at its end exactly, and after an edit the prefixes before it stay as they are.
(Method: published linear-time BPE by "last token of a prefix" tables.)
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches_by_bytes, claim, raw, segments, sha256, slices, texts

#: Words whose ids are remembered in one worker, and their longest; about 100 MB.
KEPT, KEPT_CHARS = 500_000, 48
#: Characters encoded at once.
BATCH = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """An encoder for one table of ranks. pattern: what is encoded separately are its matches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        #: Tokens that merging their bytes gives back; others are only ever whole words.
        self.whole = {b: i for b, i in ranks.items() if len(b) == 1 or self.merged(b) == [b]}
        #: All ends of these tokens: the token, or -1 where an end is none itself.
        self.ends = {b[k:]: -1 for b in self.whole for k in range(1, len(b))} | self.whole

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """Parts after repeated merging of the lowest-ranked neighbours, leftmost first: the definition, for short
        data. It stops at so many parts."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > until:
            best, at = min((get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's left (0) or right (1) end while it is merged, each with the rank of the merge
        that takes it in."""
        key = (token, side)
        found = self._edges.get(key)
        if found is None:
            found, now = [], self.token[token]
            parts = [now]
            while len(now) > 1:
                taken = self.ranks[now]
                parts = self.merged(now, 2)
                now = parts[-side]
                found.append((now, taken))
            found = self._edges[key] = [*found[::-1], (self.token[token], 1 << 60)]
        return found

    def valid(self, left: int, right: int) -> bool:
        """Whether right can follow left in an encoding: whether no merge crosses their border while both are merged.
        Ends are taken in by order of rank, and of equal ranks the merge further left comes first."""
        a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        get, found = self.ranks.get, True
        while True:
            (x, taken_x), (y, taken_y) = a[i], b[j]
            across = get(x + y, 1 << 60)
            if taken_x <= across and taken_x <= taken_y and i + 1 < len(a):
                i += 1
            elif across <= taken_y and across < 1 << 60:
                found = False
                break
            elif j + 1 < len(b):
                j += 1
            elif i + 1 < len(a):
                i += 1
            else:
                break
        if len(self._pairs) > 500_000:
            self._pairs.clear()
        self._pairs[left, right] = found
        return found

    def extend(self, data: bytes, last: list[int], start: int) -> list[int]:
        """Fills last[i], the last token of data's prefix of i + 1 bytes, from i = start on; those before hold."""
        del last[start:]
        ends, pairs, valid = self.ends.get, self._pairs.get, self.valid
        for i in range(start + 1, len(data) + 1):
            # Tokens that end here, found backwards as long as any token ends with these bytes; the longest is tried first.
            found = []
            for j in range(i - 1, -1, -1):
                t = ends(data[j:i])
                if t is None:
                    break
                if t >= 0:
                    found.append((j, t))
            while found:
                j, t = found.pop()
                if j:
                    p = last[j - 1]
                    ok = pairs((p, t))
                    if not (valid(p, t) if ok is None else ok):
                        continue
                last.append(t)
                break
            else:
                raise ValueError(f"no token for byte {data[i - 1]}")
        return last

    def path(self, last: list[int]) -> list[int]:
        """The ids of the longest prefix in last."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.token[last[i - 1]])
        return out[::-1]

    def word(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern. A word that is a token as a whole is that token, however it merges."""
        t = self.ranks.get(data)
        return [t] if t is not None else self.path(self.extend(data, [], 0))

    def encode(self, text: str) -> list[int]:
        return [i for part in segments(text) for w in self.pattern.findall(part) for i in self.word(raw(w))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Editable:
    """The encoding of one word that grows at its end or is edited, kept as its table of last tokens.

    append() and edit() leave exactly what encoding the new bytes anew would give.
    """

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytes(data), []
        bpe.extend(self.data, self.last, 0)

    def append(self, more: bytes) -> Editable:
        start, self.data = len(self.data), self.data + more
        self.bpe.extend(self.data, self.last, start)
        return self

    def edit(self, start: int, end: int, new: bytes) -> Editable:
        """Replaces bytes start to end. Prefixes up to start hold; the pass runs from there on."""
        self.data = self.data[:start] + new + self.data[end:]
        self.bpe.extend(self.data, self.last, start)
        return self

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return self.bpe.path(self.last) if whole is None else [whole]


class Remembered:
    """Encodes texts through a bounded table of words. New words are taken in order of their bytes, so that each
    starts from the last tokens of the prefixes it shares with the one before."""

    def __init__(self, bpe: Bpe, kept: int = KEPT):
        self.bpe, self.kept, self.ids = bpe, kept, {}
        top = max(bpe.token) + 1
        #: By id: the token's bytes, and the id in decimal form.
        self.bytes = [bpe.token.get(i, b"") for i in range(top)]
        self.decimal = [str(i) for i in range(top)]

    def learn(self, words: set[str]) -> None:
        before, last = b"", []
        for data, w in sorted((raw(w), w) for w in words):
            found = self.bpe.ranks.get(data)
            if found is None:
                n = 0
                for x, y in zip(before, data, strict=False):
                    if x != y:
                        break
                    n += 1
                found = self.bpe.path(self.bpe.extend(data, last, n))
                before = data
            else:
                found = [found]
            self.ids[w] = tuple(found)

    def encode(self, batch: list[str]) -> Iterator[list[int]]:
        """For each text its ids."""
        cut = [[w for part in segments(t) for w in self.bpe.pattern.findall(part)] for t in batch]
        new = set(chain.from_iterable(cut)).difference(self.ids)
        self.learn(new)
        for words in cut:
            yield list(chain.from_iterable(map(self.ids.__getitem__, words)))
        # The words that came first stay: the frequent ones are among them.
        over = len(self.ids) - self.kept
        for w in new:
            if len(w) > KEPT_CHARS or over > 0:
                del self.ids[w]
                over -= 1


_ENCODERS: dict[tuple[str, str], Remembered] = {}


def encoder(path: str, pattern: str) -> Remembered:
    """This worker's encoder."""
    claim("byte_bpe", _ENCODERS.clear)
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Remembered(Bpe(read_ranks(path), pattern))
    return _ENCODERS[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for each row: the text's ids by the .tiktoken ranks at path.

    Null and empty texts have no ids; null ids and repeated rows are kept as they come; other columns are ignored
    whatever their names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in slices(batches):
            ids = [x for part in batches_by_bytes(iter(texts(batch.column(1))), len, BATCH) for x in enc.encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["id", "n_tokens", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) for each row of ids; null ids are empty, an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(path, ".").bpe.token
        for batch in slices(batches):
            data = [b"".join(map(token.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "bytes"])

    rows = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes its ids in one pass, keeping digests
    only. Rows as in bpe_encode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in slices(batches):
            n, a, b = [], [], []
            for part in batches_by_bytes(iter(texts(batch.column(1))), len, BATCH):
                for ids in enc.encode(part):
                    n.append(len(ids))
                    a.append(sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()))
                    b.append(sha256(b"".join(map(enc.bytes.__getitem__, ids))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from .common import table

    return bpe_round_trip(table(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
