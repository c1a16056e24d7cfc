"""Token counts without token ids.

Texts go through the tokenizers library inside Arrow functions that return lengths only. Texts are cut at safe
boundaries into pieces that the library encodes alike alone or in context, so a long text never becomes one long
call, and the pieces not seen before are sent to the library in batches balanced by bytes. Lengths of pieces seen are
kept in a bounded table for as long as the worker lives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SAFE_CUT, batches_by_bytes, claim, raw, slices, texts

#: Bytes in one call to the library, and of the texts whose pieces are looked up together.
CALL_BYTES, BATCH_BYTES = 1 << 18, 4 << 20
#: Pieces whose length is remembered in one worker; about 100 MB at most, as longer pieces aren't kept.
KEPT, KEPT_CHARS = 800_000, 64


class Lengths:
    """Lengths in tokens by one tokenizer file."""

    def __init__(self, path: str, call_bytes: int = CALL_BYTES, kept: int = KEPT):
        import os

        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.call_bytes, self.kept, self.seen = call_bytes, kept, {}

    def encoded(self, pieces: list[str]) -> list[int]:
        out = []
        for call in batches_by_bytes(iter(pieces), lambda p: len(raw(p)), self.call_bytes):
            out += [len(e) for e in self.tokenizer.encode_batch_fast(call, add_special_tokens=False)]
        return out

    def count(self, batch: list[str]) -> list[int]:
        seen = self.seen
        cut = [SAFE_CUT.split(t) for t in batch]
        new = list(set(chain.from_iterable(cut)).difference(seen))
        found = dict(zip(new, self.encoded(new), strict=True))
        seen.update(found)
        get = seen.__getitem__
        out = [sum(map(get, pieces)) for pieces in cut]
        # The pieces that came first stay: the frequent ones are among them.
        spare = len(seen) - self.kept
        for p in new:
            if len(p) > KEPT_CHARS or spare > 0:
                del seen[p]
                spare -= 1
        return out


_LENGTHS: dict[str, Lengths] = {}


def _lengths(path: str) -> Lengths:
    claim("token_counts", _LENGTHS.clear)
    if path not in _LENGTHS:
        _LENGTHS[path] = Lengths(path)
    return _LENGTHS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, by the tokenizers file at path.

    Without begin, end or added special tokens, truncation or padding; special strings inside a text are read as the
    library's default has it. Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows are kept as
    they come; other columns are ignored whatever their names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path)
        for batch in slices(batches):
            t = texts(batch.column(1))
            size = [len(raw(x)) for x in t]
            n = []
            for part in batches_by_bytes(zip(t, size, strict=True), lambda x: x[1], BATCH_BYTES):
                n += lengths.count([x for x, _ in part])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
