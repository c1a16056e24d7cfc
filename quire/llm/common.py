"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the shared contract: runs without ASCII white space. bytes.split() splits at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where everything runs on one machine (tests, a laptop) and spark.checkpoint.dir
    is unset, a local one is used; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "quire-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by files in the shared folder, which outlive any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a few numbers that are worth a file of their own.
FILE_ROWS = 1 << 18


def stored(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """df written as Parquet into a new place in the shared folder, and read again; and that place.

    rows: where it is known that there are no more than so many narrow rows, they are written by as few tasks as they
    need, instead of one small file for each of the exchange's partitions. Not for stages that have real work to do.
    """
    place = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    few = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    few.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), place


def kept(df: DataFrame, rows: int | None = None) -> DataFrame:
    """stored() without the place: for chains of many steps, as plans read from files don't grow from step to step."""
    return stored(df, rows)[0]


def removed(spark: SparkSession, place: str) -> None:
    """Deletes what stored() has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this share of the rows of a join is dealt out, so there are at most as many such keys as it
#: goes into 1: a bound on what is broadcast that holds for every input.
SHARE = 1 / 1000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], times: str, salt: Column, total: int | None = None) -> DataFrame:
    """left joined with right, which has a row for each key of `on` and in `times` how many rows of left have it. times
    stays out of the result. salt is a column of left that tells rows of a key apart.

    Keys with more than SHARE of all those rows are dealt out over tasks: their rows of right, a bounded number, are
    broadcast to mark left's rows, and then copied once for each part. right should be checkpointed: it is read several
    times. total is the sum of times, where that is known.
    """
    if total is None:
        total = right.agg(F.sum(times)).first()[0] or 0
    parts = F.ceil(F.col(times) / F.lit(max(1.0, total * SHARE))).cast("int")
    hot = right.where(parts > 1).select(*on, parts.alias("_parts"))
    dealt = left.withColumn("_s", F.pmod(salt, F.lit(1 << 20))).join(F.broadcast(hot), on, "left").withColumn("_s", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod("_s", F.col("_parts"))).cast("int"))
    copied = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(times)
    return dealt.drop("_parts").join(copied, [*on, "_s"]).drop("_s")


def texts(column: pa.Array) -> list[str]:
    """Python strings of a batch's column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_CLEAR: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called where an operator with a table of its own starts in a worker. Workers live on from stage to stage, so the
    tables that other operators have left there are let go."""
    for other, f in _CLEAR.items():
        if other != name:
            f()
    _CLEAR[name] = clear


def batches_by_bytes(rows: Iterator, weight, limit: int) -> Iterator[list]:
    """Lists of rows whose weights add up to about limit; a heavier row is alone."""
    held, total = [], 0
    for row in rows:
        w = weight(row)
        if held and total + w > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += w
    if held:
        yield held


#: Places where no match of the byte-level pretokenizer pattern can reach across: one space between a character that
#: isn't white space and an ASCII letter always begins a match of " ?\p{L}+", the match before it can't contain a
#: space, and the pattern looks behind nowhere.
SAFE_CUT = re.compile(r"(?<=\S)(?= [A-Za-z])")


def segments(text: str, chars: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about so many characters, cut where SAFE_CUT holds; without such a place it stays whole."""
    at = 0
    while len(text) - at > chars:
        cut = SAFE_CUT.search(text, at + chars)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows, as texts may be very long. (What Spark sends at once is bounded by its own limit in
    bytes, so no setting of the session has to change for that.)"""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
