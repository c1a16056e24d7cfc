"""Mixing sources to target weights.

Every row gets a random key from a hash of its id and text; rows alike in all of that are one entry with a number. Entries
are dealt into ranges of that key within their source, sums per range give each range its offset in the source (a table
of sources times ranges, never the rows), and a running sum inside each range gives every row its place among its
source's tokens. A source's budget is then cut at its place: whole epochs of the source first, then the rows before the
cut once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

#: Ranges of the hash key within a source, a power of 16: a source of 10 billion rows has 2.4 million in each.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Adds weight and target to a table (source, source_size) with a row for each source.

    Sources in order of code points, null last, weigh as weights say, in turn. Targets share the total by weight, none
    above cap times its source's size; the excess goes to the others by weight until none is above. Sources are filled
    in order of size by weight, so those at their cap come first, and the level of the others follows from two sums.
    The table, a row of four numbers for each source, is in one task: a million sources are some 50 MB there.
    """
    size, one = F.col("source_size").cast("decimal(38,0)"), Window.partitionBy(F.lit(1))
    place = F.row_number().over(one.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    order = one.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "*",
        F.row_number().over(order).alias("_n"),
        (F.sum(size).over(one) - F.coalesce(F.sum(size * cap).over(before), F.lit(0))).cast("decimal(38,0)").alias("_rest"),
        (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
    )
    free = F.col("source_size").cast("decimal(25,0)") * cap * F.col("_weights").cast("decimal(12,0)") >= F.col("_rest").cast("decimal(25,0)") * F.col("weight").cast("decimal(12,0)")
    first = F.min(F.when(free, F.struct("_n", "_rest", "_weights"))).over(one)
    out = level.withColumn("_first", first)
    share = (F.col("_first._rest").cast("decimal(25,0)") * F.col("weight").cast("decimal(12,0)")).cast("double") / F.col("_first._weights").cast("double")
    return out.select(*sizes.columns, "weight", F.when(F.col("_n") >= F.col("_first._n"), share).otherwise((F.col("source_size") * cap).cast("double")).alias("target"))


_BLOCK = ["id", "source", "key"]
#: Rows alike that one step of listing them makes.
STEP = 1 << 16


def _keyed(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.md5(F.coalesce(docs[text_col], F.lit("")))
    return [docs[id_col].alias("id"), docs[source_col].alias("source"), F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(docs[id_col].cast("string"), F.lit("")), text)).alias("key")]


def _entries(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: str, size: Column | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """An entry for each set of `alike` rows: its place among its source's tokens, whole epochs, and what is left of the
    source's target after them."""
    words = word_count(docs[text_col]) if size is None else size.cast("long")
    measured = docs.select(*_keyed(docs, seed, id_col, text_col, source_col), words.alias("size")).groupBy(*_BLOCK, "size").agg(F.count("*").alias("alike"))
    # Null sources get a key of their own, so that all joins and windows share one partitioning.
    of = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    rows = checkpointed(measured.select("*", (F.col("size") * F.col("alike")).alias("all"), of.alias("of"), F.substring("key", 1, RANGE_DIGITS).alias("range")))
    ranges = rows.groupBy("of", "range").agg(F.sum("all").alias("in_range"))
    sizes = rows.groupBy("of").agg(F.sum("all").alias("source_size")).select(F.when(F.col("of") != "-", F.substring("of", 2, 1 << 30)).alias("source"), "of", "source_size")
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("of", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("offset")).join(targets(sizes, weights, cap).drop("source", "weight"), "of")
    inside = Window.partitionBy("of", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("all").over(inside)).join(offsets, ["of", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    return placed.withColumn("epochs", epochs).withColumns({"rest": rest, "place": F.col("offset") + F.col("upto") - F.col("all")})


def _copies(place: Column, cap: int) -> Column:
    """How often the row at this place is taken."""
    again = (F.col("source_size") > 0) & ((2 * place + F.col("size")).cast("double") <= 2 * F.col("rest"))
    return F.least(F.col("epochs") + again.cast("long"), F.lit(cap).cast("long"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", size: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row: how often the mix takes it.

    size: tokens of a row, by default its words. Each source is taken in whole epochs, then rows in order of their hash
    key as long as that brings the source nearer to its target; no row is taken more than cap times, whatever its size.
    Null texts have size 0; null sources are one source, the last; rows of equal id and source with other texts are rows
    of their own, and rows alike in all of that stand side by side, so the cut can fall between them; reruns agree;
    other columns are ignored whatever their names. An empty table gives no rows, and where all sizes are 0 targets are
    0 and nothing is taken.
    """
    entries = _entries(docs, weights, cap, seed, size, id_col, text_col, source_col)
    steps = F.sequence(F.lit(0).cast("long"), (F.col("alike") - 1) - (F.col("alike") - 1) % STEP, F.lit(STEP).cast("long"))
    rows = entries.withColumn("at", F.explode(steps)).withColumn("at", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + STEP, F.col("alike")) - 1)))
    out = rows.withColumn("copies", _copies(F.col("place") + F.col("at") * F.col("size"), cap))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", size: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of docs as the mix takes them, repeated for repeated epochs. Options and cases as for mix(); of rows alike
    in id, source and text some can be taken once more than the others, those whose hash over all columns is smallest."""
    entries = _entries(docs, weights, cap, seed, size, id_col, text_col, source_col)
    first, last = _copies(F.col("place"), cap), _copies(F.col("place") + (F.col("alike") - 1) * F.col("size"), cap)
    found = entries.select(*[F.col(c).alias(f"_{c}") for c in _BLOCK], "place", "size", "source_size", "epochs", "rest", first.alias("first"), last.alias("last"))
    found = found.where("first > 0").select(*[f"_{c}" for c in _BLOCK], F.struct("place", "size", "source_size", "epochs", "rest", "first", "last").alias("_f"))
    names, hashed = docs.columns, F.xxhash64(*[docs[c] for c in docs.columns])
    keyed = docs.select(*[docs[c] for c in names], *[c.alias(f"_own_{n}") for n, c in zip(_BLOCK, _keyed(docs, seed, id_col, text_col, source_col), strict=True)], hashed.alias("_hash"))
    same = (keyed["_own_key"] == found["_key"]) & keyed["_own_id"].eqNullSafe(found["_id"]) & keyed["_own_source"].eqNullSafe(found["_source"])
    joined = keyed.join(found, same)
    at = F.row_number().over(Window.partitionBy("_key", "_id", "_source").orderBy("_hash")) - 1
    f = F.col("_f")
    again = (f["source_size"] > 0) & ((2 * (f["place"] + F.col("_at") * f["size"]) + f["size"]).cast("double") <= 2 * f["rest"])
    times = F.when(f["first"] == f["last"], f["first"]).otherwise(F.least(f["epochs"] + again.cast("long"), F.lit(cap).cast("long")))
    taken = joined.withColumn("_at", at).withColumn("_times", times).where("_times > 0")
    return taken.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_epoch")).drop("_epoch")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS total, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER o AS n,
         sum(total) OVER () - coalesce(sum(3 * total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM s WINDOW o AS (ORDER BY total::DOUBLE / w, source IS NULL, source)),
f AS (SELECT n, rest, ws FROM l WHERE 3 * total * ws >= rest * w ORDER BY n LIMIT 1),
t AS (
  SELECT l.source, l.total,
         CASE WHEN l.n >= f.n THEN (f.rest * l.w)::DOUBLE / f.ws::DOUBLE ELSE (3 * l.total)::DOUBLE END AS target
  FROM l, f),
p AS (
  SELECT d.doc_id, d.source, d.size, t.total, t.target,
         CASE WHEN t.total > 0 THEN floor(t.target / t.total)::BIGINT ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, least(3, epochs + CASE WHEN total > 0 AND (2 * place + size)::DOUBLE <= 2 * (target - epochs * total) THEN 1 ELSE 0 END) AS copies
  FROM p)
SELECT doc_id, size, total AS source_size, target, (size * copies)::BIGINT AS taken, source, copies::BIGINT AS copies FROM c
"""
