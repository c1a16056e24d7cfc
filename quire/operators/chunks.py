"""Assembly of units into chunks of a word budget, with overlap.

A document's pieces are gathered in order in one row. One fold over their word counts and flags finds where chunks begin
and end; it carries no text. Chunk texts are then cut from the same row, so assembly takes one shuffle, by document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lang, text
from quire.schemas import CHUNK_COLUMNS

from .units import pieces


@dataclass(frozen=True)
class Budget:
    """compat keeps a quirk: an overlap of 0 words repeats the whole last piece. Without it, 0 means no overlap."""

    # The default budget.
    min_words: int = 250
    target_words: int = 450
    max_words: int = 750
    overlap_words: int = 40
    compat: bool = True
    #: Words that a major heading needs before it to start a chunk, in deterministic assembly.
    heading_words: int = 200
    #: Whether units of more than max_words words are cut into sentences or runs of words.
    split_long: bool = True

    @property
    def orphan_words(self) -> int:
        return min(self.min_words // 2, 40)


_BOUND = "struct<start:int,end:int,over:int,over_words:int,verbatim:boolean,page:int,section:int,ocr:boolean,orphan:boolean>"
_STATE = f"struct<start:int,end:int,over:int,over_words:int,verbatim:boolean,words:int,page:int,section:int,ocr:boolean,out:array<{_BOUND}>>"
_FIELDS = ("start", "end", "over", "over_words", "verbatim", "words", "page", "section", "ocr", "out")


def _state(acc: Column, **new: Column) -> Column:
    return F.struct(*[new.get(k, acc[k]).alias(k) for k in _FIELDS]).cast(_STATE)


def _filled(acc: Column) -> Column:
    return (acc["start"] >= 0) | (acc["over"] >= 0)


def _closed(acc: Column, orphan: Column) -> Column:
    bound = F.struct(*[acc[k].alias(k) for k in ("start", "end", "over", "over_words", "verbatim", "page", "section", "ocr")], orphan.alias("orphan"))
    return F.array_append(acc["out"], bound.cast(_BOUND))


def _flushed(acc: Column, items: Column, budget: Budget, overlap: bool, verbatim: bool, **new: Column) -> Column:
    """The state after a chunk is closed, with the overlap that its last text leaves."""
    none, nothing = F.lit(-1), F.lit(0)
    out = F.when(_filled(acc), _closed(acc, F.lit(False))).otherwise(acc["out"])
    if not overlap or (budget.overlap_words == 0 and not budget.compat):
        return _state(acc, **{"start": none, "end": none, "over": none, "over_words": nothing, "verbatim": F.lit(False), "words": nothing, "out": out, **new})
    # The last text is the last item, or the overlap where nothing came after it.
    own = acc["end"] >= 0
    last = F.when(own, acc["end"]).otherwise(acc["over"])
    have = F.when(own, F.get(items, acc["end"])["words"]).otherwise(acc["over_words"])
    took = have if budget.overlap_words == 0 else F.least(have, F.lit(budget.overlap_words))
    whole = (have <= budget.overlap_words) & (own | acc["verbatim"]) if verbatim else F.lit(False)
    return _state(acc, **{"start": none, "end": none, "over": last, "over_words": took, "verbatim": whole, "words": took, "out": out, **new})


def boundaries(items: Column, budget: Budget, advised: bool) -> Column:
    """Bounds of chunks over items: array<struct<words, unit_words, first, oversize, major, brk, ocr, pos>>.

    Positions count items from 0, and -1 is none. A chunk holds items start to end, after the last over_words words of
    item over. page and section are the items that tell them.
    """
    b = budget

    def opened(s: Column, p: Column) -> Column:
        """What the first piece of a unit can do: raise the OCR flag, and break before the unit."""
        raised, here = s["ocr"] | p["ocr"], p["pos"]
        if advised:
            brk = (s["words"] >= b.min_words) & (p["brk"] | p["major"] | (s["words"] + p["unit_words"] > b.max_words)) & _filled(s)
        else:
            brk = p["major"] & (s["words"] >= b.heading_words)
        # The chunk before the break closes with the flag of the unit behind it.
        after = text.let(_state(s, ocr=raised), lambda x: _flushed(x, items, b, advised, advised, page=here, section=here))
        return F.when(~p["first"], s).when(brk, after).otherwise(_state(s, ocr=raised))

    def budgeted(s: Column, p: Column) -> Column:
        """A flush before a piece that would pass the target."""
        here, full = p["pos"], (s["words"] + p["words"] > b.target_words) & (s["words"] >= b.min_words)
        some = full & _filled(s)
        split = F.when(p["oversize"] & some, _flushed(s, items, b, True, False, page=here)).when(p["oversize"] & full, _state(s, page=here))
        if not advised:
            split = split.when(~p["oversize"] & some, _flushed(s, items, b, True, True, page=here, section=here))
        return split.otherwise(s)

    def added(s: Column, p: Column) -> Column:
        here, fresh = p["pos"], ~p["oversize"] & ~_filled(s)
        return _state(
            s, start=F.when(s["start"] < 0, here).otherwise(s["start"]), end=here, words=s["words"] + p["words"],
            page=F.when(fresh, here).otherwise(s["page"]), section=F.when(fresh, here).otherwise(s["section"]),
        )

    def finish(acc: Column) -> Column:
        orphan = (acc["words"] < b.orphan_words) & (F.size(acc["out"]) > 0)
        return F.when(_filled(acc), _closed(acc, orphan)).otherwise(acc["out"])

    none, zero = F.lit(-1), F.lit(0)
    start = F.struct(none, none, none, zero, F.lit(False), zero, zero, zero, F.lit(False), F.array()).cast(_STATE)
    step = lambda acc, p: text.let(text.let(opened(acc, p), lambda s: budgeted(s, p)), lambda s: added(s, p))
    return F.aggregate(items, start, step, finish)


def gathered(units: DataFrame, decisions: DataFrame | None, budget: Budget) -> DataFrame:
    """(doc, source_type, items): each document's pieces in order."""
    rows = pieces(units, budget.target_words, budget.max_words if budget.split_long else None)
    if decisions is None:
        rows = rows.withColumn("brk", F.lit(False))
    else:
        brk = decisions.select("doc", "unit_idx", (F.upper("decision") == "BREAK").alias("brk"))
        rows = rows.join(brk, ["doc", "unit_idx"], "left").withColumn("brk", F.coalesce("brk", F.lit(False)))
    one = F.struct("unit_idx", "parts", F.col("word_count").alias("unit_words"), "oversize", "major", "brk", F.col("ocr_applied").alias("ocr"), "page_number", "section", "source_type")
    per = rows.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("u"))
    flat = F.flatten(F.transform("u", lambda u: F.transform(u["parts"], lambda t, i: F.struct(
        t.alias("text"), F.when(u["oversize"], text.word_count(t)).otherwise(u["unit_words"]).alias("words"), u["unit_words"].alias("unit_words"), (i == 0).alias("first"), u["oversize"].alias("oversize"),
        u["major"].alias("major"), u["brk"].alias("brk"), u["ocr"].alias("ocr"), u["page_number"].alias("page"), u["section"].alias("section")))))
    return per.select("doc", F.col("u")[0]["source_type"].alias("source_type"), flat.alias("items"))


def assemble(units: DataFrame, budget: Budget = Budget(), decisions: DataFrame | None = None, strategy: str | Column | None = None, analysis: DataFrame | None = None, classify: lang.Classifier = lang.by_function_words) -> DataFrame:
    """Chunks of units, with the columns of schemas.CHUNK.

    Without decisions assembly is deterministic: chunks close when they would pass target_words, or at a major heading.
    With decisions (doc, unit_idx, decision) they close at BREAK, at a major heading, or before max_words, once they have
    min_words. A last chunk of very few words joins the one before. analysis: as languages.analyze() gives it; without it
    documents count as English and any language may be found.
    """
    advised = decisions is not None
    name = strategy if isinstance(strategy, Column) else F.lit(strategy or ("llama3.2_semantic" if advised else "deterministic"))
    light = lambda x, i: F.struct(x["words"].alias("words"), x["unit_words"].alias("unit_words"), x["first"].alias("first"), x["oversize"].alias("oversize"), x["major"].alias("major"), x["brk"].alias("brk"), x["ocr"].alias("ocr"), i.alias("pos"))
    rows = gathered(units, decisions, budget).withColumn("light", F.transform("items", light))
    rows = rows.withColumn("bounds", boundaries(F.col("light"), budget, advised)).withColumn("strategy", name)
    # Each chunk takes its own texts along, so the explode copies no document into each of its chunks.
    items = F.col("items")
    texts = lambda b: F.transform(F.slice(items, F.greatest(b["start"], F.lit(0)) + 1, F.when(b["start"] >= 0, b["end"] - b["start"] + 1).otherwise(0)), lambda x: x["text"])
    taken = F.transform("bounds", lambda b: F.struct(
        b["over"].alias("over"), b["over_words"].alias("over_words"), b["verbatim"].alias("verbatim"), b["ocr"].alias("ocr"), b["orphan"].alias("orphan"),
        texts(b).alias("own"), F.get(items, b["over"])["text"].alias("source"), F.get(items, b["page"])["page"].alias("page"), F.get(items, b["section"])["section"].alias("section")))
    at = rows.select("doc", "source_type", "strategy", F.posexplode_outer(taken).alias("chunk_index", "b"))

    own, source = F.col("b.own"), F.col("b.source")
    tail = F.when(F.col("b.verbatim"), source).otherwise(text.let(text.words(source), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - F.col("b.over_words"), F.lit(0)) + 1, F.greatest(F.col("b.over_words"), F.lit(0))), " ")))
    whole = F.array_join(F.when(F.col("b.over") >= 0, F.concat(F.array(tail), own)).otherwise(own), "\n\n")
    made = at.select(
        "doc", "source_type", "strategy", "chunk_index", F.col("b.orphan").alias("orphan"), F.col("b.ocr").alias("ocr_applied"),
        F.col("b.page").alias("page_number"), F.col("b.section").alias("section"),
        F.when(F.col("b.orphan"), text.without_block_markup(whole)).otherwise(text.without_markup(text.strip(whole))).alias("text"),
    )
    order = Window.partitionBy("doc").orderBy("chunk_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    joined = made.withColumns({
        "char_start": F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int"),
        "rest": F.lead(F.when(F.col("orphan"), F.col("text"))).over(order),
    }).where(~F.col("orphan"))
    if analysis is None:
        joined = joined.withColumns({"primary": F.lit("en"), "allowed": F.lit(None).cast("array<string>")})
    else:
        joined = joined.join(analysis.select("doc", F.col("primary_language").alias("primary"), F.col("detected_languages").alias("allowed")), "doc", "left").withColumn("primary", F.coalesce("primary", F.lit("en")))
    # The language is that of the text before an orphan joins it.
    joined = joined.withColumn("language", lang.chunk_language(F.col("text"), F.col("primary"), F.col("allowed"), classify))
    joined = joined.withColumn("text", F.when(F.col("rest").isNotNull(), F.concat("text", F.lit("\n\n"), "rest")).otherwise(F.col("text")))
    return joined.select(
        F.concat("doc", F.lit("_c"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("doc").alias("document_name"), "page_number", "section", "chunk_index", "text",
        text.word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"), "char_start", (F.col("char_start") + F.length("text")).alias("char_end"),
        "language", "source_type", "ocr_applied", F.struct(F.col("page_number").alias("page_start"), F.col("strategy").alias("chunking_strategy")).alias("metadata"),
    ).select(*CHUNK_COLUMNS)
