"""Languages of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import lang, text


def evidence(pages: DataFrame, classify: lang.Classifier = lang.by_function_words, doc_col: str = "doc", content_col: str = "content", order_col: str = "page_number") -> DataFrame:
    """(doc, page, para, lang, weight) of paragraphs that tell a language: by script, weighing all their characters, or
    by a sure guess, weighing the characters of their prose."""
    block = F.posexplode(F.split(F.coalesce(F.col(content_col), F.lit("")), rf"\n{text.SPACE}*\n"))
    rows = pages.select(F.col(doc_col).alias("doc"), F.col(order_col).alias("page"), block.alias("para", "p")).withColumn("p", text.strip(F.col("p"))).where(F.length("p") >= 20)
    rows = rows.withColumns({"script": lang.script(F.col("p"), 10), "prose": lang.prose(F.col("p"))})
    if classify is lang.by_function_words:  # an expression, so one pass over the pages does
        best = F.when(F.col("script").isNull() & (F.length("prose") >= 50), classify(F.col("prose")))
        told = rows.withColumn("best", best).where("script is not null or best.prob >= 0.85")
        return told.select("doc", "page", "para", F.coalesce("script", "best.lang").alias("lang"), F.when(F.col("script").isNotNull(), F.length("p")).otherwise(F.length("prose")).alias("weight"))
    # The classifier sees rows without a script and with enough prose only.
    by_script = rows.where("script is not null").select("doc", "page", "para", F.col("script").alias("lang"), F.length("p").alias("weight"))
    guessed = rows.where("script is null").where(F.length("prose") >= 50).withColumn("best", classify(F.col("prose")))
    return by_script.unionByName(guessed.where("best.prob >= 0.85").select("doc", "page", "para", F.col("best.lang").alias("lang"), F.length("prose").alias("weight")))


def summary(breakdown: Column, multilingual: Column) -> Column:
    """The text shown for a breakdown array<struct<lang, pct>>."""
    name = lambda x: F.concat(lang.language_name(x["lang"]), F.lit(" ("), x["lang"], F.lit(")"))
    share = lambda x: F.concat(name(x), F.lit(" — "), F.format_string("%.0f%%", F.bround(x["pct"], 0)))
    return F.when(~multilingual | (breakdown[0]["pct"] >= 90.0), name(breakdown[0])).otherwise(F.array_join(F.transform(breakdown, share), ", "))


def analyze(documents: DataFrame, found: DataFrame, default: str = "en", least_share: float = 0.08) -> DataFrame:
    """(doc, primary_language, detected_languages, breakdown, is_multilingual, summary_display) for each doc of
    documents, from evidence(). Shares below least_share go, the rest is brought to 100 again."""
    per = found.groupBy("doc", "lang").agg(F.sum("weight").alias("weight"), F.min(F.struct("page", "para")).alias("first"))
    whole = Window.partitionBy("doc")
    shared = per.withColumn("pct", F.col("weight") / F.sum("weight").over(whole) * 100.0).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("pct"), "first")))
    kept = shared.withColumn("most", F.max("pct").over(whole)).where((F.col("pct") >= least_share * 100.0) | ((F.col("most") < least_share * 100.0) & (F.col("rank") == 1)))
    final = kept.withColumn("pct", F.round(F.col("pct") / F.sum("pct").over(whole) * 100.0, 1))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("pct")).alias("down"), "first", "lang", "pct")))
    lists = final.groupBy("doc").agg(F.transform(ordered, lambda x: F.struct(x["lang"].alias("lang"), x["pct"].alias("pct"))).alias("breakdown"))
    out = documents.select("doc").distinct().join(lists, "doc", "left")
    out = out.withColumn("breakdown", F.coalesce("breakdown", F.array(F.struct(F.lit(default).alias("lang"), F.lit(100.0).alias("pct")))))
    many = F.size("breakdown") > 1
    return out.select("doc", F.col("breakdown")[0]["lang"].alias("primary_language"), F.transform("breakdown", lambda x: x["lang"]).alias("detected_languages"), "breakdown", many.alias("is_multilingual"), summary(F.col("breakdown"), many).alias("summary_display"))
