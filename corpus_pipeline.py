"""A training corpus from the table of documents: five stages, each of which works on all that the one before kept.

1. quality: documents that the classifier, trained on the labels, rejects go.
2. near_duplicates: one document of each group of similar texts stays.
3. secrets: found secrets are masked in the texts.
4. mixing: documents are taken as often as their source's target weight says.
5. byte_bpe: texts become token ids.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Nulls in any column, empty and very long texts and repeated rows are treated as the operators' docstrings say. An empty
table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.byte_bpe import bpe_encode
from quire.llm.common import removed, stored, table
from quire.llm.mixing import mixed_documents
from quire.llm.ngram_join import one_of_each
from quire.llm.quality import META, accepted, train
from quire.llm.secrets import default_forest, redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels"), meta=META), META)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of a similarity of 0.75 or more connect."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are masked, and n_chars is that of the new text."""
    out = redact(docs, default_forest())
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or one to three times."""
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: No SQL: a trained classifier and a similarity join are among the stages. tests/llm/test_pipeline.py has a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read again; it is deleted once
    the next stage's result is written, so at the end one stage's is left, which the result is read from."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, place = stored(stage(spark, docs, sf_dir))
        if before is not None:
            removed(spark, before)
        before = place
    return STAGES[-1][1](spark, docs, sf_dir)
