"""The corpus pipeline: five stages, each an operator of geoloom.llm, each working on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes the output of each stage to the shared folder and reads it back for the next; what else a stage wrote, and the
output that it read, is removed then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bpe, language, lines, simhash, templates
from geoloom.llm.common import mark, materialize, restored, sweep, table

#: The least share of a document's words that must be labelled with its language.
LEAST_SHARE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and labels at least LEAST_SHARE of their words; null and letterless texts go."""
    judged = language.judged(docs, "text", language.train(docs))
    return restored(judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one exactly or within one edit; n_chars follows the text."""
    out, changed = lines.judged(docs), {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        old = F.col(f"row.c{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("n_gone") > 0, F.length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return restored(out, docs.columns, **changed)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the decoded text, of what is left."""
    return bpe.digests(docs, "doc_id", "text", bpe.vocabulary_path())


STAGES = [
    ("language", identify),
    ("lines", dedup_lines),
    ("near_copies", dedup_near),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
#: Trigram scores, fingerprints and BPE are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
