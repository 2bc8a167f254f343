"""A corpus pipeline of five operators: from documents to a mixture of clean, distinct ones.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as
Parquet and read again. All but the last return the columns of documents; the last says how often the mixture
holds each document that is left.

For every stage: an empty table stays empty; texts of any length are read whole; ids may be null or repeat and keep
their type; columns beside those of documents, whatever their names, are carried along by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, langid, mixing, secrets, simhash
from codeloom.llm.shared import discard, scratch, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, fitted to their own ``lang`` labels, doesn't reject. Null, empty and
    wordless texts are rejected; repeated rows all stay or all go; a null ``lang`` is filled in; without any label nothing stays."""
    return langid.accepted(docs, langid.fit(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near-duplicates. Null and blank texts, and rows with a
    null id, belong to no group and stay; of rows that repeat id and text one stays."""
    return simhash.without_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly benchmark go. Null and empty texts hold none; repeated rows
    are treated alike."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by the name of the rule that found them. Null and empty texts hold none; all rows stay."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, copies): the sources at their target weights. A null source is one of its own; null and empty texts
    are due as often as the rest of their source; repeated rows are counted each."""
    return mixing.mixture(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", distinct),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: Classifier training, SimHash and pivotal rounding have no SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table of documents. What a stage wrote on its way is removed when its result is
    written, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as kept:
            out = written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(out)
        discard(docs)
        docs = out
    return docs
