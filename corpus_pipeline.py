"""A corpus pipeline. Each stage takes all that the stage before it kept; all but the last return the columns of
documents.

1. language ID: documents go whose text has no letters, or is in no language that was learned.
2. exact dedup: of equal texts, the document with the largest doc_id stays.
3. n-gram Jaccard join: of linked documents (at 0.8 of their five-word n-grams), the one with the smallest doc_id stays.
4. secret scans: secrets are replaced by their kind in brackets, n_chars is made to fit; every document stays.
5. best-fit packing: a row for each piece, with its sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, language_id, ngram_join, packing, secrets
from quire.llm.common import cleanup, mark, stored, table

#: Near duplicates of stages: five words and a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs, WORDS, PERCENT)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.default_path())


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", dedup_stage),
    ("n-gram Jaccard join", join_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]
#: SQL can't express language ID, the join's components and best fit; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        cleanup(spark, before, but=1)  # only the stage's own rows are read from here on
    return docs
