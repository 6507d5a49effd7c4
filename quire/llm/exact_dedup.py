"""Exact duplicates by skew-safe combining (DataFrame functions only).

1. Locally: the map side of the first aggregation merges equal texts of a partition.
2. Salted: rows meet by (digest, salt, text), so a group of copies is split into `salts` parts.
3. Globally: the salt winners, at most `salts` a text, meet by (digest, text).

The whole text is a grouping key at each stage, so a digest never decides on its own. Documents then look
up their class by (digest, salt); digests that stand for several texts, if any, by (digest, salt, text).

Defined cases: a null text counts as empty; equal texts need no change to be identical; of equal texts the row
with the largest doc_id stays (a null doc_id is smaller than any); rows that repeat the kept doc_id are all
kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import release, salt_of, salts_in, stored, table

SALTS = 48


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def duplicates(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumns({"digest": digest(F.col("text")), "salt": salt_of("doc_id", salts=salts)})
    salted = base.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    combined = salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )
    winners = stored(combined.select("digest", "keep_id", "group_size", "salts", sha256(F.col("text")).alias("sha")), "dedup-winners")
    clashes = stored(winners.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-clashes")
    lookup = winners.join(clashes, "digest", "left_anti").select("digest", "keep_id", "group_size", "sha", salts_in(F.col("salts"), salts).alias("salt"))
    found = base.drop("text").join(lookup, ["digest", "salt"])
    if not clashes.isEmpty():  # several texts share a digest: only their rows are looked up by text
        texts = combined.join(clashes, "digest", "left_semi")
        by_text = texts.select("digest", "text", "keep_id", "group_size", sha256(F.col("text")).alias("sha"), salts_in(F.col("salts"), salts).alias("salt"))
        found = found.unionByName(base.join(by_text, ["digest", "salt", "text"]).drop("text"))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def kept_documents(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs, with all their columns, that stay; of rows that repeat a doc_id and text, one."""
    keep = duplicates(docs, salts).where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_key")).distinct()
    release(docs.sparkSession)  # the texts' first two shuffles are done with
    keyed = docs.withColumn("_sha", sha256(F.coalesce(F.col("text"), F.lit(""))))
    found = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_key")))
    copy = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_id"))
    return found.withColumn("_copy", copy).where("_copy = 1").select(*[F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
