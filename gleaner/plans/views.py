"""The driver's tables as triage records; each view has its SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Documents as change requests: the source is the repository, the text is the body and the added lines."""
    t = F.coalesce("text", F.lit(""))
    return spread(table(spark, d, "documents")).select(
        "doc_id",
        F.col("source").alias("repo"),
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("author"),
        F.substring(t, 1, 60).alias("title"),
        t.alias("body"),
        F.col("n_chars").alias("additions"),
        F.lit(0).cast("long").alias("deletions"),
        F.lit(1).cast("long").alias("commit_count"),
        F.lit("NONE").alias("author_association"),
        F.concat_ws("/", "source", "lang").alias("head_ref"),
        F.concat(F.lit("+"), F.replace(t, F.lit("\n"), F.lit("\n+"))).alias("diff"),
        F.array(F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit(".md"))).alias("paths"),
        F.lit("# Summary\n# Testing").alias("template"),
    )


REQUESTS = """req AS (SELECT doc_id, source AS repo, source || '-' || doc_id AS author, substr(coalesce(text, ''), 1, 60) AS title, coalesce(text, '') AS body, n_chars AS additions,
  source || '/' || lang AS head_ref, '+' || replace(coalesce(text, ''), chr(10), chr(10) || '+') AS diff FROM documents)"""
