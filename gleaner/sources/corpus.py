"""Files of records: corpora, sidecars, labels, predictions and federation logs, all JSON lines; bad lines are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.session import written


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines)."""
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    raw = written(raw)  # the reader refuses a query of the bad lines alone
    return raw.filter("_bad is null").drop("_bad"), raw.filter("_bad is not null").select(F.col("_bad").alias("line"))


def corpus(spark: SparkSession, slop: str, ham: str) -> tuple[DataFrame, DataFrame]:
    """Both classes' records as one table, with is_slop."""
    (a, x), (b, y) = (json_lines(spark, p, schemas.RECORD) for p in (slop, ham))
    return a.withColumn("is_slop", F.lit(True)).unionByName(b.withColumn("is_slop", F.lit(False))), x.union(y)


def with_detector(records: DataFrame, detector: DataFrame) -> DataFrame:
    """records with detector_score, by repo#number."""
    d = detector.select(F.col("id").alias("_id"), F.col("probability").alias("detector_score"))
    key = F.concat_ws("#", "repo", F.col("number").cast("string"))
    return records.withColumn("_key", key).join(d, F.col("_key") == F.col("_id"), "left").drop("_key", "_id")


def replay_order(records: DataFrame) -> DataFrame:
    """records with arrival, their place in their repository by time (as text), for replays."""
    return records.withColumn("arrival", F.row_number().over(Window.partitionBy("repo").orderBy("created_at", "number")))


def backfill(old: DataFrame, new: DataFrame) -> DataFrame:
    """old commits (repo, number, pos, message, date) with dates of new ones: by message, else by position."""
    by = new.groupBy("repo", "number", "message").agg(F.min_by("date", "pos").alias("_by"))
    at = new.select("repo", "number", "pos", F.col("date").alias("_at")).dropDuplicates(["repo", "number", "pos"])
    j = old.join(by, ["repo", "number", "message"], "left").join(at, ["repo", "number", "pos"], "left")
    return j.withColumn("date", F.coalesce("date", "_by", "_at")).drop("_by", "_at")
