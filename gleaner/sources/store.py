"""The store: upserts, time-to-live reads, promotion of weights, the action log and federation logs, as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOSSIER_TTL_DAYS = 7


def append(df: DataFrame, path: str) -> None:
    """Every write is an append; readers keep the latest of each key, so a repeated task does no harm."""
    df.write.mode("append").parquet(path)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key: an upsert as it is read.  max_by combines before the shuffle, unlike a ranked window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def merge(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table at path with changes upserted, as a DataFrame; the changes are appended to it."""
    append(changes, path)
    return latest(spark.read.parquet(path), keys, order)


def fresh(dossiers: DataFrame, now: Column, days: int = DOSSIER_TTL_DAYS) -> DataFrame:
    """The cached rows that are young enough; pushed to the scan as a filter on fetched_at."""
    return dossiers.filter(F.col("fetched_at") > now - F.make_dt_interval(F.lit(days)))


def active_weights(versions: DataFrame) -> DataFrame:
    """The (one) version of weights that was promoted last."""
    return versions.agg(F.max_by(F.struct(*versions.columns), "version").alias("w")).select("w.*")


def feedback_examples(feedback: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Maintainers' feedback with the verdict it is about, in the order it came."""
    return feedback.join(verdicts, ["repo", "number"], "inner").orderBy("id")


def comment_upserts(comments: DataFrame) -> DataFrame:
    """Of the comments that carry one marker on one change request, the last."""
    return latest(comments, ["repo", "number", "marker"], "written")


def sink(path: str, keys: list[str], order: str):
    """foreachBatch function: appends a micro-batch once for each batch id and keeps one row for each key of the batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run
