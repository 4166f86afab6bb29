"""Session helpers: tables in the shared folder, sizes, row helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a few numbers each; a side with more is never broadcast
BROADCAST_ROWS = 1_000_000
#: of rows that go to Python at once; Spark's own bounds are 10,000 rows and 64 MB
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; it goes when the driver ends.

    Only a session of one machine (master local) may name none and then gets a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/gleaner-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and it outlives executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def in_steps(df: DataFrame) -> DataFrame:
    """df, for mapInArrow over texts: its session makes Arrow batches of about BATCH_BYTES from now on, or less if it did so before.

    Each task holds several copies of a batch outside the heap (being filled, sent, read by Python, sent back).
    The setting is read when a plan runs, after the caller returned it, so it stays; it changes no rows.
    """
    spark = df.sparkSession
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def packed(df: DataFrame, *names: str) -> Column:
    """All columns of df (or those named) as one struct: names inside can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in names or df.columns])


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an undirected graph, root the least node of its component.

    Alternating large-star and small-star steps; each round is written to the
    shared folder, so a lost executor costs one round at most.  The number of
    rounds is logarithmic in the longest chain.  No node's neighbours are ever
    collected: both steps are a window minimum and a join-free projection.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    e = written(e)
    last = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .filter("u <> v")
            .distinct()
        )
        before, e = e, written(small)
        discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        last = now
