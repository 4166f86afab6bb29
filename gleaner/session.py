"""Tables in the folder that all executors share, and rows over all cores."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder of spark.checkpoint.dir: its lineage ends there and it outlives executors."""
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:  # a session of one machine, as in tests
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/triage-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before dear expressions, if its files are too small to be read by as many tasks; rows stay what they are."""
    spark: SparkSession = df.sparkSession
    cores, conf = spark.sparkContext.defaultParallelism, spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    # a task for each row group at best; the usual one has 128 MB
    return df.repartition(cores) if size < cores * (128 << 20) else df
