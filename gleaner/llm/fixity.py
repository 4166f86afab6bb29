"""Merkle fixity audit of replicated WARC records.

A record is hashed with its fields, each with its length before it and nulls with
a mark of their own, so no two different records are hashed as one.  The primary's
manifest gives each key its offset in the order of keys.  Ranges of RANGE_BYTES of
offsets are the lowest nodes of a tree, FAN of which are a node of the next level,
and so on up to one root; FAN^2 ranges are a file.  A node's hash covers its
children's hashes in order.  Two replicas are compared at the roots; only the
children of nodes that differ are looked at further, and at the end the records
that differ are named.

Only hashes are shuffled, never payloads.  Offsets are sums over range partitions,
so no window covers all keys or a key's records.  Equal records are one leaf with their
number.  A key with several records is one entry of the manifest; its records are
spread over its bytes by their hashes, in the order of hashes, so a key that has
a third of all records has ranges as small as others.

A replica's records whose key the manifest doesn't list are range -1, spread over its
children by hash.  A null key is a key of its own, before all others.  Null columns
hash as nulls, apart from empty ones.  A record that only the primary has is
'missing', one that only the replica has is 'extra' (file, offset and size null), and
as many of these as can be paired within a key are 'changed'.  Repeated rows that one
side has more often are named as often as they are lacking.  record_offset is that
of the record's key in its file.  Empty replicas make every record missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import small, written

RANGE_BYTES, FAN = 1 << 16, 16
FILE_BYTES = RANGE_BYTES * FAN * FAN
#: sub-ranges of the records that no manifest lists
STRAY = 4096


def _field(c: str) -> Column:
    v = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def records(pages: DataFrame) -> DataFrame:
    """(known, page_id, bytes, hash, n): the distinct records with their number; known is false for null keys."""
    d = pages.select(
        F.col("page_id").isNotNull().alias("known"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page_id"),
        (F.coalesce(F.octet_length("url"), F.lit(0)) + F.coalesce(F.octet_length("html"), F.lit(0)) + F.lit(32)).cast("long").alias("bytes"),
        F.sha2(F.concat(_field("page_id"), _field("url"), _field("html")), 256).alias("hash"),
    )
    return d.groupBy("known", "page_id", "hash").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"))


def _running(batches):
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column("bytes").to_numpy()
        within = np.cumsum(size) - size + total
        total += int(size.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(within)], [*batch.schema.names, "part", "within"])


def manifest(leaves: DataFrame) -> DataFrame:
    """(m_known, m_id, m_bytes, m_several, m_offset) of every key, in the order of keys."""
    keys = leaves.groupBy("known", "page_id").agg(F.sum(F.col("bytes") * F.col("n")).alias("bytes"), (F.count("*") > 1).alias("several"))
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = written(keys.repartitionByRange(parts, "known", "page_id").sortWithinPartitions("known", "page_id").mapInArrow(_running, "known boolean, page_id long, bytes long, several boolean, part int, within long"))
    sums = d.groupBy("part").agg(F.sum("bytes").alias("size"))
    # a row for each partition
    base = sums.select(F.col("part").alias("p"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    return d.join(small(base, parts), F.col("part") == F.col("p")).select(F.col("known").alias("m_known"), F.col("page_id").alias("m_id"), F.col("bytes").alias("m_bytes"), F.col("several").alias("m_several"), (F.col("base") + F.col("within")).alias("m_offset"))


def _leaves(leaves: DataFrame, listed: DataFrame) -> DataFrame:
    """leaves with offset (of their key) and range."""
    d = leaves.join(listed, (F.col("known") == F.col("m_known")) & (F.col("page_id") == F.col("m_id")), "left")
    share = F.conv(F.substring("hash", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    at = F.col("m_offset") + F.when(F.col("m_several"), F.floor(share * F.col("m_bytes"))).otherwise(F.lit(0))
    stray = F.lit(-1) - F.floor(share * F.lit(STRAY))
    return written(d.select("known", "page_id", "bytes", "hash", "n", F.col("m_offset").alias("offset"), F.coalesce(F.floor(at / F.lit(RANGE_BYTES)), stray).cast("long").alias("node")))


def _up(df: DataFrame, order: list[str]) -> DataFrame:
    line = lambda x: F.concat_ws(" ", *[x[c].cast("string") for c in (*order, "hash")])
    return df.groupBy("node").agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(*order, "hash"))), line)), 256).alias("hash"))


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """(node, hash) of the ranges and of levels more above them, each written once; the last is one root."""
    out = [written(_up(leaves.drop("offset"), ["known", "page_id", "n"]))]
    for k in range(levels):
        node = F.floor(F.col("child") / F.lit(FAN)) if k < levels - 1 else F.lit(0)
        out.append(written(_up(out[-1].withColumnRenamed("node", "child").withColumn("node", node.cast("long")), ["child"])))
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("node", F.col("hash").alias("h_a")), b.select("node", F.col("hash").alias("h_b"))
    return written(x.join(y, "node", "full_outer").filter("not (h_a <=> h_b)").select("node"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, warc_file, record_offset, record_bytes, status) of each record that differs."""
    spark = primary.sparkSession
    first = written(records(primary))
    listed = written(manifest(first))
    a, b = _leaves(first, listed), _leaves(records(replica), listed)
    low, high = a.select("node").union(b.select("node")).agg(F.min("node"), F.max("node")).first()
    levels = 1
    while low is not None and high // FAN ** (levels - 1) - low // FAN ** (levels - 1) >= FAN:
        levels += 1
    x, y = tree(a, levels), tree(b, levels)
    bad = _differ(x[-1], y[-1])
    for k in range(levels - 1, -1, -1):
        if not bad.head(1):
            return spark.createDataFrame([], "page_id long, warc_file long, record_offset long, record_bytes long, status string")
        up = F.floor(F.col("node") / F.lit(FAN)) if k < levels - 1 else F.lit(0)
        under = lambda t, up=up, bad=bad: t.withColumn("up", up.cast("long")).join(bad.withColumnRenamed("node", "up"), "up", "left_semi").drop("up")
        bad = _differ(under(x[k]), under(y[k]))
    key = ["known", "page_id", "hash"]
    a, b = a.join(bad, "node", "left_semi"), b.join(bad, "node", "left_semi")
    left = a.select(*key, "bytes", "offset", F.col("n").alias("n_a")).join(b.select(*key, F.col("n").alias("n_b")), key, "full_outer")
    left = left.withColumn("more", F.coalesce("n_a", F.lit(0)) - F.coalesce("n_b", F.lit(0))).filter("more <> 0")
    each = left.select("known", "page_id", "hash", "bytes", "offset", (F.col("more") > 0).alias("ours"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more"))).alias("copy"))
    # pairs of the damaged records of one key, in the order of hashes
    each = written(each.withColumn("nth", F.row_number().over(Window.partitionBy("known", "page_id", "ours").orderBy("hash", "copy"))))
    p = each.filter("ours").select("known", "page_id", "nth", "bytes", "offset", F.lit(1).alias("has_a"))
    q = each.filter("not ours").select("known", "page_id", "nth", F.lit(1).alias("has_b"))
    return p.join(q, ["known", "page_id", "nth"], "full_outer").select(
        F.when(F.col("known"), F.col("page_id")).alias("page_id"),
        F.floor(F.col("offset") / F.lit(FILE_BYTES)).cast("long").alias("warc_file"),
        F.pmod("offset", F.lit(FILE_BYTES)).cast("long").alias("record_offset"),
        F.col("bytes").alias("record_bytes"),
        F.when(F.col("has_b").isNull(), "missing").when(F.col("has_a").isNull(), "extra").otherwise("changed").alias("status"),
    )


def decayed(pages: DataFrame) -> DataFrame:
    """A replica of pages with damage that depends on a hash of the url: some payloads lose a byte, some records are gone."""
    mark = F.substring(F.md5(F.concat(F.col("url"), F.lit("#"), F.col("page_id").cast("string"))), 1, 2)
    # a url that is null has no mark and no damage
    return pages.filter(F.coalesce(mark, F.lit("")) != "0b").withColumn("html", F.when(F.coalesce(mark, F.lit("")).isin("07", "70"), F.expr("substring(html, 2)")).otherwise(F.col("html")))


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(url) + strlen(html) + 32 AS record_bytes, html, substr(md5(url || '#' || page_id::VARCHAR), 1, 2) AS mark FROM pages
), o AS (
  SELECT *, (sum(record_bytes) OVER (ORDER BY page_id) - record_bytes)::BIGINT AS place FROM p
)
SELECT page_id, place // {FILE_BYTES} AS warc_file, place % {FILE_BYTES} AS record_offset, record_bytes::BIGINT AS record_bytes,
       CASE WHEN mark = '0b' THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE mark = '0b' OR (mark IN ('07', '70') AND html <> '')
"""
