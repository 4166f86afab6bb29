"""Minimum-cost-flow resharding.

Old shards (of any sizes) are to become new shards of given capacities, and the
fewest bytes are to move.  Old shard i and new shard i are in one place (old
shards in name order): a byte that stays costs 0, a byte that moves costs 1 and
passes a hub, so the network has one edge a shard for staying, one to the hub and
one from it, and is solved on the driver by a primal-dual minimum-cost flow,
whatever the data's size.  The flow gives each old shard an ordered list of
byte ranges; a document goes to the shard of the range that its first byte is in
(so a shard can pass its capacity by less than its last document).

Order in a shard: doc_id, then text hash.  Slim rows (no texts) are range
partitioned by shard and order, each partition's sums and the sums before it give
every offset: no window covers a shard, whatever its doc_ids look like, and a
random last key cuts rows that repeat.  A byte range then is a range of keys, and
there are at most as many as old and new shards together: texts are sent to their
shard by a join with these alone.  Only if a range ends among equal rows, these
are numbered one by one.

Null doc_ids come first, by text hash; null shards are the shard ''.  Null and empty
texts have 0 bytes and go with their offset.  Repeated rows are rows of their own,
in the files as in the report.  Capacities are the total divided evenly (the first
ones take the remainder) unless given; if they hold less than the total, the flow
can't exist and a ValueError says so.  Old shards are known to the driver: a row each.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import fresh, packed, shared_dir, small, written

NEW_SHARDS = 24
LAST = (1 << 62) + ((1 << 62) - 1)
_KEY = ("old", "known", "id", "tie")


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost >= 0) of a cheapest maximum flow (primal-dual: one blocking flow for each path cost)."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in edges:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
    while True:
        far = [None] * n
        far[source] = 0
        queue, inside = deque([source]), [False] * n
        while queue:
            a = queue.popleft()
            inside[a] = False
            for e in out[a]:
                if cap[e] and (far[to[e]] is None or far[a] + cost[e] < far[to[e]]):
                    far[to[e]] = far[a] + cost[e]
                    if not inside[to[e]]:
                        inside[to[e]] = True
                        queue.append(to[e])
        if far[sink] is None:
            return [cap[2 * i + 1] for i in range(len(edges))]
        # blocking flow over the edges of shortest paths; a node's pointer never goes back
        at, on_path, path = [0] * n, [False] * n, []
        a = source
        on_path[source] = True
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                for x in path:
                    on_path[to[x]] = False
                path, a = [], source
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                b = to[e]
                if cap[e] and far[b] is not None and far[b] == far[a] + cost[e] and not on_path[b]:
                    break
                at[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                on_path[a] = False
                a = to[e ^ 1]
                at[a] += 1
                continue
            path.append(e)
            on_path[b] = True
            a = b


def transfers(old: list[int], capacity: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each old shard its byte ranges [from, to) with the new shard that takes them, moving the fewest bytes."""
    if sum(old) > sum(capacity):
        raise ValueError(f"{sum(old)} bytes don't fit into capacities of {sum(capacity)}")
    m, n = len(old), len(capacity)
    hub, source, sink = m + n, m + n + 1, m + n + 2
    edges = [(source, i, b, 0) for i, b in enumerate(old)]
    edges += [(i, m + i, old[i], 0) for i in range(min(m, n))]
    edges += [(i, hub, old[i], 1) for i in range(m)]
    edges += [(hub, m + j, c, 0) for j, c in enumerate(capacity)]
    edges += [(m + j, sink, c, 0) for j, c in enumerate(capacity)]
    flow = min_cost_flow(m + n + 3, edges, source, sink)
    stay = flow[m : m + min(m, n)] + [0] * (m - min(m, n))
    into = flow[2 * m + min(m, n) : 2 * m + min(m, n) + n]
    out, j, room = [], 0, (into[0] if into else 0)
    for i, size in enumerate(old):
        own = [(0, stay[i], i)] if stay[i] else []
        at = stay[i]
        while at < size:
            while not room:
                j += 1
                room = into[j]
            step = min(room, size - at)
            own.append((at, at + step, j))
            at, room = at + step, room - step
        out.append(own)
    return out


def _keyed(docs: DataFrame, shard_col: str, *row: str) -> DataFrame:
    """(old, known, id, tie: the order; bytes; row: the columns named) of every document."""
    return docs.select(
        F.coalesce(F.col(f"`{shard_col}`").cast("string"), F.lit("")).alias("old"),
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64("text").alias("tie"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        *([packed(docs, *row).alias("row")] if row else []),
    )


def _running(batches):
    """Adds part (the partition) and within (the bytes before a row in its old shard and partition) to sorted rows."""
    part, last, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        old, size = batch.column("old").to_pylist(), batch.column("bytes").to_numpy()
        before = np.cumsum(size) - size
        new = [k for k in range(len(old)) if old[k] != (old[k - 1] if k else last)]
        first = [0, *new] if not new or new[0] else new
        shift = -before[first]
        if first != new:
            shift[0] = total
        within = before + np.repeat(shift, np.diff([*first, len(old)]))
        last, total = old[-1], int(within[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(old), part, np.int32)), pa.array(within)], [*batch.schema.names, "part", "within"])


def _offsets(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed with at, the offset in the old shard; (old, size) of the old shards), written."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = keyed.withColumn("salt", F.rand(17)).repartitionByRange(parts, *_KEY, "salt").sortWithinPartitions(*_KEY, "salt").drop("salt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", part int, within long"
    d = written(d.mapInArrow(_running, schema))
    sums = written(d.groupBy("old", "part").agg(F.sum("bytes").alias("size")))
    # a row for each partition and shard that begins in it
    base = sums.select("old", "part", (F.sum("size").over(Window.partitionBy("old").orderBy("part")) - F.col("size")).alias("base"))
    return d.join(small(base, parts + sums.count()), ["old", "part"]).withColumn("at", F.col("base") + F.col("within")).drop("base", "within", "part"), sums.groupBy("old").agg(F.sum("size").alias("size"))


def _plan(shards: DataFrame, new_shards: int, capacity: list[int] | None) -> tuple[list[tuple], list[int]]:
    """((old, first byte, end, new shard, whether it is in place) of each range, shards that gain or lose bytes)."""
    shards = shards.orderBy("old").collect()
    if capacity is None:
        total = sum(r["size"] for r in shards)
        capacity = [total // new_shards + (k < total % new_shards) for k in range(new_shards)]
    plan, touched = [], set()
    for i, (r, parts) in enumerate(zip(shards, transfers([r["size"] for r in shards], capacity))):
        parts = parts or [(0, 0, min(i, len(capacity) - 1))]
        if any(j != i for _, _, j in parts):
            touched |= {j for _, _, j in parts if j != i} | ({i} if i < len(capacity) else set())
        plan += [(r[0], a, LAST if k == len(parts) - 1 else b, j, i == j) for k, (a, b, j) in enumerate(parts)]
    return plan, sorted(touched)


def _ranged(offsets: DataFrame, plan: list[tuple]) -> DataFrame:
    """offsets with new_shard and stays."""
    r = small(offsets.sparkSession.createDataFrame(plan, "r_old string, first long, past long, new_shard int, stays boolean"), len(plan))
    return offsets.join(r, (F.col("old") == F.col("r_old")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("past"))).drop("r_old", "past")


def _order(p: str = "") -> Column:
    return F.struct(F.col(f"{p}known").alias("known"), F.col(f"{p}id").alias("id"), F.col(f"{p}tie").alias("tie"))


def _sent(docs: DataFrame, shard_col: str, place: DataFrame) -> DataFrame:
    """Every document (row, old, bytes) with new_shard and stays; texts aren't shuffled.

    place: the slim rows with their shards.  Ranges of keys are those of bytes; keys
    in which a range ends are the shared ones.
    """
    spark = docs.sparkSession
    ends = place.groupBy("old", "first", "new_shard", "stays").agg(F.min(_order()).alias("lo"), F.max(_order()).alias("hi")).orderBy("old", "first").collect()
    shared = {(a["old"], a["hi"]) for a, b in zip(ends, ends[1:]) if a["old"] == b["old"] and a["hi"] == b["lo"]}
    kind = "struct<known boolean, id long, tie long>"
    keyed = _keyed(docs, shard_col, *docs.columns)
    if shared:
        s = F.broadcast(spark.createDataFrame([(o, *k) for o, k in sorted(shared)], "old string, known boolean, id long, tie long"))
        several = keyed.join(s, list(_KEY), "left_semi")
        keyed = keyed.join(s, list(_KEY), "left_anti")
    r = F.broadcast(spark.createDataFrame([(e["old"], e["lo"], e["hi"], e["new_shard"], e["stays"]) for e in ends], f"r_old string, lo {kind}, hi {kind}, new_shard int, stays boolean"))
    out = keyed.join(r, (F.col("old") == F.col("r_old")) & (_order() >= F.col("lo")) & (_order() <= F.col("hi"))).select("row", "old", "bytes", "new_shard", "stays")
    if shared:
        # of equal rows as many go to each range as begin in it: their numbers are exact, which one is which isn't told
        quota = place.join(s, list(_KEY), "left_semi").groupBy(*_KEY, "first", "new_shard", "stays").count()
        upto = Window.partitionBy(*_KEY).orderBy("first")
        quota = quota.withColumn("to", F.sum("count").over(upto)).withColumn("from", F.col("to") - F.col("count"))
        q = F.broadcast(quota.select(*[F.col(c).alias(f"q_{c}") for c in _KEY], "from", "to", "new_shard", "stays"))
        n = _numbered(several)
        out = out.union(n.join(q, F.expr(" and ".join(f"{c} = q_{c}" for c in _KEY) + " and nth >= from and nth < to")).select("row", "old", "bytes", "new_shard", "stays"))
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with nth, their number among rows of one key: counted by partitions of a written table, not in one task."""
    ones = _offsets(rows.withColumn("size", F.col("bytes")).withColumn("bytes", F.lit(1).cast("long")))[0].withColumnRenamed("at", "place")
    low = ones.groupBy(*_KEY).agg(F.min("place").alias("low")).select(*[F.col(c).alias(f"l_{c}") for c in _KEY], "low")
    return ones.join(F.broadcast(low), F.expr(" and ".join(f"{c} = l_{c}" for c in _KEY))).select(*_KEY, "row", F.col("size").alias("bytes"), (F.col("place") - F.col("low")).alias("nth"))


def placed(docs: DataFrame, shard_col: str = "source", new_shards: int = NEW_SHARDS, capacity: list[int] | None = None) -> DataFrame:
    """docs with old_shard, n_bytes, new_shard and moved, a new shard's rows together.

    A column of docs that has one of these names stays; the new one then has underscores before its name.
    """
    offsets, shards = _offsets(_keyed(docs, shard_col))
    plan, _ = _plan(shards, new_shards, capacity)
    if not plan:
        return _shown(docs, _keyed(docs, shard_col, *docs.columns).withColumns({"new_shard": F.lit(0), "stays": F.lit(True)}))
    # adaptive execution splits a large shard over tasks and puts small ones together
    return _shown(docs, _sent(docs, shard_col, _ranged(offsets, plan)).hint("rebalance", F.col("new_shard")))


def _shown(have: DataFrame, d: DataFrame) -> DataFrame:
    at = [F.col("at").alias(fresh(have, "shard_offset"))] if "at" in d.columns else []
    return d.select(
        "row.*",
        F.col("old").alias(fresh(have, "old_shard")),
        F.col("bytes").alias(fresh(have, "n_bytes")),
        *at,
        F.col("new_shard").alias(fresh(have, "new_shard")),
        (~F.col("stays")).alias(fresh(have, "moved")),
    )


def reshard(docs: DataFrame, path: str | None = None, shard_col: str = "source", new_shards: int = NEW_SHARDS, capacity: list[int] | None = None) -> DataFrame:
    """Writes the files of the shards that gain or lose bytes and returns every document's place:
    (doc_id, old_shard, n_bytes, shard_offset, new_shard, moved).

    path (a folder of the shared one unless given) gets new_shard=k/*.parquet with
    docs' columns; a shard that nothing enters or leaves isn't written.  Texts move
    once, to the files.
    """
    offsets, shards = _offsets(_keyed(docs, shard_col, "doc_id"))
    plan, touched = _plan(shards, new_shards, capacity)
    if not plan:
        return _shown(docs.select("doc_id"), offsets.withColumns({"new_shard": F.lit(0), "stays": F.lit(True)}))
    place = _ranged(offsets, plan)
    if touched:
        name = fresh(docs, "new_shard")
        moved = _sent(docs, shard_col, place).filter(F.col("new_shard").isin(touched))
        # adaptive execution splits a large shard over tasks and puts small ones together
        moved = moved.select("row.*", F.col("new_shard").alias(name)).hint("rebalance", F.col(name))
        moved.write.partitionBy(name).parquet(path or shared_dir(docs.sparkSession))
    return _shown(docs.select("doc_id"), place)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS old_shard, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
o AS (SELECT old_shard, sum(n_bytes)::BIGINT AS size, row_number() OVER (ORDER BY old_shard) - 1 AS i FROM d GROUP BY 1),
t AS (SELECT sum(size)::BIGINT AS total FROM o),
c AS (SELECT j, total // {NEW_SHARDS} + (CASE WHEN j < total % {NEW_SHARDS} THEN 1 ELSE 0 END) AS cap FROM t, range({NEW_SHARDS}) r(j)),
s AS (SELECT o.*, coalesce(least(size, cap), 0) AS stay FROM o LEFT JOIN c ON i = j),
x AS (SELECT *, sum(size - stay) OVER (ORDER BY i) - (size - stay) AS out_from FROM s),
r AS (SELECT j, cap - coalesce(stay, 0) AS need FROM c LEFT JOIN s ON i = j),
y AS (SELECT *, sum(need) OVER (ORDER BY j) - need AS in_from FROM r),
seg AS (
  SELECT old_shard, i, 0::BIGINT AS a, stay AS b, i AS j FROM x WHERE stay > 0
  UNION ALL
  SELECT old_shard, i, (stay + greatest(out_from, in_from) - out_from)::BIGINT, (stay + least(out_from + size - stay, in_from + need) - out_from)::BIGINT, j
  FROM x JOIN y ON greatest(out_from, in_from) < least(out_from + size - stay, in_from + need)
),
p AS (SELECT d.*, (sum(n_bytes) OVER (PARTITION BY old_shard ORDER BY doc_id) - n_bytes)::BIGINT AS shard_offset FROM d)
SELECT doc_id, p.old_shard, n_bytes, shard_offset, j::INTEGER AS new_shard, j <> i AS moved
FROM p JOIN seg ON p.old_shard = seg.old_shard AND shard_offset >= a AND (shard_offset < b OR b = (SELECT max(b) FROM seg q WHERE q.old_shard = p.old_shard) AND shard_offset >= b)
"""
