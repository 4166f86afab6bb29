"""Mixing sources to target weights by pivotal dependent rounding.

Each document of source s is to occur total x weight(s) / size(s) times on
average.  The whole part is certain; the fractions are rounded by the pivotal
method: two fractional probabilities meet, and mass moves at random from one to
the other until one of them is 0 or 1, so that each document keeps its expected
copies and the sum never changes.  Documents meet in buckets of a hash, in rounds
of pairs; the one fractional document that a bucket can be left with goes up a
reduction tree of FAN children a node, where the residuals meet in the same way.

All random draws are hashes of row content, so retried tasks decide alike.  Rows
that agree in all columns are one entry with their number: its expected copies are
theirs together, and its copies are of that row, which are the same whichever is
meant; so a row that a third of the table repeats is one entry.  Null sources are one
source.  Weights that are null or negative count as 0, sources without a weight as 1;
a source's target is weight x size ** temper (temper 0: the weights themselves).
total is the number of rows unless given, so the sum of copies is total exactly.  An
empty table stays empty.  Null and empty texts are mixed like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel as K
from gleaner.llm.common import fresh, small, written

TEMPER, BUCKET_ROWS, FAN = 0.5, 4096, 64
_EPS = 1e-9


def pivotal(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """(rounded values, index of the one that stays fractional or -1); u holds a uniform draw for each.

    Each round pairs the fractional ones; the first of a pair draws.
    """
    out = p.copy()
    whole = (out < _EPS) | (out > 1 - _EPS)
    out[whole] = np.round(out[whole])
    left = np.flatnonzero(~whole)
    while len(left) > 1:
        odd = left[len(left) - 1 :] if len(left) % 2 else left[:0]
        i, j = left[0 : len(left) - len(odd) : 2], left[1 : len(left) - len(odd) : 2]
        a, b = out[i], out[j]
        s = a + b
        low = s <= 1
        # who gets the mass (sum at most 1), or who becomes whole (sum over 1)
        first = np.where(low, u[i] * s < a, u[i] * (2 - s) < 1 - b)
        big, rest = np.where(low, s, 1.0), np.where(low, 0.0, s - 1)
        out[i], out[j] = np.where(first, big, rest), np.where(first, rest, big)
        # a draw that decided is used up: what is left of it is uniform again
        u = u.copy()
        both = K.uniform(K.mix(u[i].view(np.uint64)) ^ u[j].view(np.uint64))
        u[i] = u[j] = both
        left = np.concatenate([np.where((out[i] > _EPS) & (out[i] < 1 - _EPS), i, j), odd])
        near = (out[left] < _EPS) | (out[left] > 1 - _EPS)
        out[left[near]] = np.round(out[left[near]])
        left = left[~near]
    return out, int(left[0]) if len(left) else -1


def _ordered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """(row order, rounded, held) of a bucket, in an order that depends on its rows only."""
    key, p = t.column("k1").to_numpy(), t.column("p").to_numpy()
    o = np.lexsort((t.column("k2").to_numpy(), key))
    out, held = pivotal(p[o], K.uniform(key[o].view(np.uint64) ^ np.uint64(0xA5A5)))
    return o, out, held


def _bucket(t: pa.Table) -> pa.Table:
    o, out, held = _ordered(t)
    back = np.empty(len(o), np.int64)
    back[o] = np.arange(len(o))
    up = np.zeros(len(o), bool)
    if held >= 0:
        up[o[held]] = True
    return pa.table({"k1": t.column("k1"), "k2": t.column("k2"), "whole": t.column("whole"), "p": pa.array(out[back]), "bucket": t.column("bucket"), "up": pa.array(up)})


def _node(t: pa.Table) -> pa.Table:
    """Residuals of one parent: decided ones have p 0 or 1, the one that goes up has its new probability."""
    t = t.sort_by("node")
    out, held = pivotal(t.column("p").to_numpy().copy(), K.uniform(t.column("k1").to_numpy().view(np.uint64) ^ np.uint64(0x5A5A)))
    up = np.zeros(len(out), bool)
    if held >= 0:
        up[held] = True
    return pa.table({"node": t.column("node"), "bucket": t.column("bucket"), "k1": t.column("k1"), "p": pa.array(out), "up": pa.array(up)})


def rates(counts: DataFrame, weights: dict | None = None, total: int | None = None, temper: float = TEMPER) -> DataFrame:
    """(source, rate): expected copies of each document of a source, from (source, n)."""
    n = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temper))))
    if weights:
        own = [(s, max(0.0, float(w or 0))) for s, w in weights.items()]
        w = counts.sparkSession.createDataFrame(own, "s string, own double")
        n = n.join(w, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("w", F.col("w") * F.coalesce("own", F.lit(1.0))).drop("s", "own")
    t, size = n.agg(F.sum("w"), F.sum("n")).first()
    total = size if total is None else total
    return n.select("source", (F.col("w") / F.lit(float(t or 1)) * F.lit(float(total or 0)) / F.col("n")).alias("rate"))


def _keys(docs: DataFrame) -> list[Column]:
    """Two independent hashes of all columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols[::-1])]


def _decided(docs: DataFrame, weights: dict | None, total: int | None, temper: float) -> DataFrame:
    """(k1, k2, source, rows, copies) of the distinct rows, written."""
    k1, k2 = _keys(docs)
    slim = written(docs.select(k1.alias("k1"), k2.alias("k2"), F.col("source").cast("string").alias("source")).groupBy("k1", "k2").agg(F.first("source").alias("source"), F.count("*").alias("rows")))
    counts = written(slim.groupBy("source").agg(F.sum("rows").alias("n")))
    r = rates(counts, weights, total, temper).withColumnRenamed("source", "s")
    buckets = max(1, -(-slim.count() // BUCKET_ROWS))
    mass = F.col("rate") * F.col("rows")
    d = slim.join(small(r, counts.count()), slim["source"].eqNullSafe(r["s"]), "left").withColumn("whole", F.floor(mass + F.lit(_EPS)))
    d = d.select("k1", "k2", "whole", F.greatest(F.lit(0.0), mass - F.col("whole")).alias("p"), F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets)).alias("bucket"))
    first = written(d.groupBy("bucket").applyInArrow(_bucket, "k1 long, k2 long, whole long, p double, bucket long, up boolean"))
    take = _residuals(first.filter("up").select("bucket", "k1", "p"), buckets).withColumnRenamed("bucket", "b")
    out = first.join(small(take, buckets), (F.col("bucket") == F.col("b")) & F.col("up"), "left")
    out = out.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), (F.col("whole") + F.when(F.col("up"), F.col("take")).otherwise(F.round("p"))).cast("long").alias("copies"))
    return written(slim.join(out, (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2"))).select("k1", "k2", "source", "rows", "copies"))


def _residuals(level: DataFrame, width: int) -> DataFrame:
    """(bucket, take) for each bucket that has a residual, from the reduction tree over (bucket, k1, p)."""
    done, span = None, 1
    while True:
        width, span = -(-width // FAN), span * FAN
        parent = F.floor(F.col("bucket") / F.lit(span))
        out = written(level.select(parent.alias("parent"), F.col("bucket").alias("node"), "bucket", "k1", "p").groupBy("parent").applyInArrow(lambda t: _node(t), "node long, bucket long, k1 long, p double, up boolean"))
        last = width <= 1
        # at the root a sum that isn't whole is rounded by its own probability
        take = F.when(F.col("up"), F.pmod(F.xxhash64("k1"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("p")).otherwise(F.col("p") > 0.5).cast("long")
        part = (out if last else out.filter("not up")).select("bucket", take.alias("take"))
        done = part if done is None else done.union(part)
        if last:
            return written(done)
        level = out.filter("up").select("bucket", "k1", "p")


def copies(docs: DataFrame, weights: dict | None = None, total: int | None = None, temper: float = TEMPER) -> DataFrame:
    """(doc_id, source, rows, copies) of every distinct row; the copies add up to total.

    rows: how often the table has it; copies: how often the mixture is to have it.
    """
    return _joined(docs, _decided(docs, weights, total, temper), ["doc_id", "source"])


def _joined(docs: DataFrame, decided: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with rows and copies, one row for each distinct row of docs; texts move once."""
    names = [fresh(docs, c) for c in ("_k1", "_k2", "_rows", "_copies")]
    d = decided.select(*[F.col(c).alias(n) for c, n in zip(("k1", "k2", "rows", "copies"), names)])
    keys = [k.alias(f"{n}_") for k, n in zip(_keys(docs), names)]
    all_ = docs.select(*[F.col(f"`{c}`") for c in columns], *keys)
    out = all_.join(d.hint("shuffle_hash"), (F.col(f"{names[0]}_") == F.col(names[0])) & (F.col(f"{names[1]}_") == F.col(names[1])))
    single = out.filter(F.col(names[2]) == 1)
    shown = lambda x: x.select(*[F.col(f"`{c}`") for c in columns], F.col(names[2]).alias("rows" if "rows" not in columns else names[2]), F.col(names[3]).alias("copies" if "copies" not in columns else names[3]))
    if not decided.filter("rows > 1").head(1):
        return shown(single)
    return shown(single).union(shown(out.filter(F.col(names[2]) > 1).dropDuplicates([names[0], names[1]])))


def mix(docs: DataFrame, weights: dict | None = None, total: int | None = None, temper: float = TEMPER) -> DataFrame:
    """docs with every row as often as it was rounded to."""
    d = _joined(docs, _decided(docs, weights, total, temper), docs.columns)
    n = d.columns[-1]
    return d.filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
