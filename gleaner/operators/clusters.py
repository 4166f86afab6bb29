"""Connected components, cluster statistics, views as of arrival and bursts."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import STYLE
from gleaner.session import written

WINDOW_SECS, TTL_SECS, LAMBDA = 6 * 3600, 14 * 86400, 0.5


def components(edges: DataFrame) -> DataFrame:
    """(id, cluster) of every node with an edge; a cluster is named by its least node.

    Large and small stars in turn: the rounds are logarithmic in the longest chain,
    and each one's edges are a table in the shared folder.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        x = large.join(least, "u")
        e = written(x.select("u", F.col("m").alias("v")).union(x.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("cluster")).union(e.select(F.col("v").alias("id"), F.col("v").alias("cluster"))).distinct()
        seen = now


def _cosine(x: str, y: str):
    p, q = F.array(*[F.col(f"{x}{k}") for k in STYLE]), F.array(*[F.col(f"{y}{k}") for k in STYLE])
    return cosine(p, q)


def cosine(p, q):
    """Cosine of two arrays; 0 where one has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(p, p)) * F.sqrt(dot(q, q))
    return F.when(norm > 0, dot(p, q) / norm).otherwise(F.lit(0.0))


def cluster_stats(members: DataFrame) -> DataFrame:
    """(cluster, size, distinct_repos, distinct_authors, style_cohesion) from (cluster, repo, author, the style columns).

    Cohesion is the mean cosine of the members' styles to the cluster's mean style.
    """
    mean = members.groupBy("cluster").agg(*[F.avg(k).alias(f"m_{k}") for k in STYLE])
    near = members.join(mean, "cluster").withColumn("near", _cosine("", "m_"))
    return near.groupBy("cluster").agg(
        F.count("*").alias("size"), F.count_distinct("repo").alias("distinct_repos"), F.count_distinct("author").alias("distinct_authors"), F.avg("near").alias("style_cohesion")
    )


def ln_poisson_tail(k: int, lam: float) -> float:
    """ln P(X >= k): the terms are summed until one is e^-40 of the greatest."""
    if k <= 0:
        return 0.0
    term = -lam + k * math.log(lam) - math.lgamma(k + 1)
    terms = [term]
    for i in range(k + 1, k + 10_001):
        term += math.log(lam) - math.log(i)
        if term < max(terms) - 40:
            break
        terms.append(term)
    top = max(terms)
    return min(0.0, top + math.log(math.fsum(math.exp(t - top) for t in terms)))


def burst_of(k: int, lam: float = LAMBDA) -> float:
    if k <= 1:
        return 0.0
    s = -ln_poisson_tail(k, max(lam, 0.05))
    return s / (s + 5.0)


def burst_score(lam: float = LAMBDA):
    """Column function: the surprise of k arrivals in a window, in [0, 1)."""

    @F.pandas_udf(T.DoubleType())
    def run(k: pd.Series) -> pd.Series:
        table = {x: burst_of(int(x), lam) for x in k.dropna().unique()}
        return k.map(table).astype("float64")

    return run


def arrivals_in_window(df: DataFrame, keys: list[str], secs: str, window: int = WINDOW_SECS) -> DataFrame:
    """df with in_window: the arrivals of the same keys in the seconds that end at each one; ties count each other."""
    return df.withColumn("in_window", F.count("*").over(Window.partitionBy(*keys).orderBy(secs).rangeBetween(-window, 0)))


VIEW = "id long, cluster long, size long, distinct_repos long, distinct_authors long, in_window long, style_cohesion double"


@dataclass
class _View:
    """A cluster as of its last arrival."""

    place: int
    first: int
    size: int
    repos: set
    authors: set
    recent: list
    style: np.ndarray
    unit: np.ndarray

    def joined(self, o: _View) -> _View:
        """This one with all of o; of sets and heaps the smaller goes into the larger."""
        if o.place < self.place:
            self.place, self.first = o.place, o.first
        self.size += o.size
        for name in ("repos", "authors"):
            few, many = sorted((getattr(self, name), getattr(o, name)), key=len)
            many |= few
            setattr(self, name, many)
        few, self.recent = sorted((self.recent, o.recent), key=len)
        for at in few:
            heapq.heappush(self.recent, at)
        self.style += o.style
        self.unit += o.unit
        return self


def _top(root: dict, j):
    top = j
    while root[top] != top:
        top = root[top]
    while root[j] != top:
        root[j], j = top, root[j]
    return top


def _grown(batches):
    """Views without a time-to-live, of rows by cluster and arrival.

    Clusters only grow then, so each is kept as sums, sets and the arrivals of the last
    window: the mean cosine is the sum of the unit styles times the mean's direction.
    """
    comp, root, views = None, {}, {}
    for batch in batches:
        style = np.column_stack([batch[k].to_numpy(zero_copy_only=False).astype(float) for k in STYLE])
        norm = np.sqrt((style**2).sum(1, keepdims=True))
        unit = np.divide(style, norm, out=np.zeros_like(style), where=norm > 0)
        out = []
        for r, (c, i, at, repo, author, near) in enumerate(zip(*[batch[k].to_pylist() for k in ("cluster", "id", "secs", "repo", "author", "near")], strict=True)):
            if c != comp:
                comp, root, views, place = c, {}, {}, 0
            root[i] = i
            views[i] = v = _View(place, i, 1, {repo} - {None}, {author} - {None}, [at], style[r].copy(), unit[r].copy())
            place += 1
            for j in near:
                # earlier clusters that the arrival touches become one
                if j in root and (x := _top(root, j)) != (y := _top(root, i)):
                    x, y = (x, y) if views[x].size >= views[y].size else (y, x)
                    root[y] = x
                    v = views[x].joined(views.pop(y))
            while v.recent[0] < at - WINDOW_SECS:
                heapq.heappop(v.recent)
            length = math.sqrt(v.style @ v.style)
            out.append((i, v.first, v.size, len(v.repos), len(v.authors), len(v.recent), float(v.unit @ v.style) / (length * v.size) if length > 0 else 0.0))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[x.split()[0] for x in VIEW.split(", ")])


def _replay(ttl: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["secs", "id"], kind="stable").reset_index(drop=True)
        place = {i: k for k, i in enumerate(pdf["id"])}
        near = [[place[j] for j in l if j in place] for l in pdf["near"]]
        style, secs = pdf[list(STYLE)].to_numpy(float), pdf["secs"].to_numpy()
        out = []
        for k in range(len(pdf)):
            live = secs[k] - ttl
            group, seen = [k], {k}
            for a in group:
                for j in near[a]:
                    if j < k and j not in seen and secs[j] >= live:
                        seen.add(j)
                        group.append(j)
            g = np.array(group)
            mean = style[g].mean(0)
            norm = np.sqrt((style[g] ** 2).sum(1)) * np.sqrt((mean**2).sum())
            cos = np.divide(style[g] @ mean, norm, out=np.zeros(len(g)), where=norm > 0)
            rows = pdf.iloc[g]
            out.append((pdf["id"][k], pdf["id"][min(group)], len(g), rows["repo"].nunique(), rows["author"].nunique(), int((secs[k] - secs[g] <= WINDOW_SECS).sum()), float(cos.mean())))
        return pd.DataFrame(out, columns=["id", "cluster", "size", "distinct_repos", "distinct_authors", "in_window", "style_cohesion"])

    return run


def views_at_arrival(members: DataFrame, edges: DataFrame, ttl: int | None = None) -> DataFrame:
    """Each row's cluster as it was when the row came: only earlier rows count, and with ttl only those that young.

    members: (id, secs, repo, author, the style columns).  What a row can reach lies
    in its final component, so components are replayed apart from each other.  Without
    ttl, edges may be those of signatures.edges(stars=True) if rows come by id.
    """
    e = written(edges)
    comp = components(e)
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("near"))
    cols = ["id", "secs", "repo", "author", *STYLE]
    m = members.select(*cols).join(comp, "id", "left").join(near, "id", "left")
    alone = m.filter("cluster is null").select(
        "id", F.col("id").alias("cluster"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("distinct_repos"), F.lit(1).cast("long").alias("distinct_authors"), F.lit(1).cast("long").alias("in_window"),
        F.when(F.greatest(*[F.abs(F.col(k)) for k in STYLE]) > 0, 1.0).otherwise(0.0).alias("style_cohesion"),
    )
    m = m.filter("cluster is not null")
    if ttl is None:
        return m.repartition("cluster").sortWithinPartitions("cluster", "secs", "id").mapInArrow(_grown, VIEW).unionByName(alone)
    return m.groupBy("cluster").applyInPandas(_replay(ttl), VIEW).unionByName(alone)
