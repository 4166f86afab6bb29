"""Evaluation: splits by author, strata, coverage, overlap, fingerprints, bootstrap intervals and baselines."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.hashing import fnv1a64, fold
from gleaner.schemas import DOSSIER_JSON


def author_fold(author: Column, folds: int = 5) -> Column:
    """The fold of an author by FNV-1a of the name in lower case; fold 4 of 5 is the test split."""
    return fold(fnv1a64(F.lower(author)), folds)


def rule_coverage(fires: DataFrame, slop: str) -> DataFrame:
    """(rule, n_slop, n_ham, log_ratio) of melted fires, counts smoothed by a half."""
    c = fires.groupBy("rule").agg(F.count_if(slop).alias("n_slop"), F.count_if(~F.col(slop)).alias("n_ham"))
    return c.withColumn("log_ratio", F.ln((F.col("n_slop") + 0.5) / (F.col("n_ham") + 0.5)))


def cap(df: DataFrame, key: str, order: str, most: int = 15) -> DataFrame:
    """The first rows of each key, in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def overlap(df: DataFrame, stratum: Column, slop: Column) -> DataFrame:
    """(stratum, n_slop, n_ham, overlap): the least of both counts in each stratum, such as a month."""
    c = df.groupBy(stratum.alias("stratum")).agg(F.count_if(slop).alias("n_slop"), F.count_if(~slop).alias("n_ham"))
    return c.withColumn("overlap", F.least("n_slop", "n_ham"))


def missing(test: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """The test rows without a prediction; an evaluation with any is no evaluation."""
    return test.join(predictions.select(key), key, "left_anti")


def last_prediction(predictions: DataFrame, order: str) -> DataFrame:
    """One (id, score) for each id, the last one; ids are id or repo#number.  A score outside [0, 1] is an error."""
    key = F.coalesce("id", F.concat_ws("#", "repo", F.col("number").cast("string")))
    ok = F.when(F.col("score").between(0.0, 1.0), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("score out of range for "), key)).cast("double"))
    return predictions.groupBy(key.alias("id")).agg(F.max_by(ok, order).alias("score"))


def repo_disjoint(test: DataFrame, train: DataFrame, repo: str = "repo") -> DataFrame:
    return test.join(train.select(repo).distinct(), repo, "left_anti")


def fingerprint(labels: DataFrame) -> DataFrame:
    """(fingerprint): FNV-1a in hex over the sorted lines of id and label.

    The hash is over one string by its definition, so the labels must fit into a row.
    """
    line = F.concat_ws("\t", "id", "label")
    return labels.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("t")).select(F.lower(F.lpad(F.hex(fnv1a64("t")), 16, "0")).alias("fingerprint"))


def bootstrap_recall(df: DataFrame, score: str, positive: Column, target: float = 0.01, rounds: int = 1000, seed: int = 7) -> tuple[float, float] | None:
    """95 % percentile interval of the recall at a false-positive rate.

    Scores are counted in steps of 1e-4 (10,001 rows at most, whatever the data's
    size), and each round draws multinomial counts of them.
    """
    h = df.groupBy(F.round(F.col(score), 4).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).orderBy(F.desc("s")).toPandas()
    pos, neg = h["p"].to_numpy(), h["n"].to_numpy()
    if not pos.sum() or not neg.sum():
        return None
    rng, total = np.random.default_rng(seed), int(pos.sum() + neg.sum())
    out = []
    for _ in range(rounds):
        draw = rng.multinomial(total, np.concatenate([pos, neg]) / total)
        p, n = draw[: len(pos)], draw[len(pos) :]
        if not p.sum() or not n.sum():
            continue
        allowed = int(target * n.sum())
        at = int(np.searchsorted(np.cumsum(n), allowed, "right"))  # the step of the first false alarm too many
        out.append(p[:at].sum() / p.sum())
    out = np.sort(out)
    return float(out[int(0.025 * len(out))]), float(out[int(0.975 * len(out))])


def account_age_baseline(days: Column) -> Column:
    return F.coalesce(1.0 / (1.0 + F.greatest(days, F.lit(0)) / 90.0), F.lit(0.75))


def first_timer_baseline(first: Column) -> Column:
    return F.when(first, 0.9).otherwise(0.1)


def required(test: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """test with its predictions; a ValueError names some of those without one, so nothing is evaluated in part."""
    lost = [r[0] for r in missing(test.select(key), predictions, key).head(5)]
    if lost:
        raise ValueError(f"test rows without a prediction, such as {lost}")
    return test.join(predictions, key)


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the one that came first: records that several mining runs found."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*keys, "_first.*").select(*df.columns)


OUTCOMES = ("label", "source", "state", "merged", "pr_labels", "repo_stars", "audit", "kind", "author_association")
#: sources of ordinary requests that look like generated ones: without them a corpus rewards shortcuts
ANTI_SHORTCUT = ("agent-merged", "ai-topic-merged")


def release(records: DataFrame) -> DataFrame:
    """Mined records without the columns that give the outcome away.

    Instead of the stars there is their magnitude, and instead of the association with the
    repository what the author's public history (dossier, JSON) showed before the
    request: first_pr_to_repo, prior_prs_visible, prior_prs_this_repo and
    prior_merged_this_repo.  The dossier loses what came later, and of requests to the same
repository the state, the labels and whether they were merged.
    """
    d = records.withColumn("id", F.concat_ws("#", "repo", F.col("number").cast("string")))
    if "repo_stars" in d.columns:
        d = d.withColumn("repo_stars_magnitude", F.floor(F.log10(F.greatest(F.coalesce("repo_stars", F.lit(0)), F.lit(1)))).cast("int"))
    if {"dossier", "created_at"} <= set(d.columns):
        d = d.withColumn("_d", F.from_json("dossier", DOSSIER_JSON))
        nodes = F.coalesce(F.col("_d.data.user.pullRequests.nodes"), F.array())
        # times are ISO text, which orders as they do; without one there is no before
        before = F.filter(nodes, lambda n: F.coalesce((F.col("created_at") != "") & (n["createdAt"] != "") & (n["createdAt"] < F.col("created_at")), F.lit(False)))
        d = d.withColumn("_before", before)
        here = F.filter("_before", lambda n: F.coalesce(F.lower(n["repository"]["nameWithOwner"]) == F.lower("repo"), F.lit(False)))
        d = d.withColumns({"_here": here}).withColumns(
            {
                "first_pr_to_repo": F.size("_here") == 0,
                "prior_prs_visible": F.size("_before").cast("long"),
                "prior_prs_this_repo": F.size("_here").cast("long"),
                "prior_merged_this_repo": F.size(F.filter("_here", lambda n: F.coalesce(n["merged"], F.lit(False)))).cast("long"),
            }
        )
        late = lambda n: F.coalesce((F.col("created_at") != "") & (n["createdAt"] != "") & (n["createdAt"] >= F.col("created_at")), F.lit(False))
        same = lambda n: F.coalesce(F.lower(n["repository"]["nameWithOwner"]) == F.lower("repo"), F.lit(False))
        told = ("labels", "merged", "state")
        kept = F.transform(F.filter(nodes, lambda n: ~late(n)), lambda n: reduce(lambda x, k: x.withField(k, F.when(~same(n), n[k])), told, n))
        user = F.col("_d.data.user").withField("pullRequests", F.struct(kept.alias("nodes")))
        d = d.withColumn("dossier", F.when(F.col("_d.data.user").isNotNull(), F.to_json(F.struct(F.struct(user.alias("user")).alias("data"))))).drop("_d", "_before", "_here")
    return d.drop(*OUTCOMES)


def released_labels(records: DataFrame) -> DataFrame:
    """(id, label, source, author, kind); a ValueError if a source against shortcuts has no ordinary request."""
    d = records.select(F.concat_ws("#", "repo", F.col("number").cast("string")).alias("id"), "label", F.coalesce("source", F.lit("")).alias("source"), "author", F.coalesce("kind", F.lit("")).alias("kind") if "kind" in records.columns else F.lit("").alias("kind"))
    have = {r[0] for r in d.filter((F.col("label") == "ham") & F.col("source").isin(*ANTI_SHORTCUT)).select("source").distinct().collect()}
    if lost := [x for x in ANTI_SHORTCUT if x not in have]:
        raise ValueError(f"no ordinary requests of {lost}: not released")
    return d
