"""Learning: token likelihood ratios, rank statistics, thresholds, the logistic fit and its guarded promotion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import tokens
from gleaner.operators.engine import Weights, sigmoid
from gleaner.session import written

CLAMP, SUM_CLAMP, LEAST_DOCS, TOP_TOKENS, LEAST_MATCHES = 3.0, 12.0, 3, 400, 3


def distinct_tokens(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    return df.select(*keys, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def token_llr(docs: DataFrame, slop: Column, text: str = "text", top: int = TOP_TOKENS) -> DataFrame:
    """(token, llr) of the most telling tokens by document counts of both classes; empty without one of the classes."""
    d = docs.select(slop.alias("slop"), F.col(text).alias("text"))
    n = d.agg(F.coalesce(F.count_if("slop"), F.lit(0)).alias("ns"), F.coalesce(F.count_if(~F.col("slop")), F.lit(0)).alias("nh"))
    c = distinct_tokens(d, "slop").groupBy("token").agg(F.count_if("slop").alias("s"), F.count_if(~F.col("slop")).alias("h")).filter(F.col("s") + F.col("h") >= LEAST_DOCS)
    c = c.crossJoin(F.broadcast(n)).filter("ns > 0 and nh > 0")  # one row
    llr = F.ln(((F.col("s") + 1.0) / (F.col("ns") + 2.0)) / ((F.col("h") + 1.0) / (F.col("nh") + 2.0)))
    c = c.select("token", F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), llr)).alias("llr"))
    return c.orderBy(F.round(F.abs("llr"), 9).desc(), "token").limit(top)


def token_score(docs: DataFrame, table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, matches, token_score) of the documents that hold three known tokens; the table has 400 rows at most."""
    t = distinct_tokens(docs, key, text=text).join(F.broadcast(table), "token").groupBy(key).agg(F.count("*").alias("matches"), F.sum("llr").alias("s")).filter(F.col("matches") >= LEAST_MATCHES)
    return t.select(key, "matches", sigmoid(F.greatest(F.lit(-SUM_CLAMP), F.least(F.lit(SUM_CLAMP), F.col("s")))).alias("token_score"))


def score_counts(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(score, pos, neg, pos_above, neg_above): counts at each score and of all greater ones.

    Rows become one per score first; the running sums go over the scores of one range
    and the totals of the ranges above, so no task sorts all scores.
    """
    c = df.select(F.col(score).alias("score"), positive.alias("p")).groupBy("score").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"))
    c = c.withColumn("part", F.floor(F.col("score") * 4096))
    per = c.groupBy("part").agg(F.sum("pos").alias("pp"), F.sum("neg").alias("pn"))
    up = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range: 4097 for probabilities
    per = per.select("part", F.coalesce(F.sum("pp").over(up), F.lit(0)).alias("bp"), F.coalesce(F.sum("pn").over(up), F.lit(0)).alias("bn"))
    w = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = lambda x, b: (F.coalesce(F.sum(x).over(w), F.lit(0)) + F.col(b)).alias(f"{x}_above")
    return c.join(per, "part").select("score", "pos", "neg", above("pos", "bp"), above("neg", "bn"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(auc): the chance that a positive scores higher, ties half; null without one of the classes."""
    c = score_counts(df, score, positive)
    lost = F.sum((F.col("neg_above") + F.col("neg") / 2.0) * F.col("pos"))
    n = F.sum("pos") * F.sum("neg")
    return c.agg(F.when(n > 0, 1.0 - lost / n).alias("auc"))


def thresholds_at_fpr(df: DataFrame, score: str, positive: Column, targets: Sequence[float]) -> DataFrame:
    """(target, threshold): just above the negative that would be one false alarm too many; all negatives if none may pass."""
    c = score_counts(df, score, positive)
    n = c.agg(F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))
    t = df.sparkSession.createDataFrame([(float(x),) for x in targets], "target double").crossJoin(F.broadcast(n)).withColumn("k", F.floor(F.col("target") * F.col("n")))
    at = c.join(F.broadcast(t), (F.col("k") >= F.col("neg_above")) & (F.col("k") < F.col("neg_above") + F.col("neg")))
    found = at.groupBy("target").agg(F.least(F.max("score") + 1e-9, F.lit(1.0)).alias("threshold"))
    return t.select("target").join(found, "target", "left").select("target", F.coalesce("threshold", F.lit(1.0)).alias("threshold"))


def observed_fpr(df: DataFrame, score: str, positive: Column, threshold: float) -> DataFrame:
    """(fpr): the share of negatives at or over a threshold; 0 without negatives."""
    return df.filter(~positive).agg(F.coalesce(F.avg((F.col(score) >= threshold).cast("double")), F.lit(0.0)).alias("fpr"))


def ranked_rules(weights: DataFrame, top: int = 20) -> DataFrame:
    """(rule, weight, rank) of the rules with the greatest weights; ties by name."""
    t = weights.orderBy(F.abs("weight").desc(), "rule").limit(top)
    return t.agg(F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("o"), "rule", "weight"))).alias("l")).select(F.posexplode("l")).select("col.rule", "col.weight", (F.col("pos") + 1).alias("rank"))


def recall_at(df: DataFrame, score: str, threshold: float, *keys: str) -> DataFrame:
    """(keys, n, caught, recall) of the rows (all positive, or one class) over a threshold."""
    hit = F.col(score) >= threshold
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("caught"), F.avg(hit.cast("double")).alias("recall"))


def features(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """df with x, the dense values of the rules; of a rule that fires twice the last counts."""
    value = lambda r: F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), F.transform(F.filter("fires", lambda f: f["rule"] == r), lambda f: f["value"])), -1), F.lit(0.0))
    return df.withColumn("x", F.array(*[value(r) for r in rules]))


def _sums(theta: np.ndarray):
    """Partial sums of a batch: loss, gradient and Hessian of the weighted logistic loss, as (cell, value) rows."""

    def run(batches):
        n = len(theta)
        total = np.zeros(1 + n + n * n)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.hstack([np.ones((batch.num_rows, 1)), batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n - 1)])
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = x @ theta
            p = 1 / (1 + np.exp(-z))
            total[0] += (w * (np.logaddexp(0, z) - y * z)).sum()
            total[1 : 1 + n] += x.T @ (w * (p - y))
            total[1 + n :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "value"])

    return run


def _nonnegative(h: np.ndarray, g: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The least point of the quadratic model at theta in which all but the first number are >= 0, by coordinates."""
    d, slope = theta.copy(), g - h @ theta
    for _ in range(500):
        before = d.copy()
        for k in range(len(d)):
            if h[k, k] > 0:
                v = d[k] - (slope[k] + h[k] @ d) / h[k, k]
                d[k] = v if k == 0 else max(v, 0.0)
        if np.abs(d - before).max() < 1e-12:
            break
    return d


def newton(sums, n: int, l2: float = 1e-3, rounds: int = 40) -> tuple[float, np.ndarray]:
    """(bias, coefficients >= 0) of the least penalised loss; sums(theta): (loss, gradient, Hessian) a unit of weight."""

    def at(theta):
        loss, g, h = sums(theta)
        own = np.append(0.0, np.full(n, l2))
        return loss + 0.5 * (own * theta * theta).sum(), g + own * theta, h + np.diag(own) + 1e-9 * np.eye(n + 1)

    theta = np.zeros(n + 1)
    loss, g, h = at(theta)
    for _ in range(rounds):
        step = _nonnegative(h, g, theta) - theta
        if np.abs(step).max() < 1e-7:
            break
        size = 1.0
        while True:
            new = theta + size * step
            after = at(new)
            if after[0] <= loss or size < 1e-4:
                break
            size /= 2
        theta, (loss, g, h) = new, after
    return float(theta[0]), theta[1:]


def fit(examples: DataFrame, rules: Sequence[str]) -> Weights:
    """Weights from (fires, is_slop, sample_weight), the same way at every size.

    Equal feature rows are merged with their weights summed, which leaves the objective
    as it is.  They stay where they are: a Newton round sends the coefficients out, and
    the tasks' sums (one number for each two rules) are added up by Spark.
    """
    d = features(examples, rules).groupBy("x", F.col("is_slop").cast("double").alias("y")).agg(F.sum(F.coalesce("sample_weight", F.lit(1.0)).cast("double")).alias("w"))
    d, n = written(d), len(rules)
    total = max(d.agg(F.sum("w")).first()[0] or 0.0, 1e-9)

    def sums(theta):
        out = np.zeros(1 + (n + 1) + (n + 1) ** 2)
        for cell, value in d.mapInArrow(_sums(theta), "cell int, value double").groupBy("cell").agg(F.sum("value")).toLocalIterator():
            out[cell] = value / total
        return out[0], out[1 : n + 2], out[n + 2 :].reshape(n + 1, n + 1)

    bias, beta = newton(sums, n)
    return Weights(bias, dict(zip(rules, map(float, beta))))


def probabilities(examples: DataFrame, weights: Weights) -> DataFrame:
    known = [F.lit(v) for kv in sorted(weights.rules.items()) for v in kv]
    w = lambda r: F.coalesce(F.try_element_at(F.create_map(*known), r), F.lit(0.0)) if known else F.lit(0.0)
    return examples.withColumn("probability", sigmoid(F.lit(float(weights.bias)) + F.aggregate("fires", F.lit(0.0), lambda s, f: s + f["value"] * w(f["rule"]))))


def tier_thresholds(examples: DataFrame, weights: Weights) -> tuple[float, float, float]:
    """Cuts at false-positive rates of 5, 1 and 0.1 %, the upper ones raised so that they rise."""
    t = {r["target"]: r["threshold"] for r in thresholds_at_fpr(probabilities(examples, weights), "probability", F.col("is_slop"), (0.05, 0.01, 0.001)).collect()}
    label = t[0.05]
    hold = max(t[0.01], label + 1e-9)
    return label, hold, max(t[0.001], hold + 1e-9)


def holdout(feedback: DataFrame, order: str, every: int = 5) -> DataFrame:
    """feedback with holdout, true for every fifth row in order: ranks come from range offsets, so no task holds all rows."""
    d = feedback.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    d = written(d)
    n = d.groupBy("_part").agg(F.count("*").alias("_n"))
    base = n.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_base")
    return d.join(F.broadcast(base), "_part").withColumn("holdout", rank % every == 0).drop("_part", "_base")


def learn(feedback: DataFrame, incumbent: Weights, rules: Sequence[str], order: str = "id", least: int = 200, least_class: int = 40, slack: float = 0.005) -> dict:
    """{promoted, reason, candidate_auc, incumbent_auc, weights}: a new fit replaces the incumbent unless it is thin or worse."""
    no = lambda reason, a=None, b=None: {"promoted": False, "reason": reason, "candidate_auc": a, "incumbent_auc": b, "weights": None}
    pos, n = feedback.agg(F.count_if("is_slop"), F.count("*")).first()
    if n < least:
        return no("too few examples")
    if min(pos, n - pos) < least_class:
        return no("too few of one class")
    d = holdout(feedback, order)
    train, held = d.filter("not holdout"), d.filter("holdout")
    hp, hn = held.agg(F.count_if("is_slop"), F.count_if(~F.col("is_slop"))).first()
    if not hp or not hn:
        return no("the holdout lost a class")
    w = fit(train, rules)
    label, hold, close = tier_thresholds(held, w)
    if close > 1:
        return no("thresholds are not valid")
    w = Weights(w.bias, w.rules, label, hold, close)
    of = lambda x: auc(probabilities(held, x), "probability", F.col("is_slop")).first()[0]
    a, b = of(w), of(incumbent)
    if a < b - slack:
        return no(f"held-out AUC fell: {a:.4f} after {b:.4f}", a, b)
    return {"promoted": True, "reason": f"held-out AUC {a:.4f} after {b:.4f}", "candidate_auc": a, "incumbent_auc": b, "weights": w}


def cross_validate(examples: DataFrame, rules: Sequence[str], fold: str = "fold", folds: int = 5) -> DataFrame:
    """examples with the out-of-fold probability: each fold is scored by the fit of the others (a row of weights a fold goes to the tasks)."""
    parts = [probabilities(examples.filter(F.col(fold) == k), fit(examples.filter(F.col(fold) != k), rules)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
