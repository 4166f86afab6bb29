"""Weights, scores, tiers, evidence and actions: all in a row's own task, without a shuffle."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import lexicons as L

TIERS = ("pass", "label", "hold", "close")
MARK = "<!-- triage-score -->"


@dataclass(frozen=True)
class Weights:
    bias: float
    rules: Mapping[str, float]
    label: float = 0.3
    hold: float = 0.7
    close: float = 0.95
    meta: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.label < self.hold < self.close <= 1 + 1e-6:
            raise ValueError("thresholds must rise from label over hold to close")


def default_weights(path: str | None = None) -> Weights:
    """Weights of a tab-separated file: a line for each rule, for the bias and for the cut of each tier."""
    text = Path(path or Path(__file__).parents[1] / "plans" / "weights.tsv").read_text()
    w = {k: float(v) for k, v in (line.split("\t") for line in text.splitlines() if line and line[0] != "#")}
    cuts = {t: w.pop(f"tier {t}") for t in TIERS[1:]}
    return Weights(w.pop("bias"), w, **cuts)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def melt(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule, value), a row for each fire.

    The outer form: for the inner one the optimizer adds a filter on the array's size,
    which it moves below the rules, so that they would all be computed twice.
    """
    return df.select(*keys, F.explode_outer("fires").alias("fire")).filter("fire is not null").select(*keys, "fire.rule", "fire.value")


def evidence(fires: Column, weights: Weights, ai_policy: Column | None = None) -> Column:
    """(rule, value, weight, contribution), the greatest contribution first; equal ones as they fired."""

    def weight(rule: Column) -> Column:
        known = sorted(weights.rules.items())
        w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known for x in kv]), rule), F.lit(0.0)) if known else F.lit(0.0)
        return w if ai_policy is None else F.when((ai_policy == "welcome") & rule.isin(*L.AI_STYLE_RULES), F.lit(0.0)).otherwise(w)

    items = F.transform(fires, lambda f, i: F.struct(f["rule"].alias("rule"), f["value"].alias("value"), weight(f["rule"]).alias("weight"), i.alias("nth")))
    ranked = F.array_sort(F.transform(items, lambda x: F.struct((-F.abs(x["value"] * x["weight"])).alias("order"), x["nth"].alias("nth"), x["rule"].alias("rule"), x["value"].alias("value"), x["weight"].alias("weight"))))
    return F.transform(ranked, lambda x: F.struct(x["rule"].alias("rule"), x["value"].alias("value"), x["weight"].alias("weight"), (x["value"] * x["weight"]).alias("contribution")))


def tier(p: Column, label: Column, hold: Column, close: Column) -> Column:
    return F.when(p >= close, 3).when(p >= hold, 2).when(p >= label, 1).otherwise(0)


def score(df: DataFrame, weights: Weights) -> DataFrame:
    """df (with fires) with score, probability, tier_code, tier and evidence.

    Columns ai_policy and threshold_label, threshold_hold, threshold_close change
    the weights and thresholds where df has them.
    """
    have = set(df.columns)
    cut = lambda name, own: F.coalesce(F.col(f"threshold_{name}"), F.lit(own)) if f"threshold_{name}" in have else F.lit(own)
    df = df.withColumn("evidence", evidence(F.col("fires"), weights, F.col("ai_policy") if "ai_policy" in have else None))
    df = df.withColumn("score", F.lit(float(weights.bias)) + F.aggregate("evidence", F.lit(0.0), lambda s, e: s + e["contribution"]))
    df = df.withColumn("probability", sigmoid(F.col("score")))
    df = df.withColumn("tier_code", tier(F.col("probability"), cut("label", weights.label), cut("hold", weights.hold), cut("close", weights.close)))
    return df.withColumn("tier", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier_code") + 1))


def score_long(fires: DataFrame, weights: DataFrame, bias: float, *keys: str) -> DataFrame:
    """(keys, score, probability) from melted fires and a (rule, weight) table: for weights that come as a table."""
    w = F.broadcast(weights.select("rule", "weight"))  # a row for each rule that exists
    s = fires.join(w, "rule", "left").groupBy(*keys).agg((F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))) + bias).alias("score"))
    return s.withColumn("probability", sigmoid(F.col("score")))


def evidence_comment(title: str = "Evidence") -> Column:
    """The evidence as a folded table."""
    row = lambda e: F.format_string("| %s | %.2f | %+.2f | %+.2f |\n", e["rule"], e["value"], e["weight"], e["contribution"])
    head = F.format_string(f"<details><summary>{title} (probability %.3f)</summary>\n\n| rule | value | weight | contribution |\n|---|---|---|---|\n", F.col("probability"))
    return F.concat(head, F.array_join(F.transform("evidence", row), ""), F.lit("\n</details>\n"))


def planned(df: DataFrame) -> DataFrame:
    """df (scored) with action, challenge and comment.

    dry_run turns every action but a comment into a label that says what would have
    been done; score_comments lets passes be commented; challenge_on (with a canary
    column) adds a question to a hold.
    """
    have = set(df.columns)
    flag = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    shown = evidence_comment()
    real = F.when(F.col("tier_code") == 0, F.when(flag("score_comments", False), "comment").otherwise("none")).otherwise(F.col("tier"))
    top = F.array_join(F.transform(F.slice("evidence", 1, 3), lambda e: F.concat(F.lit("- "), e["rule"], F.lit("\n"))), "")
    closing = F.concat(F.lit("Closed: its signals are past the threshold that this repository set.\n\nMain signals:\n"), top, F.lit("\nA reply in your own words gets it looked at again.\n\n"), shown)
    passing = F.concat(F.format_string(MARK + "\nScored %.3f, below every threshold; nothing is done.\n\n", F.col("probability")), shown)
    dry = flag("dry_run", False) & ~real.isin("none", "comment")
    df = df.withColumn("real_action", real)
    df = df.withColumn("action", F.when(dry, "label").otherwise(F.col("real_action")))
    df = df.withColumn("challenge", (F.col("action") == "hold") & flag("challenge_on", True))
    comment = F.when(F.col("real_action") == "none", F.lit(None).cast("string")).when(F.col("real_action") == "comment", passing)
    comment = comment.when(dry, F.concat(F.lit("Dry run: the action would have been `"), F.col("real_action"), F.lit("`.\n\n"), shown)).when(F.col("real_action") == "close", closing).otherwise(shown)
    return df.withColumn("comment", comment).drop("real_action")


def outcome(df: DataFrame, exempt: Column) -> DataFrame:
    """df with outcome: exempt before policy-close before scored."""
    mirror = F.coalesce(F.col("archetype") == "mirror-no-prs", F.lit(False)) if "archetype" in df.columns else F.lit(False)
    channel = F.coalesce(F.col("contribution_channel"), F.lit("the project's documented contribution channel")) if "contribution_channel" in df.columns else F.lit("the project's documented contribution channel")
    df = df.withColumn("outcome", F.when(exempt, "exempt").when(mirror, "close-by-policy").otherwise("scored"))
    said = F.concat(F.lit("Changes aren't taken here; they go through "), channel, F.lit(". This is policy and no judgment of the change."))
    return df.withColumn("policy_comment", F.when(F.col("outcome") == "close-by-policy", said))


def _fitted(w: Weights) -> datetime | None:
    try:
        at = datetime.fromisoformat(str(w.meta.get("fitted_at")))
    except ValueError:
        return None
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at


def newer(a: Weights, b: Weights) -> Weights:
    """The one that was fitted later, by RFC 3339 times; one that says when before one that doesn't, a if neither does."""
    x, y = _fitted(a), _fitted(b)
    return b if y is not None and (x is None or y > x) else a
