"""Clusters, scores, history, learning, evaluation and federation on small frames."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import STYLE
from gleaner.operators import clusters, engine, evaluate, federation, history, learn
from gleaner.operators import signatures as S


def test_components(spark):
    r = random.Random(1)
    chain = [(k, k + 1) for k in range(100, 140)]
    edges = chain + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: v for x, v in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = {x["id"]: x["cluster"] for x in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert clusters.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_both_families(spark):
    base = " ".join(f"word{k}" for k in range(200))
    near, far = base.replace("word50 ", "other "), " ".join(f"far{k}" for k in range(200))
    df = spark.createDataFrame([(0, base), (1, near), (2, far), (3, "a b"), (4, None)], "id long, t string")
    for exact in (False, True):
        s = S.signed(df.withColumn("d", F.concat(F.lit("+"), "t")), F.col("d"), F.col("t"), exact)
        pairs = {(x["a"], x["b"]): x["jaccard"] for x in S.minhash_pairs(s).collect()}
        assert set(pairs) == {(0, 1)} and pairs[0, 1] > 0.85
        assert {x["id"] for x in s.filter("mins is null and sim is null").collect()} == {3, 4}
    assert [x["hamming"] for x in S.simhash_pairs(spark.createDataFrame([(0, 7), (1, 7 ^ 1 << 40), (2, 7 ^ 0b1111111)], "id long, sim long")).orderBy("a", "b").collect()] == [1]


def test_bursts():
    assert math.exp(clusters.ln_poisson_tail(1, 1.0)) == pytest.approx(1 - math.exp(-1))
    scores = [clusters.burst_of(k) for k in range(30)]
    assert scores[:2] == [0.0, 0.0] and scores == sorted(scores) and scores[-1] < 1


def test_views_at_arrival(spark):
    style = {k: 1.0 for k in STYLE}
    rows = [(i, secs, f"r{i % 2}", a, *style.values()) for i, (secs, a) in enumerate([(0, "a"), (100, "b"), (30_000, "c"), (30_001, "d"), (15 * 86400, "e")])]
    m = spark.createDataFrame(rows, "id long, secs long, repo string, author string, " + ", ".join(f"{k} double" for k in STYLE))
    e = spark.createDataFrame([(0, 2), (1, 2), (2, 4)], "a long, b long")
    got = {x["id"]: (x["cluster"], x["size"], x["distinct_authors"], x["in_window"]) for x in clusters.views_at_arrival(m, e).collect()}
    # 0 and 1 are apart until 2 joins them; 3 is alone
    assert got == {0: (0, 1, 1, 1), 1: (1, 1, 1, 1), 2: (0, 3, 3, 1), 3: (3, 1, 1, 1), 4: (0, 4, 4, 1)}
    pruned = {x["id"]: x["size"] for x in clusters.views_at_arrival(m, e, clusters.TTL_SECS).collect()}
    assert pruned == {0: 1, 1: 1, 2: 3, 3: 1, 4: 1}


def test_scores_tiers_and_actions(spark):
    w = engine.Weights(-1.0, {"A": 2.0, "B": -1.0, "STYLE_AI_PHRASES": 3.0})
    fire = lambda *xs: [{"rule": r, "value": v} for r, v in xs]
    rows = [(0, fire(), None, None, False, False), (1, fire(("B", 1.0), ("A", 0.5), ("A", 0.5), ("Z", 1.0)), None, None, False, False), (2, fire(("A", 1.0), ("STYLE_AI_PHRASES", 1.0)), None, None, True, False), (3, fire(("A", 1.0), ("STYLE_AI_PHRASES", 1.0)), "welcome", None, False, False), (4, fire(), None, 0.2, False, True), (5, fire(), None, None, True, True)]
    df = spark.createDataFrame(rows, "id long, fires array<struct<rule:string,value:double>>, ai_policy string, threshold_label double, dry_run boolean, score_comments boolean")
    got = {r["id"]: r for r in engine.planned(engine.score(df, w)).collect()}
    assert [round(got[k]["score"], 9) for k in range(5)] == [-1, 0, 4, 1, -1]
    assert [got[k]["tier"] for k in range(6)] == ["pass", "label", "close", "hold", "label", "pass"]
    assert [e["rule"] for e in got[1]["evidence"]] == ["B", "A", "A", "Z"]
    assert [got[k]["action"] for k in range(6)] == ["none", "label", "label", "hold", "label", "comment"]
    assert "`close`" in got[2]["comment"] and got[3]["challenge"] and got[0]["comment"] is None and got[5]["comment"].startswith(engine.MARK)
    assert "| B | 1.00 | -1.00 | -1.00 |" in got[1]["comment"]
    with pytest.raises(ValueError):
        engine.Weights(0, {}, 0.9, 0.5, 0.95)
    o = df.withColumn("archetype", F.when(F.col("id") > 1, "mirror-no-prs"))
    assert [r["outcome"] for r in engine.outcome(o, F.col("id") == 2).orderBy("id").collect()][:4] == ["scored", "scored", "exempt", "close-by-policy"]


def test_dossier_facts(spark):
    node = lambda **k: {"state": "CLOSED", "merged": False, "title": "t", "createdAt": "2024-01-01T00:00:00Z", "labels": {"nodes": [{"name": "Spam"}]}, "reviews": {"totalCount": 0}, "comments": {"nodes": []}, "repository": {"nameWithOwner": "a/b"}, **k}
    say = lambda who, t: {"author": {"login": who}, "createdAt": t}
    nodes = [node(), node(createdAt="2025-06-02T00:00:00Z"), node(state="OPEN", labels={"nodes": []}, comments={"nodes": [say("you", "2024-01-02T00:00:00Z"), say("me", "2024-01-03T00:00:00Z")]}), node(merged=True, reviews={"totalCount": 2}, createdAt="?")]
    user = {"createdAt": "2025-05-01T12:00:00Z", "bio": " ", "followers": {"totalCount": 0}, "contributionsCollection": {"restrictedContributionsCount": 4}, "pullRequests": {"nodes": nodes}}
    rows = [(json.dumps({"data": {"user": user}}),), (json.dumps({"data": {"user": None}}),), ("nonsense",), (None,)]
    f = [r["f"] for r in spark.createDataFrame(rows, "j string").select(history.facts(F.col("j"), F.lit("me"), F.lit(dt.datetime(2025, 6, 1))).alias("f")).collect()]
    assert f[0]["account_age_days"] == 30 and not f[0]["has_bio"] and f[0]["restricted_contributions"] == 4 and f[0]["concurrent_open"] == 1
    assert [(p["closed_unmerged"], p["spam_labeled"], p["received_review"], p["author_followed_up"]) for p in f[0]["prior"]] == [(True, True, False, False), (False, False, True, True), (False, True, True, False)]
    assert all(x["prior"] == [] and x["account_age_days"] is None for x in f[1:])


def test_history_before_and_as_of(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4)], "who string, t long, id long")
    assert {r["id"]: r["n"] for r in history.before(df, "who", "t", n=F.lit(1)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    v = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "who string, t long, v double")
    assert {r["id"]: r["v"] for r in history.as_of(df, v, ["who"], "t", "v").collect()} == {1: None, 2: 10.0, 3: 10.0, 4: None}
    hours = spark.createDataFrame([("flat", h) for h in range(24) for _ in range(2)] + [("one", 3)] * 40 + [("few", 1)], "who string, h int")
    got = {r["who"]: r["entropy"] for r in history.hour_entropy(hours, ["who"], F.col("h")).collect()}
    assert got == {"flat": pytest.approx(1.0), "one": pytest.approx(0.0)}


def test_rank_statistics(spark):
    r = random.Random(2)
    rows = [(round(0.98 * r.random() ** (0.5 if y else 1), 2), y) for y in [True] * 60 + [False] * 300]
    df = spark.createDataFrame(rows, "s double, y boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert learn.auc(df, "s", F.col("y")).first()[0] == pytest.approx(want)
    ranked = sorted(neg, reverse=True)
    for row in learn.thresholds_at_fpr(df, "s", F.col("y"), (0.05, 0.01, 0.001)).collect():
        assert row["threshold"] == pytest.approx(min(ranked[int(row["target"] * len(neg))] + 1e-9, 1.0), abs=1e-12)
        assert sum(n >= row["threshold"] for n in neg) <= row["target"] * len(neg)
    low, high = evaluate.bootstrap_recall(df, "s", F.col("y"), rounds=300)
    cut = ranked[int(0.01 * len(neg))] + 1e-9
    assert low <= sum(p >= cut for p in pos) / len(pos) <= high
    assert learn.auc(df.filter("y"), "s", F.col("y")).first()[0] is None


def _examples(spark, n, noise=0.0, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        slop = k % 2 == 0
        tell = slop if r.random() >= noise else not slop
        rows.append((k, ([{"rule": "TELL", "value": 1.0}] if tell else []) + [{"rule": "NOISE", "value": r.random()}], slop, 1.0))
    return spark.createDataFrame(rows, "id long, fires array<struct<rule:string,value:double>>, is_slop boolean, sample_weight double")


def test_fit_and_guarded_promotion(spark):
    ex = _examples(spark, 400, 0.1)
    w = learn.fit(ex, ["NOISE", "TELL"])
    assert w.rules["TELL"] > 2 and 0 <= w.rules["NOISE"] < 1 and w.bias < 0
    flat = engine.Weights(0.0, {})
    got = learn.learn(ex, flat, ["NOISE", "TELL"])
    assert got["promoted"] and got["candidate_auc"] > 0.8 and got["weights"].label < got["weights"].hold < got["weights"].close
    assert learn.learn(_examples(spark, 50), flat, ["TELL"])["reason"] == "too few examples"
    assert learn.learn(ex.filter("is_slop or id < 50"), flat, ["TELL"])["reason"] == "too few of one class"
    noise = learn.learn(_examples(spark, 400, 0.5, 9), w, ["NOISE"])
    assert noise["promoted"] or noise["candidate_auc"] < noise["incumbent_auc"]


def test_fit_is_the_least_point(spark):
    r = np.random.default_rng(4)
    x = r.random((300, 3))
    y = (r.random(300) < 1 / (1 + np.exp(-(4 * x[:, 0] - 3 * x[:, 2] - 1)))).astype(float)
    w = 1.0 + 4 * (np.arange(300) % 7 == 0)
    rows = [(i, [{"rule": k, "value": float(v)} for k, v in zip("ABC", a)], bool(t), float(u)) for i, (a, t, u) in enumerate(zip(x, y, w))]
    ex = spark.createDataFrame(rows, "id long, fires array<struct<rule:string,value:double>>, is_slop boolean, sample_weight double")
    got = learn.fit(ex.repartition(3), list("ABC"))
    # the reference's gradient rounds, carried on until they stand still
    beta, bias = np.zeros(3), 0.0
    for _ in range(60_000):
        err = (1 / (1 + np.exp(-(bias + x @ beta))) - y) * w
        bias -= 0.5 * err.sum() / w.sum()
        beta = np.maximum(beta - 0.5 * (x.T @ err / w.sum() + 1e-3 * beta), 0.0)
    assert got.bias == pytest.approx(bias, abs=1e-4) and [got.rules[k] for k in "ABC"] == pytest.approx(beta.tolist(), abs=1e-4) and got.rules["C"] == 0.0
    assert learn.fit(ex.limit(0), ["A"]).rules == {"A": 0.0}


def test_newer_compares_instants():
    at = lambda t: engine.Weights(0.0, {}, meta={"fitted_at": t} if t else {})
    a, b, none = at("2026-08-10T01:00:00+02:00"), at("2026-08-09T23:30:00Z"), at(None)
    assert engine.newer(a, b) is b and engine.newer(b, a) is b and engine.newer(none, a) is a and engine.newer(a, none) is a and engine.newer(none, at("soon")) is none


def test_tokens(spark):
    docs = spark.createDataFrame([(k, ("click seamless synergy " if k % 2 else "segfault parser fix ") + f"word{k}", k % 2 == 1) for k in range(40)], "id long, text string, slop boolean")
    t = learn.token_llr(docs, F.col("slop"))
    llr = {r["token"]: r["llr"] for r in t.collect()}
    assert set(llr) == {"click", "seamless", "synergy", "segfault", "parser", "fix"} and llr["click"] == pytest.approx(math.log(21), abs=1e-9) if math.log(21) < 3 else llr["click"] == 3.0
    s = {r["id"]: r["token_score"] for r in learn.token_score(docs, t, "id").collect()}
    assert s[1] > 0.99 and s[0] < 0.01 and len(s) == 40
    assert learn.token_llr(docs.filter("slop"), F.col("slop")).count() == 0


def test_evaluation_helpers(spark):
    p = spark.createDataFrame([("x", None, None, 0.2, 1), ("x", None, None, 0.4, 2), (None, "a/b", 3, 0.9, 3)], "id string, repo string, number long, score double, n long")
    assert {r["id"]: r["score"] for r in evaluate.last_prediction(p, "n").collect()} == {"x": 0.4, "a/b#3": 0.9}
    with pytest.raises(Exception, match="out of range"):
        evaluate.last_prediction(p.withColumn("score", F.lit(1.5)), "n").collect()
    rec = spark.createDataFrame([("a/b", 1, "slop", 1500, True)], "repo string, number long, label string, repo_stars long, merged boolean")
    assert evaluate.release(rec).collect()[0].asDict() == {"repo": "a/b", "number": 1, "id": "a/b#1", "repo_stars_magnitude": 3}
    node = lambda at, repo, merged: {"createdAt": at, "merged": merged, "repository": {"nameWithOwner": repo}}
    dossier = json.dumps({"data": {"user": {"createdAt": "2019", "pullRequests": {"nodes": [node("2024-01-01T00:00:00Z", "A/b", True), node("2024-02-01T00:00:00Z", "c/d", True), node("2024-04-01T00:00:00Z", "a/b", True), node(None, "a/b", False)]}}}})
    rec = spark.createDataFrame([("a/b", 1, "slop", "x", "ann", "2024-03-01T00:00:00Z", dossier, "ai", "NONE"), ("a/b", 2, "ham", "agent-merged", "bob", None, None, None, "MEMBER")], "repo string, number long, label string, source string, author string, created_at string, dossier string, kind string, author_association string")
    a, b = evaluate.release(rec).orderBy("number").collect()
    assert not {"label", "kind", "author_association", "source"} & set(a.asDict())
    assert (a["first_pr_to_repo"], a["prior_prs_visible"], a["prior_prs_this_repo"], a["prior_merged_this_repo"]) == (False, 2, 1, 1) 
    left = json.loads(a["dossier"])["data"]["user"]["pullRequests"]["nodes"]
    assert [n["repository"]["nameWithOwner"] for n in left] == ["A/b", "c/d", "a/b"] and [n.get("merged") for n in left] == [None, True, None]
    assert (b["first_pr_to_repo"], b["prior_prs_visible"], b["dossier"]) == (True, 0, None)
    with pytest.raises(ValueError, match="ai-topic-merged"):
        evaluate.released_labels(rec)
    ids = spark.createDataFrame([("x",), ("y",)], "id string")
    with pytest.raises(ValueError, match="y"):
        evaluate.required(ids, ids.filter("id = 'x'").withColumn("score", F.lit(0.5)))
    assert evaluate.required(ids, ids.withColumn("score", F.lit(0.5))).count() == 2
    t = spark.createDataFrame([("a",), ("b",)], "repo string")
    assert [r[0] for r in evaluate.repo_disjoint(t, t.filter("repo = 'a'")).collect()] == ["b"]


def test_federation(spark):
    v = spark.createDataFrame([("h", "o1", 0.5, 9), ("h", "o1", 0.9, 9), ("h", "o2", 0.6, 9), ("h", "o3", 0.3, 9), ("g", "o1", 1.0, 9), ("g", "o2", 1.0, 9), ("g", "o3", 1.0, 1)], "author_hash string, owner string, strength double, expires long")
    got = federation.corroborated(v, F.lit(5)).collect()
    assert [(r["author_hash"], r["owners"], round(r["strength"], 9)) for r in got] == [("h", 3, 0.6)]


def test_challenge_settles(spark):
    c = spark.createDataFrame([("r", n, "ann", "CANARY-1", 100) for n in range(1, 7)], "repo string, number long, author string, canary string, posted long")
    say = "this fixes the broken parser"
    r = spark.createDataFrame([("r", 1, "ann", 200, say), ("r", 2, "ann", 200, say + " CANARY-1"), ("r", 3, "bob", 200, say), ("r", 4, "ann", 200, "ok"), ("r", 4, "ann", 300, say), ("r", 5, "ann", 100 + 72 * 3600, say), ("r", 6, "ann", 50, say)], "repo string, number long, author string, secs long, body string")
    state = lambda now: {x["number"]: x["state"] for x in federation.settle(c, r, F.lit(now)).collect()}
    assert state(1000) == {1: "passed", 2: "failed_canary", 3: "pending", 4: "passed", 5: "pending", 6: "pending"}
    assert [state(10**7)[k] for k in (3, 5, 6)] == ["failed_timeout"] * 3
