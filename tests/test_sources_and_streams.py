"""Webhook intake, files, the store and the stateful streams."""

import datetime as dt
import hashlib
import hmac
import json
import os

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gleaner.operators import clusters, engine, rules
from gleaner.operators import signatures as S
from gleaner.sources import corpus, events, store
from gleaner.streaming import challenge
from gleaner.streaming import clusters as stream_clusters


def test_signed_and_parsed(spark):
    pr = {"action": "opened", "repository": {"full_name": "a/b"}, "pull_request": {"number": 5, "title": "T", "body": None, "additions": 3, "user": {"login": "ann"}, "head": {"ref": "x", "repo": None}, "labels": [{"name": "bug"}]}}
    comment = {"action": "created", "repository": {"full_name": "a/b"}, "issue": {"number": 6, "pull_request": {"url": "u"}}, "comment": {"user": {"login": "bob"}, "body": "hi"}}
    rows = [("pull_request", json.dumps(pr)), ("issue_comment", json.dumps(comment)), ("issue_comment", json.dumps(comment | {"action": "edited"})), ("ping", "{}"), ("push", "{}"), ("pull_request", "{oops")]
    sign = lambda b: "sha256=" + hmac.new(b"key", b.encode(), hashlib.sha256).hexdigest()
    raw = spark.createDataFrame([(i, e, b, sign(b)) for i, (e, b) in enumerate(rows)] + [(9, "ping", "{}", "sha256=00"), (10, "ping", "{}", None)], "i long, event string, body string, signature string")
    ok = {r["i"]: r["ok"] for r in raw.select("i", events.signed("key")("body", "signature").alias("ok")).collect()}
    assert ok == {**dict.fromkeys(range(6), True), 9: False, 10: False}
    got = {r["i"]: r for r in events.parsed(raw).collect()}
    assert [got[i]["kind"] for i in range(6)] == ["pull_request", "comment", "ignored", "ping", "ignored", "bad"]
    assert (got[0]["number"], got[0]["author"], got[0]["text"], got[0]["labels"], got[0]["head_is_fork"]) == (5, "ann", "", ["bug"], False)
    assert (got[1]["number"], got[1]["author"], got[1]["text"], got[1]["on_pull_request"]) == (6, "bob", "hi", True)
    assert [r["i"] for r in events.parsed(raw).filter(events.scorable()).collect()] == [0]


def test_files(spark, tmp_path):
    (tmp_path / "slop.jsonl").write_text('{"repo":"a/b","number":1,"title":"t","commits":[{"message":"m"}]}\nnot json\n')
    (tmp_path / "ham.jsonl").write_text('{"repo":"a/b","number":2}\n')
    good, bad = corpus.corpus(spark, str(tmp_path / "slop.jsonl"), str(tmp_path / "ham.jsonl"))
    assert {(r["number"], r["is_slop"]) for r in good.collect()} == {(1, True), (2, False)} and [r["line"] for r in bad.collect()] == ["not json"]
    d = spark.createDataFrame([("a/b#1", 0.8)], "id string, probability double")
    assert {r["number"]: r["detector_score"] for r in corpus.with_detector(good, d).collect()} == {1: 0.8, 2: None}
    old = spark.createDataFrame([("r", 1, 0, "m0", None), ("r", 1, 1, "m1", None), ("r", 1, 2, "m2", "kept")], "repo string, number long, pos int, message string, date string")
    new = spark.createDataFrame([("r", 1, 0, "m1", "d1"), ("r", 1, 1, "zz", "d2")], "repo string, number long, pos int, message string, date string")
    assert [r["date"] for r in corpus.backfill(old, new).orderBy("pos").collect()] == ["d1", "d1", "kept"]


def test_store(spark, tmp_path):
    schema = "repo string, number long, v string, at long"
    path = str(tmp_path / "t")
    store.append(spark.createDataFrame([("r", 1, "a", 1), ("r", 2, "b", 1)], schema), path)
    got = store.merge(spark, path, spark.createDataFrame([("r", 1, "c", 2)], schema), ["repo", "number"], "at")
    assert {(r["number"], r["v"]) for r in got.collect()} == {(1, "c"), (2, "b")}
    w = spark.createDataFrame([(1, "x"), (3, "z"), (2, "y")], "version long, w string")
    assert store.active_weights(w).first()["w"] == "z"
    now = dt.datetime(2025, 1, 8)
    f = spark.createDataFrame([(dt.datetime(2025, 1, 1), 1), (dt.datetime(2025, 1, 1, 0, 0, 1), 2)], "fetched_at timestamp, id long")
    assert [r["id"] for r in store.fresh(f, F.lit(now)).collect()] == [2]


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_challenge_stream(spark, tmp_path):
    say = "this fixes the broken parser"
    t0 = dt.datetime(2025, 1, 1)
    secs = lambda h: int((t0 - dt.datetime(1970, 1, 1)).total_seconds()) + h * 3600
    first = [("r", n, "posted", "ann", "CANARY-1", secs(0)) for n in (1, 2, 3)] + [("r", 1, "reply", "bob", say, secs(1)), ("r", 1, "reply", "ann", say, secs(2)), ("r", 2, "reply", "ann", say + " CANARY-1", secs(2))]
    later = [("r", 9, "posted", "zoe", "CANARY-9", secs(100))]
    last = [("r", 9, "reply", "zoe", say, secs(101)), ("r", 3, "reply", "ann", say, secs(101))]
    src = tmp_path / "in"
    src.mkdir()
    for k, rows in enumerate((first, later, last)):
        pd.DataFrame(rows, columns=["repo", "number", "kind", "author", "body", "secs"]).to_json(src / f"{k}.json", orient="records", lines=True)
    e = spark.readStream.schema("repo string, number long, kind string, author string, body string, secs long").option("maxFilesPerTrigger", 1).json(str(src))
    _run(challenge.challenges(e.withColumn("ts", F.timestamp_seconds("secs"))), "settled")
    got = {}
    for r in spark.table("settled").collect():
        got.setdefault(r["number"], []).append(r["state"])
    assert got[1] == ["pending", "passed"] and got[2] == ["pending", "failed_canary"] and got[3] == ["pending", "failed_timeout"] and got[9] == ["pending", "passed"]


def test_cluster_stream_equals_batch(spark, tmp_path):
    base = " ".join(f"word{k}" for k in range(120))
    texts = [base, base + " tail", "quite another text " + " ".join(f"x{k}" for k in range(90)), base.replace("word7 ", "seven ")]
    rows = [(k, "r", f"a{k}", k * 600, t) for k, t in enumerate(texts)]
    s = S.signed(spark.createDataFrame(rows, "id long, repo string, author string, secs long, t string").withColumn("d", F.concat(F.lit("+"), "t")), F.col("d"), F.col("t")).select("repo", "id", "author", "secs", "sim", "mins").withColumns({k: F.lit(1.0) for k in clusters.STYLE})
    path = str(tmp_path / "arrivals")
    s.coalesce(1).write.parquet(path)
    _run(stream_clusters.clusters(spark.readStream.schema(s.schema).parquet(path)), "clustered")
    got = {r["id"]: (r["size"], r["distinct_authors"], r["in_window"]) for r in spark.table("clustered").collect()}
    m = s
    want = {r["id"]: (r["size"], r["distinct_authors"], r["in_window"]) for r in clusters.views_at_arrival(m, S.edges(s)).collect()}
    assert got == want == {0: (1, 1, 1), 1: (2, 2, 2), 2: (1, 1, 1), 3: (3, 3, 3)}


def test_scored_stream_equals_batch(spark, tmp_path):
    """Views, scores and tiers of each arrival over several micro-batches, with lapsed members, a request that comes again and new weights."""
    base, other = " ".join(f"word{k}" for k in range(120)), " ".join(f"x{k}" for k in range(90))
    day = 86400
    rows = [(0, "r", "a", 0, base), (1, "r", "b", 600, base + " tail"), (2, "q", "c", 700, base), (3, "r", "c", 800, other), (4, "r", "a", 7 * day, base.replace("word7 ", "seven ")), (5, "r", "d", 15 * day, base + " end"), (6, "r", "e", 40 * day, base), (7, "r", "e", 40 * day + 60, base)]
    d = spark.createDataFrame(rows, "id long, repo string, author string, secs long, t string")
    style = {k: (F.col("id") % (j + 2) + 1).cast("double") for j, k in enumerate(clusters.STYLE)}
    s = S.signed(d.withColumn("d", F.concat(F.lit("+"), "t")), F.col("d"), F.col("t")).withColumns(style)
    s = s.withColumn("fires", F.array(F.struct(F.lit("DOCS_ONLY").alias("rule"), (F.col("id") / 10).alias("value")))).drop("t", "d")
    path = tmp_path / "arrivals"
    data = s.orderBy("secs").toArrow()
    for k in range(0, 8, 2):
        path.mkdir(exist_ok=True)
        pq.write_table(data.slice(k, 2), path / f"{k}.parquet")
        os.utime(path / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    weights = [engine.Weights(-1.0, {"DOCS_ONLY": 1.0, "CLUSTER_SIZE_LOG": 2.0, "CLUSTER_BURST": 3.0}), engine.Weights(0.5, {"CLUSTER_STYLE_COHESION": 1.0})]
    got, asked = {}, []

    def current():
        asked.append(1)
        return weights[len(asked) > 2]

    arrivals = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = stream_clusters.verdicts(arrivals, current, lambda df, k: got.update({r["id"]: r for r in df.collect()})).trigger(availableNow=True).start()
    q.awaitTermination(200)
    q.stop()
    assert len(asked) == 4 and len(got) == 8
    e = S.edges(s.select("id", "sim", "mins", "repo"), scope="repo")
    v = clusters.views_at_arrival(s, e, clusters.TTL_SECS).withColumn("burst", clusters.burst_score()(F.col("in_window")))
    v = rules.fires(v, rules.cluster_rules(), "more").join(s.select("id", "fires"), "id").withColumn("fires", F.concat("fires", "more"))
    for k, w in enumerate(weights):
        for r in engine.planned(engine.score(v, w)).collect():
            if (r["id"] >= 4) == bool(k):
                g = got[r["id"]]
                assert (g["size"], g["distinct_authors"], g["in_window"], g["tier"], g["action"]) == (r["size"], r["distinct_authors"], r["in_window"], r["tier"], r["action"]), r["id"]
                assert abs(g["score"] - r["score"]) < 1e-9
    assert [got[i]["size"] for i in range(8)] == [1, 2, 1, 1, 3, 2, 1, 2]
