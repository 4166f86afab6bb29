"""Webhook intake: signatures, parsing and the split into kinds; works on batches and streams alike."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schemas

SCORABLE = ("opened", "reopened", "synchronize", "ready_for_review")


def signed(secret: str):
    """Column function (body, signature): whether the signature is sha256=<HMAC of the body>."""

    @F.pandas_udf(T.BooleanType())
    def run(body: pd.Series, signature: pd.Series) -> pd.Series:
        def ok(b, s) -> bool:
            if not isinstance(b, str) or not isinstance(s, str):
                return False
            want = "sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest()
            return hmac.compare_digest(want.encode(), s.encode())

        return pd.Series([ok(b, s) for b, s in zip(body, signature)], dtype=bool)

    return run


def parsed(raw: DataFrame, body: str = "body", kind: str = "event") -> DataFrame:
    """raw with kind (pull_request, comment, ping, ignored or bad) and the event's columns; missing texts are ''."""
    j = F.from_json(F.col(body), schemas.WEBHOOK)
    d = raw.withColumn("_j", j).withColumn("_ok", F.coalesce(F.get_json_object(body, "$").isNotNull(), F.lit(False)))
    text = lambda c: F.coalesce(c, F.lit(""))
    num = lambda c: F.coalesce(c, F.lit(0))
    p, c = F.col("_j.pull_request"), F.col("_j.comment")
    what = (
        F.when(~F.col("_ok"), "bad")
        .when(F.col(kind) == "ping", "ping")
        .when((F.col(kind) == "pull_request") & p.isNotNull(), "pull_request")
        .when((F.col(kind) == "issue_comment") & (F.col("_j.action") == "created"), "comment")
        .otherwise("ignored")
    )
    return d.select(
        *raw.columns,
        what.alias("kind"),
        text(F.col("_j.action")).alias("action"),
        text(F.col("_j.repository.full_name")).alias("repo"),
        num(F.coalesce(p["number"], F.col("_j.issue.number"))).alias("number"),
        text(F.coalesce(p["user"]["login"], c["user"]["login"])).alias("author"),
        text(p["title"]).alias("title"),
        text(F.coalesce(p["body"], c["body"])).alias("text"),
        num(p["additions"]).alias("additions"),
        num(p["deletions"]).alias("deletions"),
        num(p["changed_files"]).alias("changed_files"),
        num(p["commits"]).alias("commit_count"),
        text(p["author_association"]).alias("author_association"),
        F.coalesce(p["head"]["repo"]["fork"], F.lit(False)).alias("head_is_fork"),
        text(p["head"]["ref"]).alias("head_ref"),
        text(p["node_id"]).alias("node_id"),
        F.transform(F.coalesce(p["labels"], F.array()), lambda x: x["name"]).alias("labels"),
        F.col("_j.issue.pull_request").isNotNull().alias("on_pull_request"),
    )


def scorable() -> Column:
    return (F.col("kind") == "pull_request") & F.col("action").isin(*SCORABLE)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The landing folder of deliveries as a stream of (event, signature, body, received)."""
    return spark.readStream.schema("event string, signature string, body string, received timestamp").json(path)
