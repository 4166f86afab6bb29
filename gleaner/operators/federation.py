"""Verdicts that installations share, and the challenge's texts and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.hashing import fnv1a64

OWNERS, LEAST_WORDS, TIMEOUT_SECS = 3, 5, 72 * 3600


def author_hash(login: Column, salt: str) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lower(login), F.lit(salt)), 256)


def evidence_hash(evidence: Column) -> Column:
    return F.sha2(F.to_json(evidence), 256)


def corroborated(verdicts: DataFrame, now: Column, least: int = OWNERS) -> DataFrame:
    """(author_hash, owners, strength): the mean over owners of each one's greatest unexpired strength, if as many agree."""
    own = verdicts.filter(F.col("expires") > now).groupBy("author_hash", "owner").agg(F.greatest(F.max("strength"), F.lit(0.0)).alias("s"))
    return own.groupBy("author_hash").agg(F.count("*").alias("owners"), F.least(F.avg("s"), F.lit(1.0)).alias("strength")).filter(F.col("owners") >= least)


def canary(repo: Column, number: Column, salt: str) -> Column:
    """CANARY- and the FNV-1a of salt, repository and number, in hex."""
    return F.concat(F.lit("CANARY-"), F.lpad(F.hex(fnv1a64(F.concat_ws("\u001f", F.lit(salt), repo, number.cast("string")))), 16, "0"))


def reply_state(state: Column, canary_col: Column, reply: Column) -> Column:
    """What a reply makes of a challenge: a canary fails it, five words pass it; settled states stay."""
    words = F.regexp_count(reply, F.lit(r"\S+"))
    return F.when(state != "pending", state).when(F.contains(reply, canary_col), "failed_canary").when(words >= LEAST_WORDS, "passed").otherwise("pending")


def timeout_state(state: Column, posted: Column, now: Column) -> Column:
    return F.when((state == "pending") & (now - posted >= TIMEOUT_SECS), "failed_timeout").otherwise(state)


def settle(challenges: DataFrame, replies: DataFrame, now: Column) -> DataFrame:
    """(repo, number, state) of challenges (repo, number, author, canary, posted) after the author's replies (repo, number, author, secs, body).

    The first reply of the author's that decides settles it, unless 72 hours had
    passed; replies of others and from before the challenge don't count.
    """
    r = replies.select(F.col("repo").alias("r_repo"), F.col("number").alias("r_number"), F.col("author").alias("r_author"), "secs", "body")
    j = challenges.join(r, (F.col("repo") == F.col("r_repo")) & (F.col("number") == F.col("r_number")) & (F.col("author") == F.col("r_author")) & (F.col("secs") >= F.col("posted")) & (F.col("secs") < F.col("posted") + TIMEOUT_SECS), "left")
    s = reply_state(F.lit("pending"), F.col("canary"), F.col("body"))
    j = j.withColumn("s", F.when(F.col("body").isNotNull(), s)).groupBy("repo", "number", "canary", "posted").agg(F.min_by(F.when(F.col("s") != "pending", F.col("s")), F.when(F.col("s") != "pending", F.col("secs"))).alias("s"))
    return j.select("repo", "number", timeout_state(F.coalesce("s", F.lit("pending")), F.col("posted"), now).alias("state"))
