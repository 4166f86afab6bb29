"""Author history: the parsed dossier, conditional ratios, point-in-time counts, hours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import lexicons as L

LEAST_HOURS = 30


def facts(json: Column, login: Column, now: Column) -> Column:
    """The dossier's facts as a struct (schemas.FACTS) from the code host's JSON; only history before now counts.

    A history entry without a readable time counts.  A missing user gives no facts
    but an empty history.
    """
    user = F.from_json(json, schemas.DOSSIER_JSON)["data"]["user"]
    time = lambda s: F.try_to_timestamp(s)
    nodes = F.filter(F.coalesce(user["pullRequests"]["nodes"], F.array()), lambda n: ~F.coalesce(time(n["createdAt"]) >= now, F.lit(False)))

    def prior(n: Column) -> Column:
        comments = F.coalesce(n["comments"]["nodes"], F.array())
        own = lambda c: F.coalesce(c["author"]["login"], F.lit("")) == login
        first = F.array_min(F.transform(F.filter(comments, lambda c: ~own(c)), lambda c: time(c["createdAt"])))
        labels = F.transform(F.coalesce(n["labels"]["nodes"], F.array()), lambda x: F.lower(x["name"]))
        merged = F.coalesce(n["merged"], F.lit(False))
        return F.struct(
            merged.alias("merged"),
            ((F.coalesce(n["state"], F.lit("")) == "CLOSED") & ~merged).alias("closed_unmerged"),
            F.exists(labels, lambda x: F.coalesce(x.isin(*L.SPAM_LABELS), F.lit(False))).alias("spam_labeled"),
            ((F.coalesce(n["reviews"]["totalCount"], F.lit(0)) > 0) | F.exists(comments, lambda c: ~own(c))).alias("received_review"),
            F.exists(comments, lambda c: own(c) & F.coalesce(time(c["createdAt"]) > first, F.lit(False))).alias("author_followed_up"),
            F.coalesce(n["repository"]["nameWithOwner"], F.lit("")).alias("repo_key"),
            F.coalesce(n["title"], F.lit("")).alias("title"),
        )

    age = F.floor((F.unix_seconds(now) - F.unix_seconds(time(user["createdAt"]))) / 86400)
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        age.alias("account_age_days"),
        F.coalesce(F.length(F.trim(user["bio"])) > 0, F.lit(False)).alias("has_bio"),
        F.coalesce(user["followers"]["totalCount"], F.lit(0)).alias("followers"),
        F.coalesce(user["contributionsCollection"]["restrictedContributionsCount"], F.lit(0)).alias("restricted_contributions"),
        F.transform(nodes, prior).alias("prior"),
        null("long").alias("fork_to_pr_secs"),
        null("long").alias("median_reply_secs"),
        null("double").alias("commit_hour_entropy"),
        F.lit(False).alias("agent_email"),
        F.lit(False).alias("agent_trailer"),
        F.lit(False).alias("generation_footer"),
        F.size(F.filter(nodes, lambda n: n["state"] == "OPEN")).cast("long").alias("concurrent_open"),
        F.lit(0.0).alias("network_verdict"),
        F.lit(False).alias("search_blocked"),
    )


def author_ratios(prior: DataFrame, author: str, closed: Column, merged: Column, repo: str) -> DataFrame:
    """(author, total, closed_ratio, merged_ratio, distinct_repos, spread), ratios null under five entries; one aggregation."""
    total = F.count("*")
    ratio = lambda x: F.when(total >= 5, x / total)
    return prior.groupBy(author).agg(
        total.alias("total"),
        ratio(F.count_if(closed)).alias("closed_ratio"),
        ratio(F.count_if(merged)).alias("merged_ratio"),
        F.count_distinct(repo).alias("distinct_repos"),
        ratio(F.count_distinct(repo)).alias("spread"),
    )


def title_repeat(prior: DataFrame, author: str, title: str) -> DataFrame:
    """(author, total, most): how often an author's commonest title that isn't blank occurs; two levels of grouping, so no author's titles are gathered."""
    per = prior.groupBy(author, F.trim(title).alias("t")).agg(F.count("*").alias("n"))
    return per.groupBy(author).agg(F.sum("n").alias("total"), F.coalesce(F.max(F.when(F.length("t") > 0, F.col("n"))), F.lit(0)).alias("most"))


def before(df: DataFrame, author: str, micros: str, **counted: Column) -> DataFrame:
    """df with counts over the author's rows that came strictly before each; one shuffle on the author, no self-join."""
    w = Window.partitionBy(author).orderBy(micros).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: F.coalesce(F.sum(c.cast("long")).over(w), F.lit(0)) for name, c in counted.items()})


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """left with the latest value of right strictly before its time; both sides are sorted once in a union, so skew splits like any window."""
    side = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(*keys, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    # equal times: the left row comes first, so it doesn't see that one
    w = Window.partitionBy(*keys).orderBy(F.col(time), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = side.unionByName(other, allowMissingColumns=True).withColumn(value, F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_side", "_v")


def hour_entropy(df: DataFrame, keys: list[str], hour: Column) -> DataFrame:
    """(keys, n, entropy) of the hours of day over log2 24, for groups of thirty at least."""
    per = df.groupBy(*keys, hour.alias("hour")).agg(F.count("*").alias("c"))
    n = F.sum("c")
    # -sum p log2 p = log2 n - sum c log2 c / n
    e = (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n) / math.log2(24)
    return per.groupBy(*keys).agg(n.alias("n"), e.alias("entropy")).filter(F.col("n") >= LEAST_HOURS)


def median_gap(df: DataFrame, keys: list[str], secs: str, least: int = 5) -> DataFrame:
    """(keys, median) of the seconds between a group's rows, if there are as many gaps as least."""
    gap = df.withColumn("gap", F.col(secs) - F.lag(secs).over(Window.partitionBy(*keys).orderBy(secs))).filter("gap is not null")
    return gap.groupBy(*keys).agg(F.count("*").alias("n"), F.median("gap").alias("median")).filter(F.col("n") >= least).drop("n")
