"""The rules: each is one nullable double expression over a change request's columns (see schemas.REQUEST).

Null means that a rule doesn't fire; 0.0 is a fire that is logged.  fires() melts
them into an array, in the order of the lanes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import code as code_lane
from gleaner.functions import diff as D
from gleaner.functions import lexicons as L
from gleaner.functions import text as X

Rules = dict[str, Column]


def hit(cond: Column) -> Column:
    return F.when(cond, F.lit(1.0))


def capped(value: Column, when: Column) -> Column:
    return F.when(when, F.least(value.cast("double"), F.lit(1.0)))


def policy_rules(protected: Sequence[str] = L.PROTECTED_PATHS) -> Rules:
    paths, body = F.col("paths"), F.col("body")
    some = F.size(paths) > 0
    low = lambda p: F.lower(p)
    empty = X.blank(body)
    return {
        "PROTECTED_PATH_ONLY": hit(F.col("author_association").isin("FIRST_TIME_CONTRIBUTOR", "NONE") & some & F.forall(paths, lambda p: X.path_matches(p, protected))),
        "DOCS_ONLY": hit(some & F.forall(paths, lambda p: low(p).endswith(".md") | low(p).startswith("docs/"))),
        "BODY_EMPTY": hit(empty),
        "TEMPLATE_IGNORED": hit(~empty & X.template_ignored(F.col("template"), body)),
    }


def shape_rules() -> Rules:
    """Of a measured() frame."""
    title, head, paths = F.trim("title"), F.col("head_ref"), F.col("paths")
    low, hidden, words = F.col("_low"), F.col("_hidden"), F.col("_words")
    web = X.title_is_web_default(title)
    span = (F.ln("additions") - math.log(2000)) / (math.log(50000) - math.log(2000))
    churn = F.col("additions") + F.col("deletions")
    begging, scaffold = F.col("_begging"), F.col("_scaffold")
    tested = F.exists(paths, lambda p: F.lower(p).rlike("test|spec"))
    return {
        "BRANCH_DRIVE_BY": hit(head.rlike(r"^(?:main|master|patch-[0-9]+)\z")),
        "TITLE_UPDATE_FILE": hit(web),
        "SINGLE_WEB_COMMIT": hit(web & (F.col("commit_count") == 1)),
        "TEMPLATE_UNFILLED": capped(hidden, hidden >= 0.6),
        "BODY_DIFF_MISMATCH": hit(X.contains_any(low, L.TEST_CLAIMS) & ~tested),
        "DIFF_ENORMOUS": capped(span, (F.col("additions") >= 2000) & ~X.mostly_unauthored(paths)),
        "BODY_TO_DIFF_RATIO": capped(words / churn / 100.0, (churn > 0) & (churn < 20) & (words > 150)),
        "BEGGING": capped(begging / 2.0, begging > 0),
        "USERNAME_PATTERN": hit(X.username_generated(F.col("author"))),
        "AGENT_BRANCH": hit(F.lower(head).rlike("^(?:" + "|".join(L.AGENT_BRANCHES) + ")[/-]")),
        "BODY_SCAFFOLD": capped(scaffold / 4.0, scaffold >= 2),
    }


def diff_rules() -> Rules:
    diff = F.col("diff")
    density, ls = D.comment_density(diff), D.code_lines(diff)
    return {
        "WHITESPACE_ONLY": hit(D.whitespace_only(diff)),
        "COMMENT_HEAVY": capped(density, density >= 0.35),
        "GROUNDING_MISS": hit(X.grounding_miss(F.col("body"), diff, F.col("paths"))),
        "AUTHORING_RATE": X.authoring_rate(F.col("commit_times"), F.col("additions")),
        "CODE_PLACEHOLDER": D.placeholder(ls),
        "CODE_COMMENT_RESTATE": D.comment_restate(ls),
        "CODE_GENERIC_IDENT": D.generic_ident(ls),
    }


def code_rules(values: str = "code_values") -> Rules:
    """From the struct that functions.code.code_rule_values gives."""
    return {r: F.col(f"{values}.{r}") for r in code_lane.RULES}


def cluster_rules() -> Rules:
    size, repos = F.col("size"), F.col("distinct_repos")
    crowd = (size >= 2) & (F.col("distinct_authors") >= 2)
    return {
        "CLUSTER_SIZE_LOG": capped(F.ln(size) / math.log(50), crowd),
        "CLUSTER_BURST": F.when(crowd, F.col("burst")),
        "CLUSTER_STYLE_COHESION": F.when(crowd & (F.col("style_cohesion") > 0.9), F.col("style_cohesion")),
        "CLUSTER_XREPO": capped((repos - 1) / 9.0, (size >= 2) & (repos >= 2)),
    }


def markers() -> dict[str, Column]:
    """Traces that agents leave: commit addresses, trailers and footer lines."""
    messages = F.col("commit_messages")
    # lines by a multi-line pattern: nothing is split
    trailer = "(?dm)^ *(?:co-authored-by:.*(?:" + "|".join(L.AGENT_TRAILERS) + ")|claude-session:)"
    foot = "(?dm)^ *(?:" + "|".join(X.literal(f) for f in L.FOOTERS) + ")"
    return {
        "agent_email": F.exists(F.col("commit_emails"), lambda e: F.lower(e).isin(*L.AGENT_EMAILS)),
        "agent_trailer": F.exists(messages, lambda m: F.lower(m).rlike(trailer)),
        "generation_footer": F.lower(F.coalesce("body", F.lit(""))).rlike(foot) | F.exists(messages, lambda m: F.lower(m).rlike(foot)),
    }


def dossier_rules() -> Rules:
    d = lambda name: F.col(f"dossier.{name}")
    prior = d("prior")
    total = F.size(prior)
    count = lambda f: F.size(F.filter(prior, f))
    reviewed = count(lambda p: p["received_review"])
    left = count(lambda p: p["received_review"] & ~p["author_followed_up"])
    spam = count(lambda p: p["spam_labeled"])
    titles = F.filter(F.transform(prior, lambda p: F.trim(p["title"])), lambda t: F.length(t) > 0)
    most = X.let(titles, lambda ts: F.array_max(F.transform(F.array_distinct(ts), lambda t: F.size(F.filter(ts, lambda u: u == t)))))
    spread = F.size(F.array_distinct(F.transform(prior, lambda p: p["repo_key"]))) / total
    secs, age = d("fork_to_pr_secs"), d("account_age_days")
    both = lambda name: F.coalesce(d(name), F.lit(False)) | F.col(f"_mark_{name}")
    return {
        "DOSSIER_ABANDONMENT": capped(left / reviewed, reviewed >= 3),
        "DOSSIER_CLOSED_RATIO": capped(count(lambda p: p["closed_unmerged"]) / total, total >= 5),
        "DOSSIER_SPAM_LABELS": capped(spam / 3.0, spam > 0),
        "AGENT_EMAIL": hit(both("agent_email")),
        "AGENT_TRAILER": hit(both("agent_trailer")),
        "GENERATION_FOOTER": hit(both("generation_footer")),
        "VELOCITY_FORK_TO_PR": capped(1.0 - secs / 3600.0, (secs >= 0) & (secs < 3600) & (F.col("additions") >= 50)),
        "REPLY_INSTANT": hit(d("median_reply_secs") < 60),
        "HOUR_ENTROPY_FLAT": capped(d("commit_hour_entropy"), d("commit_hour_entropy") > 0.97),
        "ACCOUNT_NEW": capped(1.0 / (1.0 + F.greatest(age, F.lit(0)) / 90.0), age < 365),
        "ACCOUNT_OPAQUE": hit(~d("has_bio") & (d("followers") == 0) & (d("restricted_contributions") > 0)),
        "DOSSIER_CONCURRENT_OPEN": capped((d("concurrent_open") - 2) / 8.0, d("concurrent_open") >= 3),
        "DOSSIER_TITLE_REPEAT": capped(most / total, (total >= 5) & (most >= 3)),
        "UNRELATED_SPREAD": capped(spread, (total >= 5) & (spread > 0.8)),
        "NETWORK_AUTHOR_VERDICT": capped(d("network_verdict"), d("network_verdict") > 0),
        "ACCOUNT_UNSEARCHABLE": hit(d("search_blocked")),
    }


def style_rules() -> Rules:
    """Of a measured() frame."""
    scale = {"STYLE_EM_DASH": ("em_dash", 2), "STYLE_UNICODE_PUNCT": ("unicode_punct", 2), "STYLE_EMOJI": ("emoji", 2), "STYLE_NONASCII": ("nonascii", 20), "STYLE_AI_PHRASES": ("ai_phrases", 3), "STYLE_STRUCTURE": ("structure", 1)}
    return {rule: capped(F.col(f"_style_{name}") / float(k), F.col(f"_style_{name}") > 0) for rule, (name, k) in scale.items()}


def policy_ai_rules() -> Rules:
    """Rules that a repository's policy on generated work adds; needs ai_policy."""
    m = F.lit(False)
    for name in ("agent_email", "agent_trailer", "generation_footer"):
        m = m | F.col(f"_mark_{name}") | F.coalesce(F.col(f"dossier.{name}"), F.lit(False))
    return {
        "UNDISCLOSED_AI": hit((F.col("ai_policy") == "disclose") & ~m & (F.col("detector_score") >= 0.7)),
        "AI_FORBIDDEN": hit((F.col("ai_policy") == "forbid") & m),
    }


def fires(df: DataFrame, rules: Mapping[str, Column], name: str = "fires") -> DataFrame:
    """df with the array of the rules that fire, as (rule, value).

    Values are columns of a projection of their own: each is used twice after it, so
    the optimizer doesn't fold the two, and each is computed once a row.
    """
    d = df.withColumns({f"_rule_{r}": v.cast("double") for r, v in rules.items()})
    values = [F.when(F.col(f"_rule_{r}").isNotNull(), F.struct(F.lit(r).alias("rule"), F.greatest(F.lit(0.0), F.col(f"_rule_{r}")).alias("value"))) for r in rules]
    return d.withColumn(name, F.filter(F.array(*values), lambda x: x.isNotNull())).drop(*[f"_rule_{r}" for r in rules])


def measured(df: DataFrame) -> DataFrame:
    """df with the measures that several rules or parts of a rule use, in a projection of their own."""
    prose = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    df = df.withColumns({"_low": F.lower("body"), "_prose": prose})
    low, both = F.col("_low"), [F.col("_low"), F.lower(F.trim("title"))]
    marks = {f"_mark_{k}": F.coalesce(v, F.lit(False)) for k, v in markers().items()} if {"commit_messages", "commit_emails"} <= set(df.columns) else {}
    return df.withColumns(
        {
            "_hidden": X.html_comment_fraction(F.col("body")),
            "_words": X.n_words(F.col("body")),
            "_begging": X.hits(both, L.BEGGING),
            "_scaffold": X.hits([low], L.SCAFFOLD),
            **{f"_style_{k}": v for k, v in X.style(F.col("_prose")).items()},
            **marks,
        }
    )


def exempt(users: Sequence[str] = L.EXEMPT_USERS, labels: Sequence[str] = ("triage-override",)) -> Column:
    low = lambda xs: [x.lower() for x in xs]
    return F.lower("author").isin(*low(users)) | F.coalesce(F.exists("labels", lambda x: F.lower(x).isin(*low(labels))), F.lit(False))


def all_rules(df: DataFrame) -> DataFrame:
    """df (schemas.REQUEST, with ai_policy and a cluster view's columns if it has them) with every rule's fires."""
    have, keep = set(df.columns), df.columns
    df = measured(df.withColumn("code_values", code_lane.code_rule_values("diff")))
    rules = policy_rules() | shape_rules() | diff_rules() | code_rules()
    if {"size", "distinct_repos", "distinct_authors", "burst", "style_cohesion"} <= have:
        rules |= cluster_rules()
    rules |= dossier_rules() | style_rules()
    if "token_score" in have:
        rules["BODY_TOKEN_SCORE"] = F.col("token_score")
    rules["DETECTOR_SCORE"] = F.col("detector_score")
    if "ai_policy" in have:
        rules |= policy_ai_rules()
    return fires(df, rules).select(*keep, "fires")
