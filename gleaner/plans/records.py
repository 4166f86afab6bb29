"""Documents as change requests with all that the rules look at: every rule fires in some of them.

What the documents don't have (paths, branches, diffs, commits, the author's history, a
cluster's view) follows from doc_id.  The columns are expressions that Spark and DuckDB
read alike, so the oracles see the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import lexicons as L
from gleaner.operators import rules
from gleaner.operators.engine import default_weights
from gleaner.session import spread

WEIGHTS = default_weights()

_HEAD = "diff --git a/src/app.py b/src/app.py\n--- a/src/app.py\n+++ b/src/app.py\n@@ -1 +1 @@\n"
#: a module in which each of the code lanes finds something
_MODULE = """class Loader:
    def loadFirst(self, sourceName):
        \"\"\"Loads the first. :param sourceName: where from\"\"\"
        firstValue = readAll(sourceName, 4711)
        firstValue = dropEmpty(firstValue, 4711)
        firstValue = sortRows(firstValue, 4711)
        firstValue = joinNames(firstValue)
        firstValue = groupDays(firstValue)
        firstValue = fillGaps(firstValue)
        saveRows(firstValue, "http://localhost:8080/first")
        return firstValue
    def loadSecond(self, sourceName):
        \"\"\"Loads the second. :param sourceName: where from\"\"\"
        firstValue = readAll(sourceName, 4711)
        firstValue = dropEmpty(firstValue, 4711)
        firstValue = sortRows(firstValue, 4711)
        firstValue = joinNames(firstValue)
        firstValue = groupDays(firstValue)
        firstValue = fillGaps(firstValue)
        saveRows(firstValue, "http://localhost:8080/first")
        return firstValue
    def forgottenHelper(self, otherName):
        \"\"\"Opens and closes. :param otherName: what\"\"\"
        try:
            openDoor(otherName, 4711)
        except Exception:
            pass
        try:
            closeDoor(otherName, 4711)
        except Exception:
            pass
        return loadSecond(otherName)
    def unusedHelper(self, otherName):
        timeout = 4711
        return loadFirst(otherName)
"""
_OLD = "\n".join(f" old_value_{k} = old_call_{k}(some_name)" for k in range(10)) + "\n"
_added = lambda lines: _HEAD + "".join(f"+{x}\n" for x in lines)
#: diffs by doc_id % 16; the others are the document's text in one line
DIFFS = {
    0: _HEAD + _OLD + "".join(f"+{x}\n" for x in _MODULE.splitlines()),
    1: _added(["   ", "", "\t"]),
    2: _added(["# first remark", "# second remark", "// third", "-- fourth", "* fifth", "/* sixth", "open_door()", "close_door()", "walk_out()", "sit_down()"]),
    3: _added(["def later():", "raise NotImplementedError", "one()", "two()", "# your code here", "three()", "four()", "five()"]),
    4: _added(["# open garden door", "open_garden_door()", "# close kitchen window", "close_kitchen_window()", "one()", "two()", "three()", "four()"]),
    5: _added(["data = get_value(item)", "result = process_data(data)", "output = handle_item(result)", "temp = get_info(output)", "items = set_values(temp)", "obj = my_helper(items)", "res = do_stuff(obj)", "thing = util_wrapper(res)"]),
}
#: what the code lanes find in DIFFS[0] (tests hold a slow version of each against it) and the other diff rules in the rest
FOUND = {
    0: {
        "CODE_DUP_BLOCK": 2 * 5 / 31,
        "CODE_DUP_FUNC": 1 / 3,
        "CODE_MAGIC_NUMBER": 2 * 9 / 35,
        "CODE_REPEAT_LITERAL": 1 / 3,
        "CODE_HARDCODED_CONFIG": 3 / 4,
        "CODE_BLANKET_CATCH": 1.0,
        "CODE_DOC_SCAFFOLD": 3 / 4,
        "CODE_DEAD_HELPER": 2 / 3,
        "CODE_STYLE_DRIFT": 1.0,
    },
    1: {"WHITESPACE_ONLY": 1.0},
    2: {"COMMENT_HEAVY": 0.6},
    3: {"CODE_PLACEHOLDER": 2 / 3},
    4: {"CODE_COMMENT_RESTATE": 0.5},
    5: {"CODE_GENERIC_IDENT": 1.0},
}


def _quoted(text: str, spark: bool) -> str:
    # line breaks and tabs as chr(): both dialects read what is left alike
    parts = text.replace("'", "''" if not spark else "\\'").split("\n")
    return " || chr(10) || ".join("'" + p.replace("\t", "' || chr(9) || '") + "'" for p in parts)


def columns(spark: bool) -> list[str]:
    """The columns from documents in Spark's or DuckDB's dialect."""
    arr = (lambda *x: f"array({', '.join(x)})") if spark else (lambda *x: f"[{', '.join(x)}]")
    m = lambda n, k: f"doc_id % {n} = {k}"
    t = "coalesce(text, '')"
    tail = " || ".join(
        f"CASE WHEN {when} THEN {said} ELSE '' END"
        for when, said in (
            (m(11, 5), "chr(10) || 'I added tests and unit tests included.'"),
            (m(17, 7), "chr(10) || 'Furthermore, this PR introduces a seamless \u2014 comprehensive flow\u2026 \U0001f389 let me know if \u201cit\u201d works'"),
            (m(19, 8), "chr(10) || '- one' || chr(10) || '# two' || chr(10) || '* three'"),
            (m(29, 9), "chr(10) || 'It uses `foo_bar()` and `src/baz_qux` now.'"),
            (m(31, 10), "chr(10) || 'Generated with Cursor'"),
        )
    )
    diff = "CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN {_quoted(d, spark)}" for k, d in DIFFS.items()) + f" ELSE '+++ b/notes/a.md' || chr(10) || '+' || replace({t}, chr(10), ' ') END"
    return [
        "doc_id",
        "coalesce(source, '') AS repo",
        "doc_id AS number",
        "CASE WHEN doc_id % 5 = 0 THEN 'dev' || doc_id ELSE 'writer-' || coalesce(lang, '') END AS author",
        f"CASE doc_id % 7 WHEN 1 THEN 'Update readme.md' WHEN 2 THEN 'Please merge: ' || substr({t}, 1, 40) ELSE substr({t}, 1, 60) END AS title",
        f"CASE doc_id % 23 WHEN 3 THEN '' WHEN 4 THEN '<!-- ' || {t} || ' -->' WHEN 6 THEN '## Summary' || chr(10) || {t} || chr(10) || '## Test plan' || chr(10) || '- [x] done' ELSE {t} || {tail} END AS body",
        "CASE doc_id % 10 WHEN 0 THEN 2000 + doc_id * 37 % 50000 WHEN 1 THEN 5 ELSE coalesce(n_chars, 0) END AS additions",
        "doc_id % 7 AS deletions",
        "1 + doc_id % 3 AS commit_count",
        "CASE doc_id % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'CONTRIBUTOR' ELSE 'FIRST_TIME_CONTRIBUTOR' END AS author_association",
        "CASE doc_id % 9 WHEN 0 THEN 'main' WHEN 1 THEN 'patch-3' WHEN 2 THEN 'codex/fix' WHEN 3 THEN 'Claude-fix' ELSE 'topic/x' END AS head_ref",
        f"{diff} AS diff",
        f"CASE doc_id % 8 WHEN 0 THEN {arr(repr('README.md'))} WHEN 1 THEN {arr(repr('docs/a/b.txt'))} WHEN 2 THEN {arr(repr('src/a.py'), repr('tests/test_a.py'))} WHEN 3 THEN {arr(repr('vendor/a.js'), repr('x.lock'))} ELSE {arr(repr('src/a.py'), repr('src/b.py'))} END AS paths",
        f"{arr(f'CASE WHEN {m(47, 5)} THEN {L.AGENT_EMAILS[0]!r} ELSE {'a@b.example'!r} END')} AS commit_emails",
        f"{arr(f'CASE WHEN {m(53, 6)} THEN {"Fix it"!r} || chr(10) || chr(10) || {"Co-authored-by: Codex <c>"!r} ELSE {"Fix it"!r} END')} AS commit_messages",
        f"{arr('CAST(0 AS BIGINT)', 'doc_id % 50 * 60')} AS commit_times",
        "CASE WHEN doc_id % 2 = 0 THEN '# Summary' || chr(10) || '# Testing' END AS template",
        "CASE WHEN doc_id % 6 = 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100 END AS detector_score",
        "CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 100 AS DOUBLE) / 100 END AS token_score",
        "CASE doc_id % 5 WHEN 0 THEN 'welcome' WHEN 1 THEN 'disclose' WHEN 2 THEN 'forbid' END AS ai_policy",
        "1 + doc_id % 12 AS size",
        "1 + doc_id % 4 AS distinct_repos",
        "1 + doc_id % 3 AS distinct_authors",
        "CAST(doc_id % 10 AS DOUBLE) / 10 AS burst",
        "0.85 + CAST(doc_id % 15 AS DOUBLE) / 100 AS style_cohesion".replace("0.85", "CAST(0.85 AS DOUBLE)"),
    ]


def _dossier():
    i = F.col("doc_id")
    prior = F.transform(
        F.slice(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long")), 1, (i % 10).cast("int")),
        lambda k: F.struct(
            F.lit(False).alias("merged"),
            ((i + k) % 3 == 0).alias("closed_unmerged"),
            ((i + k) % 11 == 0).alias("spam_labeled"),
            ((i + k) % 2 == 0).alias("received_review"),
            ((i + k) % 4 == 0).alias("author_followed_up"),
            F.concat(F.lit("r"), (i * k % 7).cast("string")).alias("repo_key"),
            F.concat(F.lit(" t"), ((i + k) % 3).cast("string")).alias("title"),
        ),
    )
    return F.struct(
        (i % 700).alias("account_age_days"),
        (i % 2 == 0).alias("has_bio"),
        (i % 3).alias("followers"),
        (i % 5).alias("restricted_contributions"),
        prior.alias("prior"),
        (i * 37 % 7200).alias("fork_to_pr_secs"),
        (i * 13 % 300).alias("median_reply_secs"),
        ((i % 100).cast("double") / 100).alias("commit_hour_entropy"),
        (i % 43 == 1).alias("agent_email"),
        (i % 43 == 2).alias("agent_trailer"),
        (i % 43 == 3).alias("generation_footer"),
        (i % 8).alias("concurrent_open"),
        F.when(i % 29 == 2, F.lit(0.7)).alias("network_verdict"),
        (i % 31 == 3).alias("search_blocked"),
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")).selectExpr(*columns(True)).withColumn("dossier", _dossier())


def fired(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, repo, ai_policy, fires): the records with all rules' fires."""
    return rules.all_rules(records(spark, d)).select("doc_id", "repo", "ai_policy", "fires")


# --- the same in SQL ------------------------------------------------------------

_q = lambda s: s.replace("'", "''")
_SPACED = r"[^\s\p{Z}\x{85}]+"
_DIFF_RULES = [(k, r, v) for k, found in FOUND.items() for r, v in found.items()]
_N = "(doc_id % 10)"
_count = lambda cond: f"len(list_filter(range(1, {_N} + 1), lambda k: {cond}))"
_DOSSIER = f"""{_N} AS total, {_count('(doc_id + k) % 2 = 0')} AS reviewed, {_count('(doc_id + k) % 2 = 0 AND (doc_id + k) % 4 <> 0')} AS dropped, {_count('(doc_id + k) % 3 = 0')} AS closed,
  {_count('(doc_id + k) % 11 = 0')} AS spam, greatest({', '.join(_count(f'(doc_id + k) % 3 = {j}') for j in range(3))}) AS most, len(list_distinct(list_transform(range(1, {_N} + 1), lambda k: doc_id * k % 7))) AS spread"""
_WEB = r"regexp_matches(trim(title), '(?i)^(update|create|add|delete)\s+\S*\.(md|txt|rst)$')"
_DETECTED = "(doc_id % 6 = 0 AND doc_id % 100 >= 70)"
#: whether the body has its additions
_TAILED = "doc_id % 23 NOT IN (3, 4, 6)"


def fires_sql(style: dict[str, str], hits, contains_any, count) -> str:
    """Common table expressions req (the records), fire, w, scored, verdict and tiered; the arguments are SQL for texts' measures."""
    rules_ = [
        ("PROTECTED_PATH_ONLY", "1.0", "doc_id % 3 <> 1 AND doc_id % 8 = 0"),
        ("DOCS_ONLY", "1.0", "doc_id % 8 IN (0, 1)"),
        ("BODY_EMPTY", "1.0", "NOT filled"),
        ("TEMPLATE_IGNORED", "1.0", "doc_id % 2 = 0 AND filled AND NOT contains(body, '# Summary') AND NOT contains(body, '# Testing')"),
        ("BRANCH_DRIVE_BY", "1.0", "doc_id % 9 IN (0, 1)"),
        ("TITLE_UPDATE_FILE", "1.0", _WEB),
        ("SINGLE_WEB_COMMIT", "1.0", f"{_WEB} AND doc_id % 3 = 0"),
        ("TEMPLATE_UNFILLED", "hidden", "hidden >= 0.6"),
        ("BODY_DIFF_MISMATCH", "1.0", f"{contains_any('lower(body)', L.TEST_CLAIMS)} AND doc_id % 8 <> 2"),
        ("DIFF_ENORMOUS", "least((ln(additions) - ln(2000)) / (ln(50000) - ln(2000)), 1.0)", "additions >= 2000 AND doc_id % 8 <> 3"),
        ("BODY_TO_DIFF_RATIO", "least(words / churn / 100.0, 1.0)", "churn > 0 AND churn < 20 AND words > 150"),
        ("BEGGING", "least(begging / 2.0, 1.0)", "begging > 0"),
        ("USERNAME_PATTERN", "1.0", "regexp_matches(author, '[0-9]{4,}$') OR len(regexp_extract_all(author, '[0-9]')) / strlen(author) > 0.4"),
        ("AGENT_BRANCH", "1.0", "doc_id % 9 IN (2, 3)"),
        ("BODY_SCAFFOLD", "least(scaffold / 4.0, 1.0)", "scaffold >= 2"),
        *[(r, repr(v), f"doc_id % 16 = {k}") for k, r, v in _DIFF_RULES],
        ("WHITESPACE_ONLY", "1.0", r"doc_id % 16 > 5 AND NOT regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]')"),
        ("GROUNDING_MISS", "1.0", f"doc_id % 29 = 9 AND {_TAILED}"),
        ("AUTHORING_RATE", "least(ln(pace) / ln(4000), 1.0)", "additions >= 200 AND pace >= 500"),
        ("CLUSTER_SIZE_LOG", "least(ln(size) / ln(50), 1.0)", "crowd"),
        ("CLUSTER_BURST", "burst", "crowd"),
        ("CLUSTER_STYLE_COHESION", "style_cohesion", "crowd AND style_cohesion > 0.9"),
        ("CLUSTER_XREPO", "(distinct_repos - 1) / 9.0", "size >= 2 AND distinct_repos >= 2"),
        ("DOSSIER_ABANDONMENT", "dropped / reviewed", "reviewed >= 3"),
        ("DOSSIER_CLOSED_RATIO", "closed / total", "total >= 5"),
        ("DOSSIER_SPAM_LABELS", "least(spam / 3.0, 1.0)", "spam > 0"),
        ("AGENT_EMAIL", "1.0", "email"),
        ("AGENT_TRAILER", "1.0", "trailer"),
        ("GENERATION_FOOTER", "1.0", "footer"),
        ("VELOCITY_FORK_TO_PR", "1 - doc_id * 37 % 7200 / 3600.0", "doc_id * 37 % 7200 < 3600 AND additions >= 50"),
        ("REPLY_INSTANT", "1.0", "doc_id * 13 % 300 < 60"),
        ("HOUR_ENTROPY_FLAT", "doc_id % 100 / 100.0", "doc_id % 100 >= 98"),
        ("ACCOUNT_NEW", "1 / (1 + doc_id % 700 / 90.0)", "doc_id % 700 < 365"),
        ("ACCOUNT_OPAQUE", "1.0", "doc_id % 2 = 1 AND doc_id % 3 = 0 AND doc_id % 5 > 0"),
        ("DOSSIER_CONCURRENT_OPEN", "(doc_id % 8 - 2) / 8.0", "doc_id % 8 >= 3"),
        ("DOSSIER_TITLE_REPEAT", "most / total", "total >= 5 AND most >= 3"),
        ("UNRELATED_SPREAD", "spread / total", "total >= 5 AND spread / total > 0.8"),
        ("NETWORK_AUTHOR_VERDICT", "0.7", "doc_id % 29 = 2"),
        ("ACCOUNT_UNSEARCHABLE", "1.0", "doc_id % 31 = 3"),
        *[(r, f"least({m} / {k}, 1.0)", f"{m} > 0") for r, m, k in (("STYLE_EM_DASH", "em_dash", 2.0), ("STYLE_UNICODE_PUNCT", "unicode_punct", 2.0), ("STYLE_EMOJI", "emoji", 2.0), ("STYLE_NONASCII", "nonascii", 20.0), ("STYLE_AI_PHRASES", "ai_phrases", 3.0), ("STYLE_STRUCTURE", "structure", 1.0))],
        ("BODY_TOKEN_SCORE", "token_score", "token_score IS NOT NULL"),
        ("DETECTOR_SCORE", "detector_score", "detector_score IS NOT NULL"),
        ("UNDISCLOSED_AI", "1.0", f"doc_id % 5 = 1 AND NOT (email OR trailer OR footer) AND {_DETECTED}"),
        ("AI_FORBIDDEN", "1.0", "doc_id % 5 = 2 AND (email OR trailer OR footer)"),
    ]
    welcome = ", ".join(f"'{r}'" for r in L.AI_STYLE_RULES)
    hidden = "CASE WHEN body = '' THEN 0.0 ELSE coalesce(list_sum(list_transform(regexp_extract_all(body, '(?s)<!--.*?(?:-->|\\z)'), lambda x: length(x))), 0) / length(body) END"
    return f"""req AS (SELECT {', '.join(columns(False))}, text FROM documents),
h AS MATERIALIZED (SELECT *, {', '.join(f'{sql} AS {k}' for k, sql in style.items())}, {hits(['lower(body)', 'lower(trim(title))'], L.BEGGING)} AS begging, {hits(['lower(body)'], L.SCAFFOLD)} AS scaffold,
  {count('body', _SPACED)} AS words, regexp_matches(body, '{_SPACED}') AS filled, {hidden} AS hidden, additions + deletions AS churn, additions / greatest(doc_id % 50 * 60 / 3600.0, 1 / 60.0) AS pace, size >= 2 AND distinct_authors >= 2 AS crowd,
  doc_id % 47 = 5 OR doc_id % 43 = 1 AS email, doc_id % 53 = 6 OR doc_id % 43 = 2 AS trailer, doc_id % 31 = 10 AND {_TAILED} OR doc_id % 43 = 3 AS footer, {_DOSSIER}
  FROM (SELECT *, title || chr(10) || body AS prose FROM req)),
fire AS ({' UNION ALL '.join(f"SELECT doc_id, '{r}' AS rule, ({v})::DOUBLE AS value FROM h WHERE {c}" for r, v, c in rules_)}),
w AS (SELECT unnest([{', '.join(f"'{k}'" for k in WEIGHTS.rules)}]) AS rule, unnest([{', '.join(map(str, WEIGHTS.rules.values()))}])::DOUBLE AS weight),
priced AS (SELECT doc_id, f.rule, value, CASE WHEN doc_id % 5 = 0 AND f.rule IN ({welcome}) THEN 0 ELSE coalesce(w.weight, 0) END AS weight FROM fire f LEFT JOIN w ON f.rule = w.rule),
scored AS (SELECT req.doc_id, {WEIGHTS.bias} + coalesce(sum(p.value * p.weight), 0) AS score FROM req LEFT JOIN priced p ON req.doc_id = p.doc_id GROUP BY 1),
verdict AS (SELECT *, 1 / (1 + exp(-score)) AS probability FROM scored),
tiered AS (SELECT *, CASE WHEN probability >= {WEIGHTS.close} THEN 'close' WHEN probability >= {WEIGHTS.hold} THEN 'hold' WHEN probability >= {WEIGHTS.label} THEN 'label' ELSE 'pass' END AS tier FROM verdict)"""
