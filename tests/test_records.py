"""All rules on the records of the registered queries, and the replay of a wave among ordinary requests."""

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.functions import code
from gleaner.functions.text import STYLE
from gleaner.operators import clusters, engine, learn, rules
from gleaner.operators import signatures as S
from gleaner.plans import queries, records


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    text = lambda k: " ".join(f"word{(k * 7 + j) % 50}" for j in range(20 + k % 300)) + ("\n" * (k % 3)) + "é" * (k % 5)
    docs = pd.DataFrame({"doc_id": range(1500), "text": [None if k % 97 == 96 else text(k) for k in range(1500)], "lang": ["en", "de", None] * 500, "source": [f"src{k % 9}" for k in range(1500)]})
    docs["n_chars"] = docs["text"].str.len().astype("Int64")
    docs.to_parquet(d / "documents.parquet")
    return str(d)


def test_every_rule_and_tier_occurs_and_sql_agrees(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    fires = {(r["doc_id"], r["rule"], r["value"]) for r in queries.QUERIES["rule_fires"](spark, folder).collect()}
    assert fires == set(con.execute(queries.ORACLES["rule_fires"]).fetchall())
    emitted = {r for _, r, _ in fires}
    assert len(emitted) == 61 and set(records.WEIGHTS.rules) - emitted == {"CANARY_EATEN", "CHALLENGE_TIMEOUT"}
    tiers = {r["doc_id"]: r["tier"] for r in queries.QUERIES["score_tier"](spark, folder).collect()}
    assert set(tiers.values()) == set(engine.TIERS)
    assert tiers == {i: t for i, t in con.execute(queries.ORACLES["score_tier"].replace("SELECT doc_id, round(score", "SELECT doc_id, tier FROM tiered --")).fetchall()}


def test_code_lanes_match_slow_counts():
    """Each lane on the sample module, counted by hand from its lines."""
    lines = [x.strip() for x in records._MODULE.splitlines() if x.strip()]
    norm = [re.sub(r"\s+", " ", re.sub("[0-9]+", "N", re.sub('"[^"]*"', "S", x).lower())) for x in lines]
    windows = [tuple(norm[i : i + 5]) for i in range(len(norm) - 4)]
    repeated = len(windows) - len(set(windows))
    magic = [x for x in lines if re.search(r"(?<![\w/:])4711", x)]
    want = {
        "CODE_DUP_BLOCK": 2 * repeated / len(windows),
        "CODE_DUP_FUNC": 1 / 3,  # the two loaders
        "CODE_MAGIC_NUMBER": 2 * len(magic) / len(lines),
        "CODE_REPEAT_LITERAL": 1 / 3,  # 4711; the address is on two lines only
        "CODE_HARDCODED_CONFIG": sum("http://" in x or "timeout =" in x for x in lines) / 4,
        "CODE_BLANKET_CATCH": min(1.0, 2 * sum("except" in x for x in lines) / 4),  # each is followed by pass
        "CODE_DOC_SCAFFOLD": sum(":param" in x for x in lines) / sum(x.startswith("def") for x in lines),
        "CODE_DEAD_HELPER": sum(records._MODULE.lower().count(n) == 1 for n in ("loadfirst", "loadsecond", "forgottenhelper", "unusedhelper")) / 3,
        "CODE_STYLE_DRIFT": 1.0,  # snake case before, camel case after
    }
    got = dict(zip(code.RULES, code.code_rules(records.DIFFS[0])))
    assert got == pytest.approx(want) and records.FOUND[0] == pytest.approx(want)
    assert all(v is None for k in range(1, 6) for v in code.code_rules(records.DIFFS[k]))


WAVE_BODY = "<!-- Thank you for the change. Please say what it does and why, how it was tested, and which issue it closes. Leave these lines in place. -->\n# Summary\nupdated file\n<!-- Describe the tests that you ran, on which systems, and how somebody else can run them again before they accept this. -->\n"


def _requests(spark):
    wave = [(k, f"newcomer{4000 + k}", "Update Readme.md", WAVE_BODY, 1, "NONE", "+++ b/Readme.md\n+my name is here and i like this\n", ["Readme.md"]) for k in range(4)]
    said = ["Bump the parser to fix a crash on empty input", "Explain how the cache is sized", "Retry the upload when the server is busy", "Backport the fix of the date format"]
    ham = [(10 + k, a, t, t + ".\n\nThe old code assumed that " + "abcd"[k] * 3 + " holds, which isn't so for all callers; see the new test.", 40 + k, "CONTRIBUTOR", f"+++ b/src/m{k}.py\n+value{k} = old{k} + {k}\n", [f"src/m{k}.py", f"tests/test_m{k}.py"]) for k, (a, t) in enumerate(zip(("ann", "bob", "cy", "dee"), said))]
    bots = [(20, "dependabot[bot]", "Bump x from 1 to 2", "Bumps x.", 1, "CONTRIBUTOR", "+++ b/x.lock\n+x 2\n", ["x.lock"])]
    d = spark.createDataFrame([(*r, 180 * i) for i, r in enumerate(wave + ham + bots)], "id long, author string, title string, body string, additions long, author_association string, diff string, paths array<string>, secs long")
    null = {"detector_score": "double", "template": "string", "commit_emails": "array<string>", "commit_messages": "array<string>", "commit_times": "array<long>", "labels": "array<string>"}
    d = d.withColumns({"repo": F.lit("r"), "deletions": F.lit(0).cast("long"), "commit_count": F.lit(0).cast("long"), "head_ref": F.lit(""), **{k: F.lit(None).cast(t) for k, t in null.items()}})
    from gleaner.schemas import FACTS

    return d.withColumn("dossier", F.lit(None).cast("struct<" + FACTS.replace(", ", ",").replace(" ", ":") + ">"))


def test_a_wave_is_held_and_ordinary_requests_are_not(spark):
    d = _requests(spark).withColumn("exempt", rules.exempt())
    assert [r["id"] for r in d.filter("exempt").collect()] == [20]
    d = d.filter("not exempt")
    prose = F.concat_ws("\n", "title", "body")
    from gleaner.functions import text as X

    s = S.signed(d.select("id", "repo", "author", "secs", prose.alias("prose"), "diff"), F.col("diff"), F.col("prose"), exact=True)
    m = s.select("id", "secs", "repo", "author", *[c.alias(k) for k, c in X.style(F.col("prose")).items()])
    assert set(STYLE) < set(m.columns)
    views = clusters.views_at_arrival(m, S.edges(s.select("id", "sim", "mins"))).withColumn("burst", clusters.burst_score()(F.col("in_window")))
    full = rules.all_rules(d.join(views.select("id", "size", "distinct_repos", "distinct_authors", "burst", "style_cohesion"), "id", "left"))
    got = engine.score(full, engine.default_weights()).withColumn("slop", F.col("id") < 10)
    tier = {r["id"]: r["tier_code"] for r in got.collect()}
    assert tier[3] >= 2 and all(t <= 1 for i, t in tier.items() if i >= 10)
    assert learn.auc(got, "probability", F.col("slop")).first()[0] > 0.95
    dry = engine.planned(got.withColumn("dry_run", F.lit(True))).filter("id = 3").first()
    assert dry["action"] == "label" and "would have been" in dry["comment"]
