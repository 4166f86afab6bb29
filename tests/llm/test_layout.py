"""Mixing, resharding and the fixity audit against brute force."""

import glob
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import fixity, mixing, sharding

from .conftest import rows, words


def test_pivotal_keeps_the_sum_and_the_expectation():
    r = np.random.default_rng(1)
    p = r.random(40)
    p[:2] = 0, 1
    total = np.zeros(40)
    for k in range(4000):
        out, held = mixing.pivotal(p, r.random(40))
        whole = np.delete(out, held) if held >= 0 else out
        assert set(whole) <= {0.0, 1.0} and abs(out.sum() - p.sum()) < 1e-9
        if held >= 0:
            out[held] = r.random() < out[held]
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04


def _brute_copies(docs, weights):
    """Copies by sequential pivotal rounding of all rows in one list."""
    data = docs.collect()
    n = Counter(x["source"] for x in data)
    w = {s: weights.get(s, 1.0) * k**mixing.TEMPER for s, k in n.items()}
    rate = [len(data) * w[x["source"]] / sum(w.values()) / n[x["source"]] for x in data]
    whole = [int(r + 1e-9) for r in rate]
    p, r, held = [max(0.0, a - b) for a, b in zip(rate, whole)], random.Random(1), None
    for i in range(len(p)):
        if held is None:
            held = i
            continue
        a, b = p[held], p[i]
        if a + b <= 1:
            p[held], p[i] = (a + b, 0.0) if r.random() * (a + b) < a else (0.0, a + b)
        else:
            p[held], p[i] = (1.0, a + b - 1) if r.random() * (2 - a - b) < 1 - b else (a + b - 1, 1.0)
        held = next((k for k in (held, i) if 1e-9 < p[k] < 1 - 1e-9), None)
    return [a + round(b) for a, b in zip(whole, p)]


def test_copies(frame, odd, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)  # many buckets, so that the tree has several levels
    monkeypatch.setattr(mixing, "FAN", 3)
    r = random.Random(2)
    docs = frame([(i, f"text {i}", "en", r.choice(["a", "a", "a", "b", None]), 1) + (None,) * 8 for i in range(900)])
    got = mixing.copies(docs, {"b": 2.0}).collect()
    n = {}
    for x in docs.collect():
        n[x["source"]] = n.get(x["source"], 0) + 1
    weight = {s: (2.0 if s == "b" else 1.0) * k**0.5 for s, k in n.items()}
    assert sum(x["copies"] for x in got) == 900 == len(got) == sum(x["rows"] for x in got)
    for s in n:
        rate = 900 * weight[s] / sum(weight.values()) / n[s]
        own = [x["copies"] for x in got if x["source"] == s]
        assert {int(rate), int(rate) + 1} >= set(own) and abs(sum(own) / len(own) - rate) < 0.12
    again = {x["doc_id"]: x["copies"] for x in mixing.copies(docs.repartition(7), {"b": 2.0}).collect()}
    assert again == {x["doc_id"]: x["copies"] for x in got}
    mixed = mixing.mix(docs, {"b": 2.0})
    assert mixed.columns == docs.columns and mixed.count() == 900
    # rounding all rows in one list gives each source about as many, and the same sum
    slow = Counter()
    for x, c in zip(docs.collect(), _brute_copies(docs, {"b": 2.0})):
        slow[x["source"]] += c
    fast = Counter()
    for x in got:
        fast[x["source"]] += x["copies"]
    assert sum(slow.values()) == 900 and all(abs(slow[s] - fast[s]) <= 0.1 * n[s] for s in n)
    hot = frame([(1, "t", "en", "a", 1) + (None,) * 8] * 500 + [(k, "t", "en", "b", 1) + (None,) * 8 for k in range(2, 302)])
    rows_ = {x["doc_id"]: (x["rows"], x["copies"]) for x in mixing.copies(hot).collect()}
    assert rows_[1][0] == 500 and len(rows_) == 301 and sum(c for _, c in rows_.values()) == 800
    share = 800 * 500**0.5 / (500**0.5 + 300**0.5)
    assert int(share) <= rows_[1][1] <= int(share) + 1 and mixing.mix(hot).filter("doc_id = 1").count() == rows_[1][1]
    assert mixing.mix(odd).count() == odd.count() and sum(x["copies"] for x in mixing.copies(odd).collect()) == odd.count()
    assert not mixing.mix(empty).count() and not mixing.copies(empty).count()


def _cheapest(old, cap):
    """Fewest bytes that move, by trying all ways for what stays."""
    stay = sum(min(o, c) for o, c in zip(old, cap))
    return sum(old) - stay


def test_flow_moves_the_fewest_bytes():
    r = random.Random(3)
    for _ in range(200):
        old = [r.randrange(0, 30) for _ in range(r.randrange(1, 6))]
        cap = [r.randrange(0, 30) for _ in range(r.randrange(1, 6))]
        if sum(cap) < sum(old):
            with pytest.raises(ValueError):
                sharding.transfers(old, cap)
            continue
        plan = sharding.transfers(old, cap)
        into = [0] * len(cap)
        for size, parts in zip(old, plan):
            assert sum(b - a for a, b, _ in parts) == size and [a for a, _, _ in parts] == [0, *[b for _, b, _ in parts]][: len(parts)]
            for a, b, j in parts:
                into[j] += b - a
        assert all(x <= c for x, c in zip(into, cap))
        moved = sum(b - a for i, parts in enumerate(plan) for a, b, j in parts if i != j)
        assert moved == _cheapest(old, cap)


def _brute_places(docs, shards):
    old = {}
    for d in docs:
        old.setdefault(d["source"] or "", []).append(d)
    names = sorted(old)
    size = lambda d: len((d["text"] or "").encode())
    total = sum(map(size, docs))
    cap = [total // shards + (k < total % shards) for k in range(shards)]
    out = {}
    for i, (s, parts) in enumerate(zip(names, sharding.transfers([sum(map(size, old[s])) for s in names], cap))):
        at = 0
        for d in sorted(old[s], key=lambda d: d["doc_id"]):
            j = next((j for a, b, j in parts if a <= at < b), parts[-1][2] if parts else min(i, shards - 1))
            out[d["doc_id"]] = (s, size(d), at, j, i != j)
            at += size(d)
    return out


def test_places_and_files(spark, frame, odd, empty, tmp_path):
    texts = [words(k, 5 + k % 37) if k % 11 else ("" if k % 2 else None) for k in range(300)]
    docs = frame([(k * 97, t, "en", ["hot", "hot", "hot", "b", None, "d"][k % 6], 0, "x", "y", "z", 7, "k", "q", 1, "t") for k, t in enumerate(texts)])
    want = _brute_places(docs.collect(), 7)
    full = sharding.placed(docs, new_shards=7)
    assert full.columns == [*docs.columns, "old_shard", "n_bytes", "_new_shard", "moved"]  # the documents' own new_shard stays
    assert {r["doc_id"]: (r["old_shard"], r["n_bytes"], r["_new_shard"], r["moved"]) for r in full.collect()} == {d: (w[0], w[1], w[3], w[4]) for d, w in want.items()}
    place = lambda r, name: (r["old_shard"], r["n_bytes"], r["shard_offset"], r[name], r["moved"])
    path = str(tmp_path / "new")
    slim = sharding.reshard(docs, path, new_shards=7)
    assert {r["doc_id"]: place(r, "new_shard") for r in slim.collect()} == want
    files = spark.read.parquet(path)
    assert set(docs.columns) < set(files.columns)
    touched = {j for _, _, _, j, m in want.values() if m} | {sorted({w[0] for w in want.values()}).index(s) for s, _, _, _, m in want.values() if m}
    assert {r["doc_id"]: r["_new_shard"] for r in files.collect()} == {d: w[3] for d, w in want.items() if w[3] in touched}


def test_files_agree_with_the_report_where_rows_repeat(spark, frame, tmp_path):
    docs = frame([(1, "x" * 10, "en", "a", 10) + (None,) * 8] * 40 + [((k * 0x9E3779B97F4A7C15) % (1 << 63), "y" * 10, "en", "b", 10) + (None,) * 8 for k in range(1, 61)])
    report = {}
    for r in sharding.reshard(docs, str(tmp_path / "four"), new_shards=4).collect():
        report[r["doc_id"], r["new_shard"]] = report.get((r["doc_id"], r["new_shard"]), 0) + 1
    files = {(r["doc_id"], r["_new_shard"]): r["n"] for r in spark.read.parquet(str(tmp_path / "four")).groupBy("doc_id", "_new_shard").agg(F.count("*").alias("n")).collect()}
    assert files == report and sorted(n for (d, _), n in report.items() if d == 1) == [15, 25]
    assert {r["doc_id"]: r["n"] for r in sharding.placed(docs, new_shards=4).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}[1] == 40


def test_untouched_shards_are_not_rewritten(frame, tmp_path):
    docs = frame([(k, "x" * 10, "en", f"s{k % 3}", 10) + (None,) * 8 for k in range(30)])
    sharding.reshard(docs, str(tmp_path / "same"), capacity=[100, 100, 100])
    assert not glob.glob(str(tmp_path / "same/*"))
    sharding.reshard(docs, str(tmp_path / "some"), capacity=[90, 110, 100])
    assert sorted(g[-12:] for g in glob.glob(str(tmp_path / "some/_new_shard=*"))) == ["_new_shard=0"[-12:], "_new_shard=1"[-12:]]


def test_odd_documents_are_placed(odd, empty):
    got = sharding.placed(odd).collect()
    assert len(got) == odd.count() and all(r["_new_shard"] is not None for r in got)
    assert sharding.reshard(odd).count() == odd.count()
    assert not sharding.placed(empty).count() and not sharding.reshard(empty).count()


def test_audit_names_just_the_damage(spark):
    r = random.Random(6)
    pages = [(k if k % 50 else None, f"u{k % 9}", words(k, r.randrange(1, 40)), 1, "x") for k in range(6000)] + [(7, None, None, 1, "x"), (7, "", "", 1, "x"), (7, "", "", 1, "x")]
    schema = "page_id long, url string, html string, nth int, hash string"
    a = spark.createDataFrame(pages, schema)
    assert fixity.audit(a, a.repartition(5)).count() == 0
    bad = list(pages)
    bad[17] = (17, "u", "changed", 1, "x")
    bad[4097] = (4097, bad[4097][1], bad[4097][2] + ".", 1, "x")
    gone = bad.pop(5001)
    bad.append((9_999, "new", "new", 1, "x"))
    got = {(x["page_id"], x["status"]) for x in fixity.audit(a, spark.createDataFrame(bad, schema)).collect()}
    assert got == {(17, "changed"), (4097, "changed"), (gone[0], "missing"), (9_999, "extra")}
    none = spark.createDataFrame([], schema)
    assert fixity.audit(a, none).count() == len(pages) and fixity.audit(none, none).count() == 0
    assert {x["status"] for x in fixity.audit(none, a).collect()} == {"extra"}


def test_audit_tells_all_fields_and_repeats_apart(spark):
    schema = "page_id long, url string, html string"
    f = lambda r: spark.createDataFrame(r, schema)
    status = lambda a, b: [(x["page_id"], x["status"]) for x in fixity.audit(f(a), f(b)).collect()]
    assert status([(1, "u\x01x", "y")], [(1, "u", "x\x01y")]) == [(1, "changed")]
    assert status([(1, "u", None)], [(1, "u", "\0")]) == [(1, "changed")] and status([(1, "u", None)], [(1, "u", "-")]) == [(1, "changed")]
    assert status([(1, "u", "x")] * 3, [(1, "u", "x")] * 2) == [(1, "missing")]
    # sparse keys, one key with many records, a very long payload
    many = [((k * 0x9E3779B97F4A7C15) % (1 << 63), "u", "x" * (k % 50)) for k in range(1, 2000)] + [(5, "u", f"h{k}" * 100) for k in range(2000)] + [(6, "u", "z" * 3_000_000)] + [(None, None, None)] * 2
    assert status(many, many[::-1]) == []
    bad = list(many)
    bad[10] = (bad[10][0], "u", "other")
    bad[2500] = (5, "u", "other")
    bad[-3] = (6, "u", "z" * 2_999_999 + "y")
    got = status(many, bad[:-1])
    assert len(got) == 4 and set(got) == {(many[10][0], "changed"), (5, "changed"), (6, "changed"), (None, "missing")}
