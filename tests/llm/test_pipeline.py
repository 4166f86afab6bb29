"""The pipeline against a brute-force version of its stages, and its contract."""

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from gleaner.llm import decontaminate, mixing

from .conftest import words


def _write(d, name, rows, schema):
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema), d / f"{name}.parquet")


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def _tables(d, docs, labels, bench):
    _write(d, "documents", docs, DOCS)
    _write(d, "labels", labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]))
    _write(d, "benchmark", bench, pa.schema([("item_id", pa.int64()), ("text", pa.string())]))


def test_pipeline_matches_brute_force(spark, tmp_path):
    items = [words(700 + k, 14, 900) for k in range(4)]
    docs = []
    for k in range(120):
        t = words(k % 100, 100, 900)  # the last 20 repeat the first
        if k % 10 == 3:
            t += " " + items[k % 4]
        docs.append((k, t, "en", "ab"[k % 2] if k % 7 else "hot", len(t)))
    docs += [(200, None, None, None, None), (201, "", "en", "a", 0)]
    _tables(tmp_path, docs, [(0, 0, 0)], list(enumerate(items)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # no good labels: all stay; copies: the least id stays; leaks go by exact edit distance
    seen, left = set(), []
    for d in docs:
        t = d[1]
        if t and t in seen:
            continue
        seen.add(t)
        if t and any(decontaminate.infix_distance(x.encode(), t.encode(), len(x)) <= int(0.1 * len(x)) for x in items):
            continue
        left.append(d)
    n = {}
    for d in left:
        n[d[3]] = n.get(d[3], 0) + 1
    weight = {s: k**mixing.TEMPER for s, k in n.items()}
    assert len(got) == len(left)
    copies = {}
    for r in got:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for d in left:
        rate = len(left) * weight[d[3]] / sum(weight.values()) / n[d[3]]
        assert int(rate) <= copies.get(d[0], 0) <= int(rate) + 1
    assert set(copies) <= {d[0] for d in left}
    size = sum(r["n_bytes"] for r in got)
    per = {}
    for r in got:
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["old_shard"] == (r["source"] or "")
        per[r["new_shard"]] = per.get(r["new_shard"], 0) + r["n_bytes"]
    most = max(r["n_bytes"] for r in got)
    assert all(v <= -(-size // 24) + most for v in per.values())


def test_stages_keep_the_columns(spark, tmp_path):
    docs = [(1, "a b c", "en", "s", 5), (None, None, None, None, None), (1, "a b c", "en", "s", 5)]
    _tables(tmp_path, docs, [], [])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for rows in (docs, []):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert out.columns[:5] == df.columns and (len(out.columns) == 5 or k == len(corpus_pipeline.STAGES) - 1)
            assert out.count() <= df.count()
