"""Steps whose work or memory must not grow faster than the input."""

import hashlib
import itertools
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.functions import hashing as H
from gleaner.functions import text as X
from gleaner.operators import clusters
from gleaner.operators import signatures as S


def _views(rows, edges):
    """The definition: the component of each row among the rows up to it, walked anew for each."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    place, out = {r[0]: k for k, r in enumerate(rows)}, {}
    for k, (i, secs, *_) in enumerate(rows):
        group = [i]
        for x in group:
            group += [y for y in near.get(x, ()) if place[y] < k and y not in group]
        g = [rows[place[x]] for x in group]
        style = np.array([r[4:] for r in g])
        mean = style.mean(0)
        norm = np.sqrt((style**2).sum(1)) * np.sqrt((mean**2).sum())
        cos = np.divide(style @ mean, norm, out=np.zeros(len(g)), where=norm > 0)
        out[i] = (rows[min(place[x] for x in group)][0], len(g), len({r[2] for r in g} - {None}), len({r[3] for r in g} - {None}), sum(secs - r[1] <= clusters.WINDOW_SECS for r in g), round(float(cos.mean()), 9))
    return out


def test_views_equal_the_definition(spark):
    rng = np.random.default_rng(5)
    ids = rng.permutation(120).tolist()
    rows = [(i, int(rng.integers(0, 9)) * 7200, None if i % 17 == 0 else f"r{i % 3}", f"a{i % 7}", *([0.0] * 7 if i % 11 == 0 else rng.random(7).tolist())) for i in ids]
    edges = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 120, (130, 2)).tolist() if a != b})
    m = spark.createDataFrame(rows, "id long, secs long, repo string, author string, " + ", ".join(f"{k} double" for k in X.STYLE))
    got = {r["id"]: (r["cluster"], r["size"], r["distinct_repos"], r["distinct_authors"], r["in_window"], round(r["style_cohesion"], 9)) for r in clusters.views_at_arrival(m, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _views(rows, edges)
    assert {i: v for i, v in want.items() if v[1] > 1} == {i: v for i, v in got.items() if v[1] > 1} and got.keys() == want.keys()


def test_copies_as_stars_give_the_same_views(spark):
    text = [f"alpha beta gamma delta epsilon zeta eta theta {w} iota kappa lambda mu nu xi omicron pi rho sigma tau" for w in ("one", "two", "three")]
    rows = [(i, i * 180, f"r{i % 2}", f"a{i % 5}", text[i % 3] if i % 4 else text[0], *[float(i % 3)] * 7) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, secs long, repo string, author string, t string, " + ", ".join(f"{k} double" for k in X.STYLE))
    s = S.signed(d, F.concat(F.lit("+"), "t"), F.col("t")).select("id", "sim", "mins")
    stars, every = S.edges(s, stars=True), S.edges(s)
    assert stars.count() < every.count()
    views = [sorted(map(tuple, clusters.views_at_arrival(d, e).withColumn("style_cohesion", F.round("style_cohesion", 9)).collect())) for e in (stars, every)]
    assert views[0] == views[1]


def test_a_wave_is_replayed_in_time_linear_in_its_rows(spark):
    n = 20_000
    m = spark.range(n).select("id", (F.col("id") * 2).alias("secs"), F.lit("r").alias("repo"), F.col("id").cast("string").alias("author"), *[F.lit(0.5).alias(k) for k in X.STYLE])
    began = time.time()
    last = clusters.views_at_arrival(m, spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))).filter(F.col("id") == n - 1).first()
    assert (last["size"], last["distinct_authors"], last["in_window"]) == (n, n, 10_801) and time.time() - began < 60


def test_one_hot_band_makes_no_rows_of_candidates(spark):
    # 9,000 simhashes in one key, over more than one block; near ones are those of the definition
    rng = np.random.default_rng(3)
    sims = [5 | int(x) << 15 for x in rng.integers(0, 1 << 45, 9000)]
    sims += [x ^ 1 << 20 for x in sims[:40]] + [x ^ 1 for x in sims[:7]] + sims[:3]
    x = np.array(sims)
    want = set()
    for i in range(len(x)):
        d = x[i] ^ x[i + 1 :]
        shared = ((d[:, None] >> np.arange(0, 60, 15) & 32767) == 0).any(1)
        want |= {(i, i + 1 + int(j), int(np.bitwise_count(d[j]))) for j in np.flatnonzero((np.bitwise_count(d) <= S.NEAR_HAMMING) & shared)}
    found = S.simhash_pairs(spark.createDataFrame(list(enumerate(sims)), "id long, sim long"))
    got = [tuple(r) for r in found.select("a", "b", "hamming").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    keyed = S._sim_pairs(spark.createDataFrame([(v,) for v in set(sims)], "sim long"), "sim", S.NEAR_HAMMING)
    assert keyed.count() < 100


def test_signatures_take_tokens_as_one_string(spark):
    texts = ["ΑΣ ΒΣ ΣΑΣ Σ İstanbul ǅ ẞ straße x\x1fy 日本 語 a", "\x1f one  Two\n\n three-four_five 5½ Ⅷ ² x y z", "a b", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", X.joined_tokens(F.col("t")).alias("j"), X.tokens(F.col("t")).alias("toks"), S.shingle_hashes(X.tokens(F.col("t")), 3).alias("h"))
    for r in d.collect():
        assert r["j"] is None and r["toks"] is None or r["j"] == "\x1f".join(r["toks"]) and S._hashes(r["j"], 3, False).tolist() == r["h"]
    x = np.array([0, 1, S.P31 - 1, S.P31, S.P31 + 1, (1 << 62) + (1 << 31), 2 * S.P31, (1 << 63) - 1])
    assert H.mod_p31(x).tolist() == [int(v) % S.P31 for v in x]
    assert H.md5_60([b"x"]).tolist() == [int(hashlib.md5(b"x").hexdigest()[:15], 16)]


def test_style_kernel_holds_bounded_text(monkeypatch):
    most, rows = [], X.style_rows
    monkeypatch.setattr(X, "AT_ONCE", 100)
    monkeypatch.setattr(X, "style_rows", lambda t: most.append(sum(map(len, t))) or rows(t))
    texts = ["", None, "a. b — c! " * 4, None, "x" * 250, "- one\n# two", None, *["word " * 9] * 20]
    got = X.style_values.func(pa.array(texts, pa.string())).to_pylist()
    want = rows([t for t in texts if t is not None])
    assert sorted(most)[-1] == 250 and sorted(most)[-2] <= 100
    at = itertools.count()
    assert [g for g in got] == [None if t is None else {k: float(v[i]) for k, v in want.items()} for t in texts for i in [next(at) if t is not None else None]]
    assert X.style_values.func(pa.array([None, None], pa.string())).to_pylist() == [None, None] and len(X.style_values.func(pa.array([], pa.string()))) == 0
