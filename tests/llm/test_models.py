"""Fitted operators: held-out accuracy, brute-force scores and recall."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs

from gleaner.llm import ann, common, decontaminate, kernel, minhash, quality, secrets, toxicity

from .conftest import rows, words


def _labels(spark, r):
    return spark.createDataFrame(r, "doc_id long, quality int, toxic int, l_id long, text string")


def test_log_weights_match_brute_force(spark, frame):
    texts = [words(k, 60) + "." for k in range(40)]
    docs = frame(rows(texts))
    labels = _labels(spark, [(k, int(k % 3 > 0), 0, 1, "x") for k in range(30)])
    ratio, sample = quality.weights(docs, labels)
    grams = lambda t: quality.features(kernel.as_text(pa.array([t])))[0].tolist()
    raw = Counter(b for t in texts for b in grams(t))
    good = Counter(b for r in sample.filter("l_quality = 1 and l_half = 0").collect() for b in grams(r["text"]))
    nr, ng, m = sum(raw.values()), sum(good.values()), quality.BUCKETS
    log = lambda b: math.log((good[b] + 1) / (ng + m)) - math.log((raw[b] + 1) / (nr + m))
    for r in quality.scores(docs, ratio).collect():
        assert abs(r["log_weight"] - sum(map(log, grams(texts[r["doc_id"]])))) < 1e-4


def test_kth_greatest(spark):
    r = random.Random(1)
    v = [round(r.gauss(0, 5), 2) for _ in range(900)] + [3.0] * 50
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for k in (1, 2, 49, 300, 949, 950, 2000):
        assert quality.kth_greatest(df, "v", k) == sorted(v, reverse=True)[min(k, 950) - 1]
    assert quality.kth_greatest(df, "v", 0) == float("inf")


def test_resampling_drops_junk_and_keeps_good(spark, frame, odd, empty):
    r = random.Random(2)
    good = [words(k, 120) for k in range(300)]
    junk = ["".join(r.choice("%$#@&*!~^") + r.choice("qxzjk") + " " for _ in range(200)) for _ in range(60)]
    docs = frame(rows(good + junk))
    labels = _labels(spark, [(k, 1, 0, 1, "x") for k in range(0, 300, 2)] + [(k, 0, 0, 1, "x") for k in range(300, 320)] + [(None, 1, 0, 1, "x"), (3, None, 0, 1, "x")])
    kept = quality.resample(docs, labels)
    ids = {x["doc_id"] for x in kept.collect()}
    assert kept.columns == docs.columns
    assert len(ids & set(range(300))) >= 297 and len(ids & set(range(300, 360))) <= 6
    assert ids == {x["doc_id"] for x in quality.selected(docs, labels).collect()}
    assert quality.resample(odd, labels.limit(0)).count() == odd.count()  # without good labels every row stays
    assert quality.resample(odd, labels).count() >= 0 and not quality.resample(empty, labels).count()


def test_compression_tells_toxic_text(spark, frame, odd, empty):
    bad = ["grubwort", "snarlface", "vilehound"]
    r = random.Random(3)
    texts, toxic = [], []
    for k in range(400):
        t = words(k, 60).split()
        toxic.append(k % 4 == 0)
        if toxic[-1]:
            for w in r.sample(bad, 2) * 2:
                t.insert(r.randrange(len(t)), w)
        texts.append(" ".join(t))
    docs = frame(rows(texts))
    got = {x["doc_id"] for x in toxicity.toxic(docs, _labels(spark, [(k, 1, int(toxic[k]), 1, "x") for k in range(200)])).collect()}
    held = range(200, 400)
    hits = sum(k in got for k in held if toxic[k])
    false = sum(k in got for k in held if not toxic[k])
    assert hits >= 45 and false <= 4
    lab = _labels(spark, [(k, 1, int(toxic[k]), 1, "x") for k in range(200)])
    assert toxicity.toxic(docs, lab.limit(0)).count() == 0 and toxicity.toxic(empty, lab).count() == 0 and toxicity.toxic(odd, lab).count() == 0
    # a text's windows cover it whole
    data, off = kernel.flat(kernel.as_text(pa.array([texts[0], "", "short"])))
    seg, row = toxicity.windows(data, off)
    assert seg[row == 0][-1].sum() == off[1] - 1 and (row == 1).sum() == 0 and seg[row == 2].tolist() == [[off[2], 5]]


def test_grammars_find_formats(spark, frame, odd, empty):
    r = random.Random(4)
    make = lambda: "tk_" + "".join(r.choice("0123456789abcdef") for _ in range(24))
    texts, where = [], {}
    for k in range(300):
        t = words(k, 30)
        if k % 2:
            s = make()
            where[k] = s
            t += f' api_key = "{s}"' if k % 3 else f" see {s} "
        else:
            t += " " + "".join(words(k + 900, 6).split())
        texts.append(t)
    got = secrets.scan(frame(rows(texts))).collect()
    found = {x["doc_id"]: x["candidate"] for x in got if x["is_secret"]}
    assert sum(found.get(k) == s for k, s in where.items()) >= 0.95 * len(where) and len(set(found) - set(where)) <= 3
    for x in got:
        assert texts[x["doc_id"]].encode()[x["at_byte"] :].startswith(x["candidate"].encode())
    long = frame(rows(["a " * 300_000 + 'password: "' + make() + '"']))
    assert secrets.scan(long).count() == 1
    assert secrets.scan(odd).filter("is_secret").count() == 0 and secrets.scan(empty).count() == 0


def test_automaton_is_a_distribution_over_its_language():
    a = secrets.Automaton(Counter({"0123": 50, "4567": 50, "89": 20}))
    assert a.score("5555") > a.score("zzzz") and len(a.states) <= 6


def test_additive_codes_approximate():
    r = np.random.default_rng(5)
    x = (r.normal(size=(60, 16))[r.integers(0, 60, 3000)] + 0.1 * r.normal(size=(3000, 16))).astype(np.float32)
    books = ann.train(x)
    err = [((x - ann.decode(ann.encode(x, books, beam=b), books)) ** 2).sum(1).mean() for b in (1, 8)]
    assert err[1] <= err[0] < 0.1 * (x**2).sum(1).mean()


def test_neighbours_recall(spark):
    r = np.random.default_rng(6)
    x = (r.normal(size=(40, 12))[r.integers(0, 40, 2500)] + 0.3 * r.normal(size=(2500, 12))).astype(np.float32)
    schema = "vec_id long, embedding array<float>, q long, cell long, nth long"
    data = [(i, v.tolist(), 1, 2, 3) for i, v in enumerate(x)]
    odd = [(9001, None, 1, 2, 3), (9002, [float("nan")] * 12, 1, 2, 3), (9003, [1.0], 1, 2, 3), (None, x[0].tolist(), 1, 2, 3), (5, x[5].tolist(), 1, 2, 3)]
    got = {}
    for row in ann.neighbours(spark.createDataFrame(data + odd, schema), every=1).collect():
        got.setdefault(row["vec_id"], []).append((row["rank"], row["neighbour_id"]))
    assert set(got) == set(range(2500)) and all(len(v) == 10 for k, v in got.items() if k != 5)
    hit = 0
    for i in range(2500):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(set(np.argsort(d)[:10]) & {n for _, n in got[i]})
    assert hit >= 0.9 * 25000
    assert min(got[5])[1] == 5  # the repeated row is its twin's nearest
    few = spark.createDataFrame(data[:3], schema)
    assert ann.neighbours(few, every=1).count() == 6 and ann.neighbours(few.limit(0)).count() == 0
    # production's queries are the ids divisible by 100
    assert {r["vec_id"] for r in ann.neighbours(few).collect()} == {0}


def test_neighbours_recall_on_isotropic_vectors(spark):
    """Nothing to tell cells by: recall must not depend on it, nor on the table's size."""
    r = np.random.default_rng(8)
    for n in (1500, 66_000):
        x = r.normal(size=(n, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1)[:, None]
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
        table = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": flat})).repartition(8)
        asked = np.arange(0, n, 100)
        got = {i: set() for i in asked.tolist()}
        for row in ann.neighbours(table).collect():
            got[row["vec_id"]].add(row["neighbour_id"])
        d = (x * x).sum(1)[None, :] - 2 * x[asked] @ x.T
        d[np.arange(len(asked)), asked] = np.inf
        top = np.argpartition(d, 9, 1)[:, :10]
        assert sum(len(got[i] & set(t.tolist())) for i, t in zip(asked.tolist(), top)) >= 0.9 * 10 * len(asked), n


def test_window_lengths_match_brute_force():
    texts = ["grub wort " * 30 + "ordinary words", "", "short", "é" * 100]
    model = toxicity.Model(b"ordinary words of a text " * 30, b" grub wort ", b" more words", 0.0)
    g, row = toxicity.gains(kernel.as_text(pa.array(texts)), model.compressors())
    want = []
    for r, t in enumerate(texts):
        b, at = t.encode(), 0
        while b:
            w = b[at : at + toxicity.WINDOW]
            sizes = [len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d), level=toxicity.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress(w)) for d in (model.ordinary + model.other, model.ordinary + model.toxic)]
            want.append((r, sizes[0] - sizes[1]))
            if at + toxicity.WINDOW >= len(b):
                break
            at += toxicity.STEP
    assert list(zip(row.tolist(), g.tolist())) == want and max(g) > 0
    score, gain, n = toxicity.scored(kernel.as_text(pa.array(texts)), model.compressors())
    for r in range(len(texts)):
        own = sorted((x for k, x in want if k == r), reverse=True) + [0, 0]
        assert score[r] == max(own[0], 0) + max(own[1], 0) / 2 and n[r] == sum(k == r for k, _ in want)


def test_toxic_dictionary_grows_with_its_words():
    r = random.Random(9)
    make = lambda: "".join(r.choice("bcdfghjklmnpqrstvwz") + r.choice("aeiou") for _ in range(5))
    bad, plain = [make() for _ in range(20)], [make() for _ in range(3000)]
    texts = []
    for k in range(3200):
        t = r.choices(plain, k=30)
        for w in r.sample(bad, 2) * 2 if k % 8 == 0 else ():
            t.insert(r.randrange(len(t)), w)
        texts.append((k, k % 8 == 0, " ".join(t), "en"))
    model = toxicity.fit_rows(texts[:2400])
    assert all(f" {w} ".encode() in model.toxic for w in bad)
    hit = toxicity.scored(pa.array([t for _, _, t, _ in texts[2400:]], pa.large_string()), model.compressors())[0] >= model.least
    toxic = np.array([x for _, x, _, _ in texts[2400:]])
    assert hit[toxic].mean() >= 0.9 and hit[~toxic].mean() <= 0.03
    # a rare language's words are in the dictionary that all languages share
    other = [(5000 + k, k % 2 == 0, " ".join(r.choices(plain, k=30)) + (" grubwort" if k % 2 == 0 else ""), "fr") for k in range(30)]
    assert b" grubwort " in toxicity.fit_rows(texts + other).toxic


def test_named_values_are_candidates_at_any_length(spark, frame):
    texts = ['a password: "hunter2pass" b', "token='abc123def456'", "password=hunter2pass, x", "password = S!@#$x9% y", 'secret: "two words!"', "AWS_SECRET_ACCESS_KEY=k1", "ends with token=", "next thisisalongrunofcharacters"]
    text, row, at, named = secrets.candidates(pa.array(texts, pa.large_string()))
    assert list(zip(row.tolist(), text, named)) == [(0, "hunter2pass", True), (1, "abc123def456", True), (2, "hunter2pass", True), (3, "S!@#$x9%", True), (4, "two words!", True), (5, "k1", True), (7, "thisisalongrunofcharacters", False)]
    assert all(texts[r].encode()[a:].startswith(t.encode()) for t, r, a in zip(text, row, at))
    r = random.Random(6)
    many = [f'{words(k, 20)} password: "{"".join(r.choices("abcdef0123456789!@#", k=11))}" ' + "".join(words(k + 900, 6).split()) for k in range(200)]
    got = secrets.scan(frame(rows(many))).collect()
    assert sum(x["is_secret"] for x in got if len(x["candidate"]) == 11) >= 190
    assert sum(x["is_secret"] for x in got if len(x["candidate"]) != 11) <= 4


def test_scores_match_brute_force():
    r = random.Random(11)
    secret = ["k" + "".join(r.choices("0123456789abcdefXYZ!-", k=r.choice((5, 9, 9, 9, 20)))) for _ in range(120)] + ["é", "a"]
    plain = [words(k, 1) + str(k) for k in range(200)] + ["", "x", "é9"]
    made = secrets.grammars(secret)
    cells, _ = secrets.Background.cells(plain)
    ground = secrets.Background(np.bincount(cells, minlength=(secrets.SYMBOLS + 1) ** 3))
    count = Counter()
    walk = lambda t: [128, 128, *secrets.symbols(t), 128]
    for t in plain:
        w = walk(t)
        count.update(zip(w, w[1:], w[2:]))
    ctx = Counter()
    for (a, b, _), n in count.items():
        ctx[a, b] += n
    some = secret[:20] + plain[:20] + plain[-3:] + ["Q" * 3000, "\x01"]
    got, name = secrets.ratios(some, secrets.Formats(made), ground)
    for t, g, k in zip(some, got, name):
        w = walk(t)
        low = sum(math.log((count[x] + 0.05) / (ctx[x[:2]] + 0.05 * 129)) for x in zip(w, w[1:], w[2:])) / (len(w) - 2)
        high = max(a.score(t) for a in made.values())
        assert abs(made[k].score(t) - high) < 1e-9 and abs(g - (high - low)) < 1e-5


def test_planted_secrets_are_found_and_words_are_not(spark, frame):
    """Keys of varying length, a third of them without a name before; numbers, dates and versions beside them."""
    r = random.Random(12)
    make = lambda: "sk_" + "".join(r.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=r.randrange(9, 30)))
    texts, where = [], {}
    for k in range(600):
        t = f"{words(k, 30)} 2024-0{k % 9 + 1}-11 v1.{k}.0-rc{k % 4} page{k % 50}of{k % 60 + 100}"
        if k % 2:
            where[k] = make()
            t += f' secret: "{where[k]}"' if k % 3 else f" see {where[k]} "
        texts.append(t)
    got = secrets.scan(frame(rows(texts) + rows(texts[:2], 700))).collect()
    hit = [x for x in got if x["is_secret"]]
    true = sum(where.get(x["doc_id"] % 700) == x["candidate"] for x in hit)
    assert true >= 0.95 * (len(where) + 1) and true >= 0.95 * len(hit)


def test_texts_go_to_python_in_steps_of_bytes(spark, frame, monkeypatch):
    docs, batch = frame(rows([words(k, 400) * 30 for k in range(240)])).coalesce(1), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(batch)

    def sizes(*_):
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([0.0]), pa.array([0.0])], ["doc_id", "log_weight", "gumbel_key"]) for b in batches)

    try:
        with monkeypatch.context() as m:
            m.setattr(quality, "_scorer", sizes)
            sent = [r[0] for r in quality.scores(docs, np.zeros(quality.BUCKETS)).collect()]
        assert sum(sent) > 4 * common.BATCH_BYTES and max(sent) < 1.5 * common.BATCH_BYTES
        bench = spark.createDataFrame([(1, words(1, 20))], "item_id long, text string")
        for made in (lambda: minhash.signatures(docs), lambda: decontaminate.leaks(docs, bench), lambda: decontaminate.without_leaks(docs, bench)):
            spark.conf.set(batch, "64m")
            made()
            assert spark.conf.get(batch) == str(common.BATCH_BYTES)
        spark.conf.set(batch, "1m")  # a lower bound of the session's own stays
        minhash.signatures(docs)
        assert spark.conf.get(batch) == "1m"
    finally:
        spark.conf.set(batch, before)


def test_models_and_signatures_take_bounded_memory():
    texts = pa.array([words(k, 200) * 10 for k in range(600)], pa.large_string())
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    tracemalloc.start()
    try:
        (counted,) = quality._count([batch])
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()
    # steps change no result
    whole = np.bincount(quality.features(kernel.as_text(texts))[0], minlength=quality.BUCKETS)
    assert (whole[counted["bucket"].to_numpy()] == counted["n"].to_numpy()).all() and whole.sum() == sum(counted["n"].to_pylist())
