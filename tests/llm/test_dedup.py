"""Near duplicates, benchmark passages and repeats against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa

from gleaner.llm import decontaminate, kernel, minhash, repeats

from .conftest import rows, words


def _grams(t, n=3):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _edited(t, seed, share):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in t.split())


def test_signatures_estimate_jaccard():
    base = words(1, 600)
    other = _edited(base, 2, 0.05)
    true = len(_grams(base) & _grams(other)) / len(_grams(base) | _grams(other))
    sig = minhash.pack(minhash.minima(kernel.as_text(pa.array([base, other, words(9, 600)])))[1])
    assert abs(minhash.similarity(sig[0], sig[1]) - true) < 0.12
    assert minhash.similarity(sig[0], sig[2]) < 0.2
    assert minhash.similarity(sig[0], sig[0]) == 1


def test_near_groups_match_brute_force(frame):
    texts = [words(s, 120) for s in range(30)]
    texts += [_edited(texts[k], 50 + k, 0.02) for k in range(20)] + [texts[0]] * 5
    got = {r["doc_id"]: r["keeper"] for r in minhash.near_groups(frame(rows(texts))).collect()}
    jac = lambda a, b: len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b))
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jac(texts[i], texts[j]) >= 0.6:
            root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    want = {i: r for i, r in enumerate(root) if i != r}
    assert sum(got.get(i) == r for i, r in want.items()) >= 0.9 * len(want)
    assert set(got) <= set(want) | {j for i, j in itertools.combinations(range(len(texts)), 2) if jac(texts[i], texts[j]) > 0.35}


def test_keep_one(frame, odd, empty):
    texts = [words(s, 90) for s in range(6)]
    docs = frame(rows(texts + texts[:3]))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(6))
    left = minhash.keep_one(odd).collect()
    assert sum(r["doc_id"] == 100 for r in left) == 1
    # rows without an id or a word stay, repeated ones too
    assert sum(r["doc_id"] is None for r in left) == 3 and {1, 2, 3, 4} <= {r["doc_id"] for r in left}
    assert not minhash.keep_one(empty).count() and not minhash.near_groups(empty).count()


def test_other_texts_of_a_doc_id_stay(frame):
    a, b = words(1, 60), words(2, 60)
    docs = frame([(i, t) + ("en", "s", 1, "x", "y", "z", 7, "k", "q", 1, "t") for i, t in ((1, a), (5, a), (5, b))])
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep_one(docs).collect()) == [(1, a), (5, b)]
    assert [(r["doc_id"], r["keeper"]) for r in minhash.near_groups(docs).collect()] == [(5, 1)]
    # 5 is a copy of 1 by one text and 9 a copy of 5 by the other: one row of each text stays
    docs = frame([(i, t) + ("en", "s", 1, "x", "y", "z", 7, "k", "q", 1, "t") for i, t in ((5, a), (9, a), (5, b), (1, b), (6, a), (6, b))])
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep_one(docs).collect()) == [(1, b), (5, a)]


def test_hot_bands_lose_no_link(frame):
    texts = [_edited(words(1, 100), 10 + k, 0.01 * (k % 4)) for k in range(120)] + [words(50 + k, 80) for k in range(20)] + ["x", "x y", "y x", "x y"]
    docs = frame(rows(texts))
    want = {tuple(r) for r in minhash.near_groups(docs).select("doc_id", "keeper").collect()}
    got = {tuple(r) for r in minhash.near_groups(docs, most=16, share=1).select("doc_id", "keeper").collect()}
    assert got == want and len(want) > 100 and (143, 141) in want
    hot = frame([(7, "one text of many words that repeats", "en", "s", 1) + ("x",) * 3 + (7, "k", "q", 1, "t")] * 3000 + [(8, "another text of many words", "en", "s", 1) + ("x",) * 3 + (7, "k", "q", 1, "t")])
    assert sorted(r["doc_id"] for r in minhash.keep_one(hot).collect()) == [7, 8]


def test_infix_distance_is_exact():
    def slow(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, x in enumerate(text):
                new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    r = random.Random(3)
    for _ in range(60):
        item = bytes(r.choice(b"abc ") for _ in range(r.randrange(1, 12)))
        text = bytes(r.choice(b"abc ") for _ in range(r.randrange(0, 20)))
        assert decontaminate.infix_distance(item, text, 99) == slow(item, text)


def _typos(t, seed, n):
    r, out = random.Random(seed), list(t)
    for _ in range(n):
        k = r.randrange(len(out))
        out[k : k + 1] = r.choice(["", "x", out[k] + "y"])
    return "".join(out)


def test_leaks_match_brute_force(spark, frame, odd, empty):
    items = [words(100 + k, 8 + 3 * k, 900) for k in range(12)] + ["ab c", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [words(s, 150) for s in range(40)]
    planted = set()
    for k in range(36):
        i = k % 12
        t = texts[k].split()
        texts[k] = " ".join(t[:60]) + " " + _typos(items[i], k, int(0.06 * len(items[i]))) + " " + " ".join(t[60:])
        planted.add((k, i))
    texts[39] = "so AB, c! is here"
    got = {(r["doc_id"], r["item_id"]): r["edit_distance"] for r in decontaminate.leaks(frame(rows(texts)), bench).collect()}
    assert len(planted & set(got)) >= 0.9 * len(planted) and got[39, 12] == 0
    norm = lambda t: b" ".join("".join(c if c.isalnum() else " " for c in t.lower()).encode().split())
    for (d, i), dist in got.items():
        x = norm(items[i])
        assert decontaminate.infix_distance(x, norm(texts[d]), len(x)) == dist <= max(0, int(decontaminate.MAX_EDITS * len(x)))
    kept = decontaminate.without_leaks(frame(rows(texts)), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(40)) - {d for d, _ in got}
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.without_leaks(odd, bench).count() == 9
    assert not decontaminate.leaks(empty, bench).count() and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    # several passes over a larger benchmark find the same
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(rows(texts)), bench, 200).collect()} == set(got)


def _brute_repeats(docs, k):
    toks = {d: [w for w in t.lower().split()] for d, t in docs.items()}
    where = {}
    for d, w in toks.items():
        for i in range(len(w) - k + 1):
            where.setdefault(tuple(w[i : i + k]), set()).add(d)
    out = set()
    for d, w in toks.items():
        hit = [len(where[tuple(w[i : i + k])]) > 1 for i in range(len(w) - k + 1)]
        i = 0
        while i < len(hit):
            if hit[i]:
                j = i
                # passages that touch or overlap are one
                while j + 1 < len(hit) and any(hit[j + 1 : j + 1 + k]):
                    j = j + 1 + hit[j + 1 : j + 1 + k].index(True)
                out.add((d, i, j + k))
                i = j + 1
            else:
                i += 1
    return out


def test_repeats_match_brute_force(frame, odd, empty):
    passages = [words(300 + k, 55 + 20 * k, 900) for k in range(4)]
    texts = []
    for s in range(24):
        t = words(s, 140, 900).split()
        for k in (s % 4, (s * 3 + 1) % 4):
            at = 20 + 50 * (k % 2)
            t[at:at] = passages[k].split()
        texts.append(" ".join(t))
    texts += [words(77, 300), words(78, 49), texts[0]]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in repeats.repeats(frame(rows(texts))).collect()}
    assert got == _brute_repeats(dict(enumerate(texts)), repeats.MIN_WORDS)
    assert {r["doc_id"] for r in repeats.repeats(odd).collect()} == {None, 100}  # the null row's text is 100's
    assert not repeats.repeats(empty).count()


def test_run_length_index():
    r = np.random.default_rng(4)
    text = np.concatenate([r.integers(2, 5, 300), [0]])
    index = repeats.RunLengthIndex(text)
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    rank = {p: k for k, p in enumerate(order)}
    bwt = [text[p - 1] for p in order]
    assert np.repeat(index.run_heads, index.run_lengths).tolist() == bwt
    for p in range(len(text)):
        for up in (True, False):
            k = rank[p] + (-1 if up else 1)
            q, n = (int(x[0]) for x in index.neighbour(np.array([p]), up))
            if not 0 <= k < len(order):
                assert q == -1
                continue
            assert q == order[k]
            same = 0
            while p + same < len(text) and q + same < len(text) and text[p + same] == text[q + same]:
                same += 1
            assert n == same


def test_kernel_tokens_do_not_cross_documents():
    data, off = kernel.flat(kernel.as_text(pa.array(["Ab c", "", "d É", None])))
    s, e, row = kernel.spans(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["ab", "c", "d", "é"] and row.tolist() == [0, 0, 2, 2]
    whole = kernel.hashes(data, s, e)
    alone = kernel.flat(kernel.as_text(pa.array(["c"])))
    assert kernel.hashes(alone[0], np.array([0]), np.array([1]))[0] == whole[1]


def test_short_items_are_found_at_all_alignments():
    """Copies and items with as many edits as are allowed, of 8 to 50 bytes, after 0 to 3 words more."""
    r = random.Random(12)
    make = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9)))
    for low, high in ((8, 15), (16, 23), (24, 31), (32, 39), (40, 50)):
        items = []
        while len(items) < 100:
            t = make()
            while len(t) < low:
                t += " " + make()
            if len(t) <= high:
                items.append(t)
        index = decontaminate.Index(list(range(100)), items)
        for share in (0, decontaminate.MAX_EDITS):
            hit = 0
            for shift in range(4):
                docs = [" ".join(make() for _ in range(20 + shift)) + " " + _typos(t, shift, int(share * len(t))) + " " + " ".join(make() for _ in range(20)) for t in items]
                found = {(d, i) for d, i, _ in index.leaks(pa.array(docs, pa.large_string()))}
                hit += sum((k, k) in found for k in range(100))
            assert hit >= (0.9 if share else 1) * 400, (low, high, share, hit)


def test_recall_at_the_bound():
    """Items of 4 to 60 words with nearly as many edits as are allowed."""
    r = random.Random(21)
    vocabulary = words(31, 3000, 3000).split()
    some = lambda n: " ".join(r.choices(vocabulary, k=n))
    for n in (4, 8, 12, 20, 60):
        items = [some(n) for _ in range(100)]
        index = decontaminate.Index(list(range(100)), items)
        docs = [some(r.randrange(20, 40)) + " " + _typos(x, k, int(0.09 * len(x))) + " " + some(30) for k, x in enumerate(items)]
        found = {(d, i) for d, i, _ in index.leaks(pa.array(docs, pa.large_string()))}
        assert sum((k, k) in found for k in range(100)) >= 95, n


def test_tiny_items_match_between_words():
    items = ["ab", "ab c", "a", "é x"]
    index = decontaminate.Index(list(range(4)), items)
    got = index.leaks(pa.array(["AB, c!", "xab c", "ab", "a  b", "É-x", "", None], pa.large_string()))
    assert {(d, i) for d, i, _ in got} == {(0, 0), (0, 1), (2, 0), (3, 2), (4, 3)}


def test_pieces_of_very_long_texts():
    """Parts of a text give the windows that one pass gives."""
    texts = kernel.as_text(pa.array([words(1, 900, 60), words(2, 30), "", words(3, 400, 60)]))
    def spread(p):
        return {(r, h, a + k) for r, h, a, n in zip(*(x.tolist() for x in p)) for k in range(n)}
    assert spread(repeats.pieces(texts)) == spread(repeats.pieces(texts, part=64))
    long = np.full(1 << 24, 97, np.uint8)
    long[1::2] = 32
    text = kernel.as_text(pa.array([long.tobytes().decode() * 3]))
    assert repeats.pieces(text)[3].sum() == 3 * (1 << 23) - repeats.MIN_WORDS + 1
