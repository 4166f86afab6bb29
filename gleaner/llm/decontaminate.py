"""Benchmark decontamination by CGK embeddings.

Chakraborty, Goldenberg and Koucky's random walk embeds edit distance into
Hamming distance: at step t the walk writes its current character and moves on
if a random bit R[t, character] is set, so walks over strings that differ by few
edits meet again soon.  Windows of the documents and of the benchmark items are
embedded by several independent walks; of each embedding a sample of coordinates
is hashed to a key (bit-sampling LSH), and equal keys give candidates.  Each
candidate that passes the q-gram lemma (k edits destroy at most 5k of the item's
5-grams, so the filter loses nothing) is verified by the exact edit distance of the whole item to the best
substring of the document around it (Myers' bit-parallel form of Sellers'
algorithm), in bytes of the normalised text.

Item windows begin at every word of the item that leaves room for one, document
windows at every STRIDE-th word, or more often if an item of the class has fewer
windows than that, so each whole occurrence holds an aligned pair of windows.
Windows of short items use an early part of the walk (classes); as they have few
windows, or one, theirs begin at every word of a document and have more walks.
The walks (WALKS) are as many as find 0.95 of the items with as many edits as are allowed.

Normalised text: lower case, every run of characters that are neither letters
nor digits is one space.  An item leaks into a document if some substring of the
document is within MAX_EDITS x the item's length of it.

Cases: null, empty or wordless texts neither leak nor match; an item of fewer
than 8 bytes must match exactly, between word boundaries.  Repeated rows and
repeated items each count once in the result (doc_id, item_id); a null doc_id is
kept as such.  An empty benchmark matches nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel as K
from gleaner.llm.common import in_steps

STRIDE, SAMPLED, MAX_EDITS = 4, 10, 0.1
#: (steps of the walk, bytes that an item window must have at least)
CLASSES = ((64, 40), (28, 16), (12, 8))
#: independent walks of each class
WALKS = {64: 9, 28: 24, 12: 24}
#: bytes of benchmark text that one pass holds; a larger benchmark takes several passes
PASS_BYTES = 64 << 20

_rng = np.random.default_rng(977)
_MOVE = _rng.integers(0, 2, (5, CLASSES[0][0], 256), dtype=np.uint8)
_PICK = {steps: [set(_rng.choice(steps, SAMPLED, replace=False).tolist()) for _ in range(5)] for steps, _ in CLASSES}
_MOVE = np.concatenate([_MOVE, _rng.integers(0, 2, (max(WALKS.values()) - 5, CLASSES[0][0], 256), dtype=np.uint8)])
for _c, _p in _PICK.items():
    _p += [set(_rng.choice(_c, SAMPLED, replace=False).tolist()) for _ in range(WALKS[_c] - 5)]


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: tuple[int, ...]) -> dict[tuple[int, int], np.ndarray]:
    """{(steps, walk): key of the window at each start}; past its end a window reads spaces."""
    out = {}
    pad = np.concatenate([data, np.full(CLASSES[0][0] + 1, 32, np.uint8)])
    steps, every = max(classes, default=0), classes
    # only windows that near the end of their text can pass it
    near = np.flatnonzero(ends - starts < steps)
    last = ends[near]
    ch, move = np.empty(len(starts), np.uint8), np.empty(len(starts), np.uint8)
    for w in range(max((WALKS[c] for c in classes), default=0)):
        classes = [c for c in every if w < WALKS[c]]
        at = starts.astype(np.intp)
        acc = {c: np.full(len(starts), w + 1, np.uint64) for c in classes}
        for t in range(max(classes)):
            np.take(pad, at, out=ch, mode="clip")
            ch[near] = np.where(at[near] < last, ch[near], np.uint8(32))
            for c in classes:
                if t < c and t in _PICK[c][w]:
                    acc[c] *= np.uint64(0x100000001B3)
                    acc[c] += ch
            np.take(_MOVE[w, t], ch, out=move, mode="clip")
            at += move
        for c in classes:
            out[c, w] = K.mix(acc[c])
    return out


def infix_distance(item: bytes, text: bytes, most: int) -> int:
    """Least edit distance of item to a substring of text, most + 1 if over most."""
    if item in text:
        return 0
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return best if best <= most else most + 1


def fivegrams(data: np.ndarray) -> np.ndarray:
    """A 16-bit code for each five bytes in a row."""
    d = data.astype(np.uint32)
    n = len(d) - 4
    x = np.zeros(max(0, n), np.uint32)
    for k in range(5 if n > 0 else 0):
        x *= np.uint32(0x01000193)
        x += d[k : k + n]
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.uint16)


class Index:
    """Window keys of the items of one pass."""

    def __init__(self, ids: list, texts: list[str | None]):
        data, off = K.squeeze(*K.flat(pa.array(texts, pa.large_string())))
        raw = data.tobytes()
        self.ids, self.items = [], []
        for k, i in enumerate(ids):
            if x := raw[off[k] : off[k + 1]].rstrip(b" "):
                self.ids.append(i)
                self.items.append(x)
        self.tiny = {i: x for i, x in enumerate(self.items) if len(x) < CLASSES[-1][1]}
        # items too short for a window, by their number of words: hashes of the words in a row
        self.short, count = {}, {i: x.count(b" ") + 1 for i, x in self.tiny.items()}
        for n in sorted(set(count.values())):
            of = [i for i, k in count.items() if k == n]
            tiny = pa.array([self.items[i].decode() for i in of], pa.large_string())
            h = K.hashes(*(d := K.flat(tiny, lower=False))[:1], *K.spans(*d)[:2])
            g = h if n == 1 else K.grams(h, K.spans(*d)[2], n)[0]
            o = np.argsort(g, kind="stable")
            self.short[n] = (g[o], np.array(of)[o])
        rows, starts, ends = [], [], []
        at, buf = 0, []
        for i, x in enumerate(self.items):
            if i not in self.tiny:
                s = [0, *(k + 1 for k, c in enumerate(x) if c == 32)]
                rows += [i] * len(s)
                starts += [at + k for k in s]
                ends += [at + len(x)] * len(s)
            buf.append(x + b" ")
            at += len(x) + 1
        row, start, end = (np.array(v, np.int64) for v in (rows, starts, ends))
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in self.items])])
        data = np.frombuffer(b"".join(buf), np.uint8)
        room = end - start
        length = np.array([len(x) for x in self.items], np.int64)[row] if len(row) else row
        # an item's class is the largest whose windows still fit twice, else the largest that fits
        cls = np.zeros(len(row), np.int64)
        for c, b in reversed(CLASSES):
            cls[(length >= 2 * b) | ((cls == 0) & (length >= b))] = c
        need = {c: b for c, b in CLASSES}
        ok = np.array([r >= need.get(int(c), 1 << 30) for r, c in zip(room, cls)], bool) if len(row) else np.zeros(0, bool)
        self.classes = tuple(sorted({int(c) for c in cls[ok]}, reverse=True))
        # every occurrence has a window where a document's begins: no item has fewer than the stride
        self.stride = {c: 1 if c != CLASSES[0][0] else min(STRIDE, int(np.unique(row[ok & (cls == c)], return_counts=True)[1].min())) for c in self.classes}
        self.table = {}
        for (c, w), k in keys(data, start[ok], end[ok], self.classes).items():
            use = cls[ok] == c
            o = np.argsort(k[use], kind="stable")
            known = np.zeros(1 << 20, bool)
            known[k[use] >> np.uint64(44)] = True
            self.table[c, w] = (known, k[use][o], row[ok][use][o], (start[ok] - begin[row[ok]])[use][o])
        self.codes = [fivegrams(np.frombuffer(x, np.uint8)) for x in self.items]

    def leaks(self, arr: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, edit distance) of the items that leak into these texts."""
        data, off = K.squeeze(*K.flat(arr))
        found: dict[tuple[int, int], int] = {}
        raw = data.tobytes()
        if self.short:
            s, e, row = K.spans(data, off)
            h = K.hashes(data, s, e)
            for n, (have, of) in self.short.items():
                g, at = (h, np.arange(len(h))) if n == 1 else K.grams(h, row, n)
                lo, hi = np.searchsorted(have, g, "left"), np.searchsorted(have, g, "right")
                for k in np.flatnonzero(hi > lo).tolist():
                    for i in of[lo[k] : hi[k]].tolist():
                        if self.items[i] == raw[s[at[k]] : e[at[k] + n - 1]]:
                            found[int(row[at[k]]), i] = 0
        if self.classes and len(data):
            s = np.flatnonzero((data != 32) & (np.concatenate([[32], data[:-1]]) == 32))
            # texts end with a space if they have a word, so no word spans two of them
            cut = np.searchsorted(s, off)
            row = np.repeat(np.arange(len(off) - 1), np.diff(cut))
            nth, word, of = np.arange(len(s)) - cut[row], s, row
            cand = []
            for c, w, k, s, row in (
                (c, w, k, word[use], of[use]) for c in self.classes for use in [nth % self.stride[c] == 0] for (_, w), k in keys(data, word[use], off[of[use] + 1], (c,)).items()
            ):
                known, have, item, shift = self.table[c, w]
                hit = np.flatnonzero(known[k >> np.uint64(44)])
                lo, hi = np.searchsorted(have, k[hit], "left"), np.searchsorted(have, k[hit], "right")
                hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                cand.append(np.stack([np.repeat(row[hit], n), item[at], np.repeat(s[hit], n) - shift[at]], 1))
            every = np.concatenate(cand)
            last, seen, code = None, np.zeros(1 << 16, bool), fivegrams(data)
            for r, i, at in np.unique(every, axis=0).tolist() if len(every) else ():
                x = self.items[i]
                most = int(MAX_EDITS * len(x))
                slack = most + 1
                if last and last[:2] == (r, i) and at - last[2] <= slack // 2 or found.get((r, i)) == 0:
                    continue
                last = (r, i, at)
                lo, hi = max(off[r], at - 2 * slack), min(off[r + 1], at + len(x) + 2 * slack)
                seen[code[lo : max(lo, hi - 4)]] = True
                n = np.count_nonzero(seen[self.codes[i]])
                seen[code[lo : max(lo, hi - 4)]] = False
                if n < len(x) - 4 - 5 * most:
                    continue
                d = infix_distance(x, raw[lo:hi], most)
                if d <= most:
                    found[r, i] = min(d, found.get((r, i), d))
        return [(r, i, d) for (r, i), d in sorted(found.items())]


def passes(benchmark: DataFrame, pass_bytes: int = PASS_BYTES):
    """The items in slices of a checked size: each is small enough to send to every executor."""
    b = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t"))
    size = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // pass_bytes))
    for k in range(n):
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = part.collect()
        yield Index([r[0] for r in rows], [r[1] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, edit_distance), one row for each document and item that it holds."""
    out = None
    for index in passes(benchmark, pass_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                ids = batch.column(0)
                for at, part in K.chunks(batch.column(1), K.STEP_BYTES):
                    if x := index.leaks(part):
                        r, i, d = zip(*x)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(np.array(r) + at)), pa.array([index.ids[k] for k in i], pa.int64()), pa.array(d, pa.int32())], ["doc_id", "item_id", "edit_distance"]
                        )

        part = in_steps(docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").alias("t"))).mapInArrow(run, "doc_id long, item_id long, edit_distance int")
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edit_distance").alias("edit_distance"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs without the rows into whose text an item leaks; one scan, no shuffle."""
    for index in passes(benchmark, pass_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)
        where = docs.columns.index("text")

        def run(batches, held=held, where=where):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, part in K.chunks(batch.column(where), K.STEP_BYTES):
                    for r, _, _ in held.value.leaks(part):
                        keep[at + r] = False
                yield batch.filter(pa.array(keep))

        docs = in_steps(docs).mapInArrow(run, docs.schema)
    return docs


