"""Long repeats across documents by a run-length index (r-index).

A passage is a maximal run of words each of which lies in a window of MIN_WORDS
words that also occurs in another document.  All text is covered:

1. Every window of MIN_WORDS words is assigned its minimizer, the least hash of
   the 8-word grams in it.  Neighbouring windows with one minimizer form a piece.
   Equal windows have equal minimizers, so pieces whose minimizer only one
   document has can't match and go before any words are moved.
2. The words of the remaining pieces are hashed to 32 bits; equal contents are
   merged (with the knowledge whether one or more documents have them), so a
   passage with millions of copies is indexed once.
3. Contents are grouped by minimizer into buckets of bounded expected size.  For
   each bucket the suffixes are sorted, the Burrows-Wheeler transform is run
   length compressed, and only samples at the ends of runs are kept: the text
   position there, its neighbour's and the length they share.
4. Matching statistics are streamed over the contents with those samples alone.
   Within a run, phi(p) = phi(p - 1) + 1 and the shared length falls by 1, so a
   predecessor search finds the neighbour of any position and how far they
   agree.  Neighbours of the same document are passed over along phi.
5. Windows that agree over MIN_WORDS are joined to passages.

A document is a distinct (doc_id, text): repeated rows don't match themselves.
Words are lower-case runs of letters and digits; equality of two words is
equality of 32-bit hashes, documents and minimizers are told apart by 64 bits.  Null, empty and short texts have no passage; null
doc_ids are kept as such.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel as K
from gleaner.llm.common import written

MIN_WORDS, GRAM = 50, 8
BUCKET_WORDS = 400_000
#: words whose windows are looked at together; with the window after them less than 2^24
PART_WORDS = 1 << 23


def pieces(arr: pa.Array, k: int = MIN_WORDS, m: int = GRAM, part: int = PART_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, minimizer, first window's word in the document, windows) of every piece."""
    data, off = K.flat(arr)
    s, e, row = K.spans(data, off)
    h = K.hashes(data, s, e)
    first = K.per_row(row, len(off) - 1)
    # a very long text takes several parts, each with the k - 1 words after it that its windows need
    found = [_part(h[x : x + part + k - 1], row[x : x + part + k - 1], k, m, x) for x in range(0, max(1, len(s) - k + 1), part)]
    row, low, at, n = (np.concatenate(v) for v in zip(*found))
    return row, low, at - first[row], n


def _part(h: np.ndarray, row: np.ndarray, k: int, m: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, minimizer, first window's word, windows) of the pieces of words from begin on."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n, w = len(h) - k + 1, k - m + 1
    if n <= 0:
        return none
    g, at = K.grams(h, row, m)
    full = np.full(len(h), np.iinfo(np.uint64).max)
    full[at] = g
    # 40 bits of the hash, then the position: a tie goes to the leftmost
    place = np.uint64(24)
    key = (full >> place << place) | np.arange(len(h), dtype=np.uint64)
    low, span = key, 1
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[w - span : w - span + n])
    ok = np.flatnonzero(row[:n] == row[k - 1 :])
    if not len(ok):
        return none
    where = (low[ok] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero((np.diff(where, prepend=-1) != 0) | (np.diff(ok, prepend=-2) != 1))
    return row[ok[new]], full[where[new]], ok[new] + begin, np.diff(np.append(new, len(ok)))


def _pieces(batches):
    for batch in batches:
        for at, part in K.chunks(batch.column(1)):
            row, h, start, n = pieces(part)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row + at)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "rk", "start", "n"]
                )


def _contents(batches):
    """The words of the pieces that are asked for."""
    for batch in batches:
        want = batch.column(2)
        lists = np.asarray(want.offsets)
        asked = want.flatten()
        h, start, n = (asked.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        lists = lists - lists[0]
        for at, part in K.chunks(batch.column(1)):
            data, off = K.flat(part)
            s, e, row = K.spans(data, off)
            x = (K.hashes(data, s, e) >> np.uint64(32)).astype("<u4")
            first = K.per_row(row, len(off) - 1)
            lo, hi = lists[at], lists[at + len(part)]
            r = np.repeat(np.arange(len(part)), np.diff(lists[at : at + len(part) + 1]))
            a = first[r] + start[lo:hi]
            b = a + n[lo:hi] + (MIN_WORDS - 1)
            raw = x.tobytes()
            text = [raw[4 * i : 4 * j] for i, j in zip(a.tolist(), b.tolist())]
            for q in range(0, len(text), 50_000):
                t = slice(q, q + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[lo:hi][t]), batch.column(0).take(pa.array(r[t] + at)), pa.array(start[lo:hi][t].astype(np.int32)), pa.array(text[t], pa.binary())], ["h", "rk", "start", "words"]
                )


class RunLengthIndex:
    """Run-compressed BWT of a collection with samples at run ends.

    text: symbols; each of the n_texts texts ends with a symbol of its own that is
    less than all others.  Kept are only the samples: positions whose rank begins
    (ends) a run, the position of the rank before (after), and the shared length.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        # prefix doubling; a rank is the number of suffixes that sort before, so a group of ties keeps its first place
        order = np.argsort(text, kind="stable")
        srt = text[order]
        idx = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], srt[1:] != srt[:-1]])[:n], idx, 0)) if n else idx
        step = 1
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if n else idx
        while len(tied):
            # the last symbol is a text's end, which never ties, so tied + step is in range
            key = rank[tied] * (n + 1) + rank[np.minimum(tied + step, n - 1)] + 1
            o = np.argsort(key, kind="stable")
            t, key = tied[o], key[o]
            base = rank[t]
            i = np.arange(len(t))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], base[1:] != base[:-1]]), i, 0))
            own = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), i, 0))
            rank[t] = base + (own - group)
            size = np.diff(np.append(np.unique(own), len(t)))
            tied = np.sort(t[np.repeat(size, size) > 1])
            step *= 2
        self.n = n
        sa = np.empty(n, np.int64)
        sa[rank if n else []] = np.arange(n)
        bwt = text[sa - 1]
        edge = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.runs = len(edge) + 1 if n else 0
        self.run_heads, self.run_lengths = bwt[np.concatenate([[0], edge])] if n else bwt, np.diff(np.concatenate([[0], edge, [n]]))
        pad = np.concatenate([text, np.arange(-1, -1 - 256, -1)])

        def shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            out = np.zeros(len(p), np.int64)
            live = np.arange(len(p))
            d = 0
            while len(live):
                live = live[(np.maximum(p[live], q[live]) + d < n) & (pad[np.minimum(p[live] + d, n)] == pad[np.minimum(q[live] + d, n)])]
                out[live] += 1
                d += 1
            return out

        a, b = sa[edge], sa[edge - 1]
        both = shared(a, b)
        # rank 0 begins the first run and has no rank before; the last has none after
        self.up = self._samples(np.append(a, sa[:1]), np.append(b, [-1] * bool(n)), np.append(both, [0] * bool(n)))
        self.down = self._samples(np.append(b, sa[n - 1 :]), np.append(a, [-1] * bool(n)), np.append(both, [0] * bool(n)))

    @staticmethod
    def _samples(at, to, shared):
        o = np.argsort(at)
        return at[o], to[o], shared[o]

    def neighbour(self, p: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray]:
        """(position of the suffix one rank before or after that of p, shared length); -1 and 0 at the ends."""
        at, to, shared = self.up if up else self.down
        k = np.searchsorted(at, p, "right") - 1
        d = p - at[k]
        q = np.where(to[k] < 0, -1, to[k] + d)
        return q, np.where(q < 0, 0, np.maximum(shared[k] - d, 0))


def marks(words: list[np.ndarray], owner: np.ndarray, shared: np.ndarray, k: int = MIN_WORDS) -> list[np.ndarray]:
    """For each content: which of its windows of k words occur in another document.

    owner: the document of a content that only one has; shared: whether more have it.
    """
    n = len(words)
    size = np.array([len(w) for w in words])
    flat = np.concatenate(words)
    _, code = np.unique(flat, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.empty(begin[-1], np.int64)
    sep = begin[1:] - 1
    body = np.ones(len(text), bool)
    body[sep] = False
    text[sep] = np.arange(n)
    text[body] = code + n
    own = np.repeat(np.arange(n), size + 1)
    index = RunLengthIndex(text)
    windows = np.maximum(size - k + 1, 0)
    p = np.repeat(begin[:-1], windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    hit = shared[own[p]].copy() if len(p) else np.zeros(0, bool)
    for up in (True, False):
        live = np.flatnonzero(~hit)
        at, least = p[live], np.full(len(live), 1 << 40)
        while len(live):
            at, length = index.neighbour(at, up)
            least = np.minimum(least, length)
            ok = least >= k
            live, at, least = live[ok], at[ok], least[ok]
            me, it = own[p[live]], own[at]
            found = shared[it] | (owner[it] != owner[me])
            hit[live[found]] = True
            live, at, least = live[~found], at[~found], least[~found]
    return np.split(hit, np.cumsum(windows)[:-1])


def _bucket(t: pa.Table) -> pa.Table:
    words = [np.frombuffer(x, "<u4") for x in t.column("words").to_pylist()]
    lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
    found = marks(words, lo, lo != hi)
    which, a, b = [], [], []
    for i, m in enumerate(found):
        d = np.diff(np.concatenate([[0], m.view(np.int8), [0]]))
        x, y = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        which += [i] * len(x)
        a += x.tolist()
        b += (y + (MIN_WORDS - 1)).tolist()
    return pa.table({"h": t.column("h").take(pa.array(which, pa.int64())), "c": t.column("c").take(pa.array(which, pa.int64())), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})


def _merge(batches):
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        off = np.asarray(lists.offsets)
        flat = lists.flatten()
        a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        off = off - off[0]
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        if not len(row):
            continue
        # lists are sorted; far shifts keep the rows apart
        far = int(b.max()) + 2
        x, y = a.astype(np.int64) + row * far, np.maximum.accumulate(b.astype(np.int64) + row * far)
        new = np.flatnonzero(np.concatenate([[True], x[1:] > y[:-1]]))
        s, e, r = x[new] - row[new] * far, y[np.append(new[1:], len(x)) - 1] - row[new] * far, row[new]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array((e - s).astype(np.int32))], ["doc_id", "start_word", "end_word", "n_words"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): every passage of at least MIN_WORDS words that other documents share.

    start_word counts the document's words from 0; end_word is exclusive.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    keyed = d.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    # a piece's row is 24 bytes; words follow only for those that can match
    p = written(keyed.select("rk", "text").mapInArrow(_pieces, "h long, rk long, start int, n int"))
    many = p.groupBy("h").agg(F.min("rk").alias("lo"), F.max("rk").alias("hi")).filter("lo <> hi").select("h")
    asked = written(p.join(many, "h", "left_semi").groupBy("rk").agg(F.collect_list(F.struct("h", "start", "n")).alias("want")))
    words = asked.agg(F.sum(F.expr(f"aggregate(want, 0L, (s, x) -> s + x.n + {MIN_WORDS - 1})"))).first()[0] or 0
    c = written(
        keyed.join(asked, "rk").select("rk", "text", "want").mapInArrow(_contents, "h long, rk long, start int, words binary").withColumn("c", F.xxhash64("words"))
    )
    buckets = max(1, -(-words // BUCKET_WORDS))
    distinct = c.groupBy("h", "c").agg(F.first("words").alias("words"), F.min("rk").alias("lo"), F.max("rk").alias("hi"))
    spans = distinct.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket, "h long, c long, a int, b int")
    found = c.select("h", "c", "rk", "start").join(spans, ["h", "c"]).select("rk", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    per = found.groupBy("rk").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("l"))
    ids = keyed.select("rk", "doc_id").join(asked.select("rk"), "rk", "left_semi").distinct()
    return ids.join(per, "rk").select("doc_id", "l").mapInArrow(_merge, "doc_id long, start_word int, end_word int, n_words int")
