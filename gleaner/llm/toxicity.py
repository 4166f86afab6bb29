"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic
text, and every window of a text is compressed with both.  A window's gain is
the number of bytes that the toxic dictionary saves over the ordinary one, a
document's score its greatest gain plus half of the next, and thresholds are
calibrated on held-out labelled documents.  Each language with LEAST_TOXIC toxic
labels has a pair of dictionaries and a threshold of its own; the others, and
rows without a language, share one of all languages.

Labels are of whole documents, most of whose words are harmless, so the toxic
training samples are the stretches of toxic documents whose words are far more
frequent there (LIFT times, in LEAST toxic documents) than in ordinary
ones of the same language (dictionaries of whole toxic windows are of ordinary
syllables: see the README).  All that chance can't account for, and the TELLING
most telling in any case, are in the toxic dictionary, which grows with them from
TOXIC_BYTES.  Both dictionaries are of one size and begin with the same ordinary content; one ends
with toxic content, the other with as many zeros, so a gain comes from toxic content.

At most FIT_TOXIC + FIT_ORDINARY labelled documents, chosen by hash, are used to
fit; every window of every text is scored.  Null and empty texts, and all texts
when there are no toxic or no ordinary labels to learn from, score 0 and are not
toxic.  Repeated rows and null ids are scored like others.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel as K

WINDOW, STEP, LEVEL = 64, 40, 3
ORDINARY_BYTES, TOXIC_BYTES = 8192, 512
FIT_TOXIC, FIT_ORDINARY = 2000, 4000
LEAST, LIFT, TELLING, FALSE_COST, LEAST_TOXIC = 3, 12, 12, 5.0, 20
_WORD = regex.compile(r"[^\W_]+")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    other: bytes
    least: float

    def compressors(self):
        return [
            zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d), level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            for d in (self.ordinary + self.other, self.ordinary + self.toxic)
        ]


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((offset, length) of all windows as uint64 [n, 2], row); a text's last window ends with it."""
    size = np.maximum(np.diff(off) - 1, 0)
    n = np.where(size > 0, np.maximum(0, -(-(size - WINDOW) // STEP)) + 1, 0)
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = k * STEP
    seg = np.stack([off[row] + at, np.minimum(WINDOW, size[row] - at)], 1).astype(np.uint64)
    return seg, row


def gains(arr: pa.Array, both) -> tuple[np.ndarray, np.ndarray]:
    """(gain, row) of every window."""
    data, off = K.flat(arr)
    seg, row = windows(data, off)
    if not len(row):
        return np.zeros(0, np.int64), row
    source = zs.BufferWithSegments(np.ascontiguousarray(data).tobytes(), seg.tobytes())
    plain, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(source, threads=1)), np.int64, len(row)) for c in both)
    return plain - toxic, row


def scored(arr: pa.Array, both) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, greatest gain, number of windows) of every text."""
    g, row = gains(arr, both)
    n = len(arr)
    count = np.bincount(row, minlength=n)
    first, second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(g):
        o = np.lexsort((-g, row))
        start = np.cumsum(count) - count
        some, two = count > 0, count > 1
        first[some] = g[o][start[some]]
        second[two] = g[o][start[two] + 1]
    return np.maximum(first, 0) + np.maximum(second, 0) / 2, first, count


def _train(size: int, samples: list[bytes]) -> bytes:
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def _once(texts: list[str]) -> list[str]:
    """texts without near copies of earlier ones, which would pass one author's words for a class's."""
    seen, out = set(), []
    for t in texts:
        sketch = sorted(zlib.crc32(w.encode()) for w in {w for w in _WORD.findall(t) if len(w) > 7})[:6]
        if len(sketch) < 6 or sum(x in seen for x in sketch) < 3:
            out.append(t)
        seen.update(sketch)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> dict[str | None, Model]:
    """Models by language; under None that of all languages, for those with too few toxic labels."""
    lab = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("l_id"), (F.col("toxic") > 0).alias("l_toxic"))
    lab = lab.groupBy("l_id").agg(F.max("l_toxic").alias("l_toxic"))
    order = (F.xxhash64("l_id"), "l_id")
    lab = lab.filter("l_toxic").orderBy(*order).limit(FIT_TOXIC).union(lab.filter("not l_toxic").orderBy(*order).limit(FIT_ORDINARY))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.col("lang").alias("lang")).filter("text is not null")
    # one text of a doc_id that repeats, so the bound holds for rows too
    text = text.join(F.broadcast(lab), text["id"] == lab["l_id"]).groupBy("l_id").agg(F.first("l_toxic").alias("l_toxic"), F.min(F.struct("text", "lang")).alias("x")).select("l_id", "l_toxic", "x.text", "x.lang")
    rows = [(i, bool(x), t, g) for i, x, t, g in text.toLocalIterator()]
    out = {}
    for lang in sorted({g for _, x, _, g in rows if g is not None}):
        own = [r for r in rows if r[3] == lang]
        if sum(r[1] for r in own) >= LEAST_TOXIC and (m := fit_rows(own)):
            out[lang] = m
    if m := fit_rows(rows):
        out[None] = m
    return out


def _telling(own: list[str], other: list[str]) -> set[str]:
    """The words far more frequent in own (toxic) texts than in others."""
    df, dg = Counter(), Counter()
    for t in own:
        df.update(set(_WORD.findall(t)))
    for t in other:
        dg.update(set(_WORD.findall(t)))
    far = {w: n * math.log(n / len(own) * len(other) / (dg[w] + 0.5)) for w, n in df.items() if n >= LEAST and n / len(own) > LIFT * (dg[w] + 1) / max(len(other), 2 * LIFT)}
    p = len(own) / (len(own) + len(other))

    def chance(w: str) -> float:
        """At most so many of all words would by chance have their documents this much among the toxic ones (Chernoff)."""
        n, m = df[w], dg[w]
        return len(df) * math.exp(-(n * math.log(n / (n + m) / p) + (m and m * math.log(m / (n + m) / (1 - p)))))

    return {w for k, w in enumerate(sorted(far, key=lambda w: (-far[w], w))) if k < TELLING or chance(w) < 0.05}


def fit_rows(rows: list[tuple[int, bool, str, str | None]]) -> Model | None:
    """Model of (doc_id, toxic, text, language); half of each class trains, the other half calibrates."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    random.Random(7).shuffle(rows)
    toxic, plain = ([(t.lower(), g) for _, x, t, g in rows if x == want] for want in (True, False))
    if len(toxic) < 2 or len(plain) < 2:
        return None
    lang = dict(toxic[::2])
    own, other = _once([t for t, _ in toxic[::2]]), plain[::2]
    # each language by itself, so that the commonest doesn't set the counts of all
    telling = set().union(*(_telling([t for t in own if lang[t] == g], [t for t, h in other if h == g]) for g in set(lang.values())))
    other = [t for t, _ in other]
    samples = [f" {w} ".encode() for t in own for w in _WORD.findall(t) if w in telling]
    if not samples:
        return None
    parts = [b[i : i + 256] for b in (t.encode() for t in other) for i in range(0, len(b), 256)]
    random.Random(8).shuffle(parts)
    # a trained dictionary's most useful content is at its end; the commonest stretches follow whole
    common = b"".join(x for x, _ in reversed(Counter(samples).most_common()))
    size = max(TOXIC_BYTES, 2 * len(common))
    content = (_train(size, samples * 3) + common)[-size:]
    model = Model(_train(ORDINARY_BYTES, parts), content, bytes(len(content)), 0.0)
    both = model.compressors()
    a = scored(pa.array([t for t, _ in toxic[1::2]], pa.large_string()), both)[0]
    b = scored(pa.array([t for t, _ in plain[1::2]], pa.large_string()), both)[0]
    # the least threshold of those with the best balance of hits and (dearer) false alarms
    model.least = max(np.arange(1.0, 40.0, 0.5), key=lambda h: ((a >= h).mean() - FALSE_COST * (b >= h).mean(), -h))
    return model


def toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, gain, windows) of the rows whose score reaches the calibrated threshold."""
    models = fit(docs, labels)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    schema = "doc_id long, score double, gain long, windows long"
    if not models:
        return docs.sparkSession.createDataFrame([], schema)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models = held.value
        both = {g: m.compressors() for g, m in models.items()}
        for batch in batches:
            lang = np.array([g if g in models else None for g in batch.column(2).to_pylist()], object)
            for g in set(lang):
                if g not in models:
                    continue
                rows = np.flatnonzero(lang == g)
                own = batch.column(1).take(pa.array(rows))
                for at, part in K.chunks(own):
                    s, gain, n = scored(part, both[g])
                    hit = np.flatnonzero(s >= models[g].least)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[hit + at])), pa.array(s[hit]), pa.array(gain[hit]), pa.array(n[hit])], ["doc_id", "score", "gain", "windows"])

    return d.mapInArrow(run, schema)
