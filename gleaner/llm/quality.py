"""Quality classification by importance resampling (DSIR).

Two generative models over hashed unigrams and bigrams of words and runs of
punctuation: the raw model counts every document, the target model the labelled
documents of good quality.  A document's log importance weight is the sum over
its n-grams of log(target / raw).  Documents are drawn without replacement by
Gumbel top-k: the k greatest weight + Gumbel noise stay.

The target model and the calibration use at most FIT_ROWS labelled rows (chosen
by hash, half for each); the raw counts, k and the k-th key cover all documents.
k is the number of documents whose weight reaches the level that good held-out
documents reach, less the noise they can have: KEEP of the good ones are to stay.

The noise is a hash of (doc_id, text), so a retried task draws the same; rows
that repeat share their key and so stay or go together (k may be passed by such
ties).  Null and empty texts have weight 0, neither good nor bad.  Without good
labels all weights are 0 and every row stays.  Null ids are documents like any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel as K
from gleaner.llm.common import in_steps, written

BUCKETS, FIT_ROWS, KEEP = 1 << 14, 20_000, 0.999
_SHIFT = np.uint64(64 - 14)


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every unigram and bigram."""
    data, off = K.flat(arr, lower=False)
    s, e, row = K.spans(data, off, punct=True)
    h = K.hashes(data, s, e)
    g, at = K.grams(h, row, 2)
    return (np.concatenate([h, g]) >> _SHIFT).astype(np.int64), np.concatenate([row, row[at]])


def _noise(ids: np.ndarray, arr: pa.Array) -> np.ndarray:
    data, off = K.flat(arr, lower=False)
    h = K.hashes(data, off[:-1], off[1:])
    return -np.log(-np.log(K.uniform(h ^ K.mix(ids.view(np.uint64) + np.uint64(0x51ED)))))


def _ids(col) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """docs' text with (quality, half) for a bounded sample of the labels; the sample's size is known, so it is broadcast."""
    lab = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("l_quality"))
    lab = lab.groupBy("l_id").agg(F.min("l_quality").alias("l_quality")).orderBy(F.xxhash64("l_id"), "l_id").limit(most).withColumn("l_half", F.pmod(F.hash("l_id"), F.lit(2)))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    return text.join(F.broadcast(lab), text["id"] == lab["l_id"]).select("id", "text", "l_quality", "l_half")


def _count(batches):
    total = np.zeros(BUCKETS)
    for batch in batches:
        for _, part in K.chunks(batch.column(0), K.STEP_BYTES):
            total += np.bincount(features(part)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """n-gram counts of all rows: each task sends its buckets once, Spark adds them up."""
    out = np.zeros(BUCKETS)
    for b, n in in_steps(texts).mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[b] = n
    return out


def weights(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """(log ratio of each bucket, the labelled sample)."""
    raw = counts(docs.select("text"))
    sample = fit_rows(docs, labels)
    target = counts(sample.filter("l_quality = 1 and l_half = 0").select("text"))
    if not target.sum():
        return np.zeros(BUCKETS), sample
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)), sample


def _scorer(held, where_id: int, where_text: int, emit):
    def run(batches):
        ratio = held.value
        for batch in batches:
            w, key = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            ids = _ids(batch.column(where_id))
            for at, part in K.chunks(batch.column(where_text), K.STEP_BYTES):
                f, row = features(part)
                own = np.round(K.row_sums(ratio[f], row, len(part)), 6)
                w[at : at + len(part)] = own
                key[at : at + len(part)] = own + _noise(ids[at : at + len(part)], part)
            yield emit(batch, w, np.round(key, 6))

    return run


def scores(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    emit = lambda b, w, k: pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(k)], ["doc_id", "log_weight", "gumbel_key"])
    return in_steps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))).mapInArrow(_scorer(held, 0, 1, emit), "doc_id long, log_weight double, gumbel_key double")


def kth_greatest(df: DataFrame, col: str, k: int) -> float:
    """The k-th greatest value of a column, exactly: bins are halved by histograms of 1024 until one value is left."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return lo
    part = df.select(F.col(col).alias("v")).filter("v is not null")
    while True:
        width = (hi - lo) / 1024
        if not width or lo + width == lo:
            return hi
        bins = part.filter(f"v between {lo!r}D and {hi!r}D").groupBy(F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(1023)).alias("b"))
        for b, n, least, most in sorted(bins.agg(F.count("*"), F.min("v"), F.max("v")).collect(), reverse=True):
            if k <= n:
                if least == most or k == n:
                    return least
                lo, hi = least, most
                break
            k -= n


def threshold(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, DataFrame | None]:
    """(log ratios, least key that stays, all scores)."""
    ratio, sample = weights(docs, labels)
    if not ratio.any():
        return ratio, -float("inf"), None
    held_out = sample.filter("l_quality = 1 and l_half = 1").select(F.col("id").alias("doc_id"), "text")
    good = np.sort([r[0] for r in scores(held_out, ratio).select("log_weight").toLocalIterator()])
    if not len(good):
        return ratio, -float("inf"), None
    level = good[int((1 - KEEP) * len(good))] + float(-np.log(-np.log(1 - KEEP)))
    every = written(scores(docs, ratio))
    k = every.filter(F.col("log_weight") >= float(level)).count()
    return ratio, kth_greatest(every, "gumbel_key", k), every


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of the rows drawn."""
    ratio, least, every = threshold(docs, labels)
    return (scores(docs, ratio) if every is None else every).filter(F.col("gumbel_key") >= least)


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with only the rows drawn, all columns as they are; the last scan filters in place, without a join."""
    ratio, least, _ = threshold(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    emit = lambda b, w, k: b.filter(pa.array(k >= least))
    return in_steps(docs).mapInArrow(_scorer(held, docs.columns.index("doc_id"), docs.columns.index("text"), emit), docs.schema)
