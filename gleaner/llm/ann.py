"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of BOOKS full-dimensional codebooks,
learned one after another on the residuals and then, REFITS times, all together by
least squares for the codes that the beam search gives; the encoding is a beam
search over all books.  With the code goes the squared norm of the decoded vector,
so a distance is |q|^2 - 2 sum_m <q, word_m> + norm, a sum of table look-ups.  The best
by these sums are ranked again by exact distances.

Queries are the rows whose id is divisible by every (QUERY_EVERY), or all rows for 1.
Each is scored against the codes of all rows, block by block: rows fall into blocks of
about BLOCK by hash, queries as well, each two blocks meet in a task of their own, and
the RERANK best of a block are ranked again.  As both numbers are fixed, recall doesn't
depend on the table's size; the work is the number of queries times that of rows.

Codebooks are fitted on at most FIT_ROWS rows chosen by hash; all rows are
encoded and searched.  Vectors that are null, of another length than
most, or have a null, NaN or infinite component are neither queries nor
neighbours.  Rows that repeat are neighbours of one another (a row isn't its own
neighbour) and each a query; ties go to the lesser id.
Fewer than k other rows give fewer neighbours.  Null ids are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written

BOOKS, WORDS, BEAM, ROUNDS, REFITS = 16, 64, 4, 8, 2
FIT_ROWS, BLOCK, RERANK, TOP, QUERY_EVERY = 20_000, 16_384, 256, 10, 100


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


def train(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Codebooks [BOOKS, WORDS, dim]: k-means on the residuals that the beam search leaves, then joint least-squares fits."""
    rng = np.random.default_rng(seed)
    books, rest = [], x
    for _ in range(BOOKS):
        books.append(_kmeans(rest, WORDS, rng))
        rest = x - decode(encode(x, np.stack(books), beam=1), np.stack(books))
    best = np.stack(books)
    for _ in range(REFITS):
        best = refit(x, encode(x, best))
    return best


def refit(x: np.ndarray, code: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """The codebooks whose sums are nearest to x for these codes, in the sense of least squares."""
    m = code.shape[1]
    at = code.astype(np.int64) + np.arange(m) * WORDS
    gram = np.zeros((m * WORDS, m * WORDS))
    for a in range(m):
        for b in range(m):
            gram[a * WORDS : (a + 1) * WORDS, b * WORDS : (b + 1) * WORDS] = np.bincount(code[:, a].astype(np.int64) * WORDS + code[:, b], minlength=WORDS * WORDS).reshape(WORDS, WORDS)
    right = np.zeros((m * WORDS, x.shape[1]))
    for a in range(m):
        np.add.at(right, at[:, a], x)
    gram[np.diag_indices(m * WORDS)] += ridge * len(x) / WORDS
    return np.linalg.solve(gram, right).reshape(m, WORDS, -1).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes [n, books]: the best of beam partial sums is carried through all books."""
    out = np.empty((len(x), len(books)), np.uint8)
    for at in range(0, len(x), 4096):
        v = x[at : at + 4096]
        n = len(v)
        code, rest = np.zeros((n, 1, 0), np.uint8), v[:, None, :]
        for b in books:
            err = ((rest * rest).sum(2)[:, :, None] - 2 * rest @ b.T) + (b * b).sum(1)
            flat = err.reshape(n, -1)
            k = min(beam, flat.shape[1])
            best = np.argpartition(flat, k - 1, 1)[:, :k]
            src, word = best // len(b), best % len(b)
            code = np.concatenate([np.take_along_axis(code, src[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            rest = np.take_along_axis(rest, src[:, :, None], 1) - b[word]
        win = (rest * rest).sum(2).argmin(1)
        out[at : at + n] = code[np.arange(n), win]
    return out


def decode(code: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][code[:, m]] for m in range(code.shape[1]))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float32)


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    v = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    v = v.filter("not exists(v, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (v, 0) if dims is None else (v.filter(F.size("v") == dims[0]), dims[0])


def _search(dim: int, top: int, held):
    """A block of members and a block of queries: the top of each query among the members."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "qu": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "d": pa.array([], pa.float32())})
        if not len(left) or not len(right):
            return empty
        books = held.value
        x = _matrix(left.column("v").combine_chunks(), dim)
        ids, u = left.column("id").to_numpy(), left.column("u").to_numpy()
        code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        norm = left.column("norm").to_numpy()
        out = []
        qs, qu, qv = right.column("q").to_numpy(), right.column("qu").to_numpy(), _matrix(right.column("qv").combine_chunks(), dim)
        for at in range(0, len(qs), 128):
            q, own = qv[at : at + 128], slice(at, at + 128)
            lut = 2 * np.einsum("qd,mwd->mwq", q, books, optimize=True)
            s = np.repeat(norm[:, None], len(q), 1)
            for m in range(len(books)):
                s -= lut[m][code[:, m]]
            s = np.ascontiguousarray(s.T)
            s[u[None, :] == qu[own][:, None]] = np.inf
            r = min(max(RERANK, 2 * top), len(x))
            short = np.argpartition(s, r - 1, 1)[:, :r] if r < len(x) else np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
            exact = np.stack([((x[near] - v) ** 2).sum(1) for near, v in zip(short, q)])
            exact[np.isinf(np.take_along_axis(s, short, 1))] = np.inf
            o = np.lexsort((u[short], ids[short], exact), axis=1)[:, :top]
            d = np.take_along_axis(exact, o, 1)
            pick = np.take_along_axis(short, o, 1)
            ok = np.isfinite(d)
            row = np.broadcast_to(np.arange(len(q))[:, None], d.shape)[ok]
            out.append((qs[own][row], qu[own][row], ids[pick[ok]], u[pick[ok]], d[ok]))
        return pa.table({k: pa.array(np.concatenate([o[i] for o in out])) for i, k in enumerate(("q", "qu", "id", "u", "d"))})

    return run


def neighbours(table: DataFrame, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", every: int = QUERY_EVERY) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the top nearest other rows of every query, distance squared Euclidean."""
    spark = table.sparkSession
    schema = "vec_id long, rank int, neighbour_id long, distance double"
    v, dim = _vectors(table, id_col, vec_col)
    if not dim:
        return spark.createDataFrame([], schema)
    sample = v.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    books = train(_matrix(sample.column("v").combine_chunks(), dim))
    held = spark.sparkContext.broadcast(books)

    def code(batches):
        books = held.value
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if not len(x):
                continue
            c = encode(x, books)
            y = decode(c, books)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in c], pa.binary()), pa.array((y * y).sum(1), pa.float32())], ["id", "v", "u", "code", "norm"])

    # u tells rows that repeat apart; it is written, so it stays what it is
    coded = written(v.withColumn("u", F.monotonically_increasing_id()).mapInArrow(code, "id long, v array<float>, u long, code binary, norm float"))
    asked = coded.filter(F.pmod("id", F.lit(every)) == 0)
    rows, queries = coded.count(), asked.count()
    if not queries:
        return spark.createDataFrame([], schema)
    n, m = -(-rows // BLOCK), -(-queries // BLOCK)
    block = lambda k: F.pmod(F.xxhash64("u"), F.lit(k)).cast("int")
    every_ = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    member = coded.select("*", block(n).alias("x"), every_(m).alias("y"))
    query = asked.select(F.col("id").alias("q"), F.col("u").alias("qu"), F.col("v").alias("qv"), block(m).alias("qy"), every_(n).alias("qx"))
    near = member.groupBy("x", "y").cogroup(query.groupBy("qx", "qy")).applyInArrow(_search(dim, top, held), "q long, qu long, id long, u long, d float")
    best = near.groupBy("q", "qu").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "u"))), 1, top).alias("l"))
    return best.select(F.col("q").alias("vec_id"), F.posexplode("l")).select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("neighbour_id"), F.round(F.col("col.d").cast("double"), 6).alias("distance")
    )
