"""b-bit MinHash near-duplicate groups.

Word trigrams are hashed, 160 permutations keep their minima, bands of 4 minima
give the candidates, and of each minimum only the low 4 bits are kept in a packed
signature.  A candidate pair counts as similar if the share of equal b-bit
values, corrected for chance collisions (C = 2^-b):  J = (E - C) / (1 - C),
reaches the threshold.

A document is a (doc_id, text).  Documents with equal signatures are one node of
the graph; lists of more than LIST nodes are met in chunks (_lists), so a template
that a third of all documents share is in no single task.

Cases: texts that are null, empty or without a word have no signature and are in
no group.  Texts with fewer words than a shingle are one shingle.  Rows that
repeat are copies of one another; a null doc_id is no document and is left out
of groups.  All columns but the two named are ignored here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel as K
from gleaner.llm.common import components, fresh, in_steps, small, written

PERMS, ROWS, BITS, SHINGLE, THRESHOLD = 160, 4, 4, 3, 0.5
#: members of a candidate list that one task holds; one node in SHARE tells which bands have more
LIST, SHARE = 1 << 16, 1024


def _family(perms: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(4099)
    return r.integers(1, 1 << 32, perms, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, perms, dtype=np.uint32)


def shingles(arr: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row); a text with 1 to n-1 words has one shingle, of all of them."""
    data, off = K.flat(arr)
    s, e, row = K.spans(data, off)
    h = K.hashes(data, s, e)
    g, at = K.grams(h, row, n)
    where = row[at]
    cut = K.per_row(row, len(arr))
    few = np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut) < n))
    if len(few):
        count = np.diff(cut)[few]
        own = count.astype(np.uint64)
        for k in range(n - 1):
            use = np.flatnonzero(count > k)
            own[use] = K.mix(own[use] * np.uint64(31) + h[cut[few[use]] + k])
        g, where = np.concatenate([g, own]), np.concatenate([where, few])
        o = np.argsort(where, kind="stable")
        g, where = g[o], where[o]
    return g, where


def minima(arr: pa.Array, perms: int = PERMS, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their minima as uint32 [rows, perms])."""
    g, row = shingles(arr, n)
    if not len(g):
        return np.zeros(0, np.int64), np.zeros((0, perms), np.uint32)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    x = (g >> np.uint64(32)).astype(np.uint32) ^ g.astype(np.uint32)
    a, b = _family(perms)
    out = np.empty((perms, len(first)), np.uint32)
    # blocks that end with a document and fit the cache; within each, every permutation
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 15))))
        part = x[first[at] : first[to] if to < len(first) else len(x)]
        cut = first[at:to] - first[at]
        y = np.empty_like(part)
        for k in range(perms):
            np.multiply(part, a[k], out=y)
            y += b[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x85EBCA6B)
            out[k, at:to] = np.minimum.reduceat(y, cut)
        at = to
    return row[first], out.T


def pack(minima_: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, packed into bytes."""
    low = (minima_ & np.uint32((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1), axis=1)


def similarity(x: np.ndarray, y: np.ndarray, perms: int = PERMS, bits: int = BITS) -> np.ndarray:
    """Collision-corrected estimate for packed signatures, by bit counts of their XOR."""
    z = x ^ y
    if bits in (1, 2, 4):
        shift = bits
        any_ = z.copy()
        for k in range(1, shift):
            any_ |= z >> np.uint8(k)
        any_ &= np.uint8({1: 0xFF, 2: 0x55, 4: 0x11}[bits])
        differ = np.bitwise_count(any_).sum(-1, dtype=np.int64)
    else:
        differ = np.unpackbits(z, axis=-1).reshape(*z.shape[:-1], perms, bits).any(-1).sum(-1)
    c = 2.0**-bits
    return ((1 - differ / perms) - c) / (1 - c)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th: hash of the text, sig: packed low bits, bands: hash of each band's minima) of the texts with a word."""

    def run(batches):
        for batch in batches:
            for at, part in K.chunks(batch.column(2), K.STEP_BYTES):
                rows, m = minima(part)
                if not len(rows):
                    continue
                h = m.reshape(len(m), -1, ROWS).astype(np.uint64)
                acc = np.arange(h.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
                for k in range(ROWS):
                    acc = K.mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[:, :, k])
                sig = pack(m)
                width, pick = sig.shape[1], pa.array(rows + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pick),
                        batch.column(1).take(pick),
                        pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(len(sig) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(sig))]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * acc.shape[1]), pa.array(acc.ravel().view(np.int64))),
                    ],
                    ["id", "th", "sig", "bands"],
                )

    d = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    return in_steps(d).mapInArrow(run, "id long, th long, sig binary, bands array<long>")


def _links(threshold: float):
    """For each list of candidates: edges (least member, member, similarity to the member that it was
    found by) that join exactly those that pairs over the threshold connect.

    Two members are one comparison.  Longer lists are searched from member to
    member: each found one is compared with those that nothing has reached yet, so
    a list of near copies costs one comparison a member and no pair is skipped.
    """

    def run(batches):
        for batch in batches:
            ids, sig = batch.column(0), batch.column(1)
            off = np.asarray(ids.offsets)
            flat_id = ids.flatten().to_numpy()
            off = off - off[0]
            raw = sig.flatten()
            width = len(raw[0].as_py()) if len(raw) else 1
            flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, width)
            size = np.diff(off)
            two = off[:-1][size == 2]
            s = similarity(flat[two], flat[two + 1])
            ok = s >= threshold
            a, b, c = [flat_id[two[ok]]], [flat_id[two[ok] + 1]], [s[ok]]
            for k in np.flatnonzero(size > 2):
                f, own = flat[off[k] : off[k + 1]], flat_id[off[k] : off[k + 1]]
                left = np.arange(len(f))
                while len(left) > 1:
                    stack, left, found, best = [left[0]], left[1:], [left[0]], [1.0]
                    while stack and len(left):
                        at = stack.pop()
                        s = similarity(f[left], f[at])
                        hit = s >= threshold
                        found.extend(left[hit])
                        best.extend(s[hit])
                        stack.extend(left[hit])
                        left = left[~hit]
                    # a star around the least member keeps the graph shallow; ids come in order
                    a.append(np.full(len(found) - 1, own[found[0]]))
                    b.append(own[found[1:]])
                    c.append(np.array(best[1:]))
            x, y = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.concatenate(c))], ["a", "b", "similarity"])

    return run


def _lists(nodes: DataFrame, most: int, share: int) -> DataFrame:
    """(list, node): the candidate lists of all bands, each distinct one once and of about most members at most.

    A band whose members in a sample of one node in share say that it has more than
    most is cut into chunks by a hash, and each two chunks are a list, so that every
    two members still meet in one; all other bands are one list.
    """
    each = nodes.select("node", F.explode("bands").alias("band"))
    rare = each.filter(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).groupBy("band").count().filter(F.col("count") * share > most)
    hot = written(rare.select("band", F.ceil(F.col("count") * (2.0 * share / most)).cast("int").alias("chunks")))
    n = hot.count()
    lone, cut = each, None
    if n:
        h = small(hot, n)
        lone = each.join(h.select("band"), "band", "left_anti")
        own = each.join(h, "band").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int"))
        other = own.select("band", "node", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        cut = other.groupBy("band", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y")).agg(F.collect_set("node").alias("l")).select("l")
    lists = lone.groupBy("band").agg(F.collect_set("node").alias("l")).select("l")
    if cut is not None:
        lists = lists.union(cut)
    lists = lists.filter(F.size("l") > 1).select(F.array_sort("l").alias("l"))
    # most lists of a group of near copies are equal: two independent hashes tell them apart
    key = [F.xxhash64("l").alias("list"), F.xxhash64(F.lit(1), "l").alias("list2")]
    return lists.select(*key, "l").groupBy("list", "list2").agg(F.first("l").alias("l")).select("list", "list2", F.explode("l").alias("node"))


def _groups(docs: DataFrame, threshold: float, id_col: str, text_col: str, most: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, keeper, keeper_th, similarity) of the documents that have a near duplicate and aren't the one to keep, and all (id, th)."""
    sig = written(signatures(docs, id_col, text_col).withColumns({"k1": F.xxhash64("sig", "bands"), "k2": F.xxhash64(F.lit(1), "bands", "sig")}))
    rows = sig.select("id", "th", "k1", "k2")
    # equal signatures are one node: thousands of copies cost one; the number is written, so it stays what it is
    same = sig.groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("least"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    same = written(same.withColumn("node", F.monotonically_increasing_id()))
    member = _lists(same.select("node", "bands"), most, share).join(same.select("node", "sig"), "node")
    cand = member.groupBy("list", "list2").agg(F.collect_list(F.struct("node", "sig")).alias("m")).select(F.array_sort("m").alias("m")).select(F.col("m.node").alias("ids"), F.col("m.sig").alias("sigs"))
    edges = written(cand.mapInArrow(_links(threshold), "a long, b long, similarity double"))
    root = components(edges)
    best = edges.select(F.col("a").alias("node"), "similarity").union(edges.select(F.col("b").alias("node"), "similarity")).groupBy("node").agg(F.max("similarity").alias("best"))
    joined = root.join(best, "node").join(same.select("node", "least"), "node")
    keeper = joined.groupBy("root").agg(F.min("least").alias("keeper"))
    joined = joined.join(keeper, "root").select("node", "keeper", "best")
    # a node without a link is a group if several rows have it
    nodes = same.select("k1", "k2", "node", "least", "n").join(joined, "node", "left").filter("n > 1 or keeper is not null")
    nodes = nodes.select("k1", "k2", F.coalesce("keeper", "least").alias("keeper"), F.when(F.col("n") > 1, F.lit(1.0)).otherwise(F.round("best", 6)).alias("similarity"))
    out = rows.join(nodes, ["k1", "k2"]).filter((F.col("id") != F.col("keeper.id")) | (F.col("th") != F.col("keeper.th")))
    return out.groupBy("id", "th").agg(F.first("keeper.id").alias("keeper"), F.first("keeper.th").alias("keeper_th"), F.max("similarity").alias("similarity")), rows.select("id", "th")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", most: int = LIST, share: int = SHARE) -> DataFrame:
    """(doc_id, keeper, similarity): one row for each document that has a near duplicate and isn't the one to keep.

    The keeper is the document with the least doc_id of its connected component;
    similarity is that to the documents by which it was found (1.0 for equal
    signatures).  A doc_id with several texts is several documents: each has its row.
    """
    out, _ = _groups(docs, threshold, id_col, text_col, most, share)
    return out.select(F.col("id").alias("doc_id"), "keeper", "similarity")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, most: int = LIST, share: int = SHARE) -> DataFrame:
    """docs with one document of each group of near duplicates, and of equal (doc_id, text) one row.

    A document is a (doc_id, text): another text of the same doc_id isn't touched.
    Rows without a doc_id or a word stay.  Texts move in one join (in two if rows repeat).
    """
    gone, rows = _groups(docs, threshold, "doc_id", "text", most, share)
    twice = rows.groupBy("id", "th").count().filter("count > 1").select("id", "th")
    flags = written(gone.select("id", "th", F.lit(True).alias("gone")).unionByName(twice.select("id", "th", F.lit(False).alias("gone"))).groupBy("id", "th").agg(F.max("gone").alias("gone")))
    names = [fresh(docs, c) for c in ("_id", "_th", "_gone")]
    f = small(flags).toDF(*names)
    left = docs.join(f, (docs["doc_id"] == f[names[0]]) & (F.xxhash64(docs["text"]) == f[names[1]]), "left")
    single = left.filter(F.col(names[2]).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    if not flags.filter("not gone").head(1):
        return single
    # rows that repeat: the first of each is chosen before the shuffle and after it
    multi = left.filter(~F.col(names[2])).dropDuplicates([names[0], names[1]])
    return single.unionByName(multi.select(*[F.col(f"`{c}`") for c in docs.columns]))
