"""Vectorised text kernel shared by the corpus operators.

Every function works on whole Arrow batches: a column of texts becomes one flat
byte buffer plus offsets, and tokens, word hashes and n-gram hashes are computed
with numpy over that buffer.  No per-document Python loop is involved, so the
cost is a few nanoseconds a byte.  Hashes depend on content only (never on the
batch), so they are stable across partitions, retries and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
#: of text at once where many stages share a worker: some 16 times as much is held in arrays of tokens and hashes
STEP_BYTES = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: 0 white space and control, 1 word (letters, digits, every byte of a multi-byte character), 2 punctuation
CLASS = np.full(256, 2, np.uint8)
CLASS[:33] = 0
CLASS[127] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    CLASS[_a:_b] = 1

_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _pow[kind]
    if len(have) < n:
        base = _MULT if kind == "up" else _INV
        seq = np.full(-(-n >> 16 << 16), base, np.uint64)
        seq[0] = 1
        have = _pow[kind] = np.cumprod(seq, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to numbers in the open interval (0, 1)."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def as_text(col) -> pa.Array:
    """One large_string array; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return pc.fill_null(col.cast(pa.large_string()), "")


def chunks(col, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about limit bytes each; a longer text is a slice of its own."""
    arr = as_text(col)
    if not len(arr):
        return
    size = np.cumsum(pc.binary_length(arr).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(arr):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield at, arr.slice(at, to - at)
        at = to


def flat(arr: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, each ended by a newline, so that no token spans two."""
    if lower:
        arr = pc.utf8_lower(arr)
    arr = pc.binary_join_element_wise(arr, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    _, off, data = arr.buffers()
    o = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def squeeze(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of other characters becomes one space after the word; leading ones go."""
    word = CLASS[data] == 1
    keep = word.copy()
    keep[1:] |= word[:-1]
    new = np.where(word, data, np.uint8(32))[keep]
    return new, np.concatenate([[0], np.cumsum(keep)])[off]


def spans(data: np.ndarray, off: np.ndarray, punct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document row) of the words, with punct also of the runs of punctuation."""
    c = CLASS[data]
    if not punct:
        c = (c == 1).view(np.uint8)
    cut = np.flatnonzero(np.diff(c, prepend=np.uint8(0)))
    ends = np.append(cut[1:], len(c))
    use = c[cut] > 0 if len(cut) else np.zeros(0, bool)
    starts, ends = cut[use], ends[use]
    per = np.searchsorted(starts, off)
    return starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(per))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span data[start:end]."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("up", len(data)), out=acc[1:])
    return mix((acc[ends] - acc[starts]) * _powers("down", len(data) + 1)[starts])


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of every n tokens in a row of one document."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:m].copy()
    for k in range(1, n):
        g *= _MULT
        g += h[k : k + m]
    ok = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(g[ok] + np.uint64(n)), ok


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each document's part of arrays that are ordered by document."""
    return np.searchsorted(row, np.arange(n + 1))


def row_sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n) if len(row) else np.zeros(n)
