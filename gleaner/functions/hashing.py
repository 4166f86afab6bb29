"""Hashes: a portable 60-bit one that any SQL engine can repeat, and exact 64-bit FNV-1a and splitmix64."""

from __future__ import annotations

try:
    from _md5 import md5  # for short texts faster than OpenSSL's
except ImportError:
    from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

P31 = (1 << 31) - 1
_PRIME, _OFFSET = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)


def hash60(col: Column) -> Column:
    """The first 60 bits of md5: not negative, and exact in BIGINT anywhere."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long")


def md5_60(values: list[bytes]) -> np.ndarray:
    """hash60 of each."""
    return np.frombuffer(b"".join([md5(v).digest() for v in values]), ">u8")[::2].astype(np.uint64) >> np.uint64(4)


def mod_p31(x: np.ndarray) -> np.ndarray:
    """x mod 2^31-1 for x < 2^63, in shifts and in x's own place if it is unsigned: division of 64-bit numbers is slow."""
    x, p = x.astype(np.uint64, copy=False), np.uint64(P31)
    for _ in range(2):
        high = x >> np.uint64(31)
        x &= p
        x += high
    # what is less than p wraps to a great number
    return np.minimum(x, x - p, out=x)


def fnv(values: list[bytes]) -> np.ndarray:
    """FNV-1a of each, a byte position at a time over all of them."""
    n = np.array([len(v) for v in values], np.int64)
    flat = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    at = np.cumsum(n) - n
    h = np.full(len(values), _OFFSET, np.uint64)
    order = np.argsort(-n, kind="stable")
    live = len(order)
    for k in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n[order], -k, "left"))
        o = order[:live]
        h[o] = (h[o] ^ flat[at[o] + k]) * _PRIME
    return h


def splitmix64(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(T.LongType())
def fnv1a64(s: pd.Series) -> pd.Series:
    """FNV-1a as a signed 64-bit number; null stays null."""
    ok = s.notna().to_numpy()
    out = pd.Series([None] * len(s), dtype="Int64")
    out[ok] = fnv([x.encode() for x in s[ok]]).view(np.int64)
    return out


def fold(h: Column, k: int) -> Column:
    """Remainder of the unsigned reading of a signed 64-bit hash."""
    return F.when(h >= 0, h % k).otherwise(F.pmod(F.pmod(h, F.lit(k)) + F.lit((1 << 64) % k), F.lit(k)))
