"""Text measures as column expressions in generated JVM code; the style measures, ten passes there, are one Arrow kernel."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import lexicons as L

SPACE = r"\s\p{Z}\x{85}"
EMOJI = r"\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{2B00}-\x{2BFF}"
CURLY = r"\x{2018}\x{2019}\x{201C}\x{201D}\x{2026}\x{2192}\x{21D2}"
COMMENT = r"(?s)<!(?=--).*?(?:-->|\z)"
STYLE = ("em_dash", "unicode_punct", "emoji", "nonascii", "ai_phrases", "structure", "sentence_len")


def literal(text: str) -> str:
    """text as a Java regex that matches just it."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once a row, however often f's lambdas use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("long")


def occurrences(col: Column, phrase: str) -> Column:
    """How often phrase is in col without overlaps: what its removal shortens, which is far cheaper than a regex."""
    return (F.length(col) - F.length(F.replace(col, F.lit(phrase), F.lit("")))) / len(phrase)


def contains_any(col: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase is in col: one pass with an alternation."""
    return col.rlike("|".join(literal(p) for p in phrases))


def hits(cols: Sequence[Column], phrases: Sequence[str]) -> Column:
    """How many of the phrases are in at least one of the columns."""
    has = lambda p: reduce(lambda x, y: x | y, [c.contains(p) for c in cols])
    return reduce(lambda x, y: x + y, [has(p).cast("int") for p in phrases])


def n_words(col: Column) -> Column:
    return count(col, f"[^{SPACE}]+")


def n_lines(col: Column) -> Column:
    """Lines as a text editor counts them: a last line break begins no line."""
    return count(col, "\n") + F.when((F.length(col) > 0) & ~col.endswith("\n"), 1).otherwise(0)


def lines(col: Column) -> Column:
    return F.when(F.length(col) > 0, F.split(F.regexp_replace(col, r"\r?\n\z", ""), r"\r?\n")).otherwise(F.array().cast("array<string>"))


def tokens(col: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.transform(F.regexp_extract_all(col, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0)), F.lower)


def joined_tokens(col: Column) -> Column:
    """The tokens as one string, joined by U+001F: what lies between them is replaced, no array is made."""
    return F.lower(F.btrim(F.regexp_replace(col, r"[^\p{IsAlphabetic}\p{N}]+", "\u001f"), F.lit("\u001f")))


def shingles(toks: Column, n: int) -> Column:
    """Every n tokens in a row, joined by U+001F; none for fewer tokens."""

    def windows(t: Column) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), "\u001f"))).otherwise(F.array().cast("array<string>"))

    return let(toks, windows)


def _kinds() -> np.ndarray:
    """Bits of each code point: 1 white space, 2 em dash, 4 curly punctuation, 8 emoji, 16 other characters beyond ASCII, 32 a sentence's end."""
    out = np.zeros(0x110000, np.uint8)
    out[0x80:] = 16
    for lo, hi in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[lo : hi + 1] |= 1
    for bit, pattern in ((4, CURLY), (8, EMOJI)):
        for lo, hi in re.findall(r"x\{(\w+)\}(?:-\\x\{(\w+)\})?", pattern):
            span = slice(int(lo, 16), int(hi or lo, 16) + 1)
            out[span] = out[span] & 1 | bit
    out[0x2014] = 2
    out[[ord(c) for c in ".!?"]] = 32
    return out


_KINDS = _kinds()
_BULLET = re.compile(r"^[^\S\n]*(?:#|- |\* |\*\*)", re.M | re.A)


def style_rows(texts: list[str]) -> dict[str, np.ndarray]:
    """The seven measures of each text, in a few passes over all their characters."""
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    # a line break after each text: no word spans two
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KINDS[code]
    off = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    per = lambda hit: np.add.reduceat(hit, off, dtype=np.int64) if n else np.zeros(0, np.int64)
    space = (kind & 1).astype(bool)
    words = per(~space & np.concatenate([[True], space[:-1]]) if n else space)
    low = [t.lower() for t in texts]
    times = lambda phrase: np.fromiter((t.count(phrase) for t in low), np.int64, n)
    lines = np.fromiter((t.count("\n") + (bool(t) and t[-1] != "\n") for t in texts), np.int64, n)
    marked = np.fromiter((len(_BULLET.findall(t)) for t in texts), np.int64, n)
    # without a word or character there is nothing to count either
    rate = lambda num, den, most: np.minimum(num * 100.0 / np.maximum(den, 1), most)
    return {
        "em_dash": rate(per(kind == 2) + times(" -- "), words, 10.0),
        "unicode_punct": rate(per((kind & 4) > 0), size, 10.0),
        "emoji": rate(per((kind & 8) > 0), size, 10.0),
        "nonascii": rate(per((kind & 16) > 0), size, 100.0),
        "ai_phrases": rate(sum(times(p) for p in L.AI_PHRASES), words, 10.0),
        "structure": marked / np.maximum(lines, 1),
        "sentence_len": np.minimum(words / np.maximum(per(kind == 32), 1) / 40.0, 1.0),
    }


#: characters that style_rows has at once, or one longer text
AT_ONCE = 1 << 20


def _runs(size: np.ndarray) -> list[int]:
    """Where runs of at most AT_ONCE characters begin, and the end."""
    out, room = [0], AT_ONCE
    for k, n in enumerate(size.tolist()):
        if n > room and k > out[-1]:
            out.append(k)
            room = AT_ONCE
        room -= n
    return [*out, len(size)]


@F.arrow_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in STYLE]))
def style_values(texts: pa.Array) -> pa.Array:
    ok = texts.drop_null()
    cut = _runs(pc.utf8_length(ok).to_numpy(zero_copy_only=False))
    parts = [style_rows(ok.slice(i, j - i).to_pylist()) for i, j in itertools.pairwise(cut)]
    made = pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]), pa.float64()) for k in STYLE], list(STYLE))
    if not texts.null_count:
        return made
    has = texts.is_valid().to_numpy(zero_copy_only=False)
    return made.take(pa.array(np.cumsum(has) - 1, pa.int64(), mask=~has))


def style(col: Column) -> dict[str, Column]:
    """The seven style measures of a text, from one pass of a vectorised kernel; null for null."""
    s = style_values(col)
    return {k: s[k] for k in STYLE}


def html_comment_fraction(col: Column) -> Column:
    """Share of the characters that lie in HTML comments; an open one runs to the end."""
    inside = F.aggregate(F.regexp_extract_all(col, F.lit(COMMENT), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.length(col) > 0, inside / F.length(col)).otherwise(F.lit(0.0))


def title_is_web_default(title: Column) -> Column:
    return F.trim(title).rlike(r"(?i)^(update|create|add|delete)\s+\S*\.(md|txt|rst)$")


def username_generated(login: Column) -> Column:
    return (F.length(login) > 0) & (login.rlike(r"[0-9]{4,}\z") | (count(login, "[0-9]") / F.greatest(F.octet_length(login), F.lit(1)) > 0.4))


def blank(col: Column) -> Column:
    return ~col.rlike(f"[^{SPACE}]")


def template_ignored(template: Column, body: Column) -> Column:
    """The template has headings and none of them is in the body."""
    heads = F.filter(F.transform(lines(template), F.trim), lambda x: x.startswith("#"))
    return (F.size(heads) > 0) & ~F.exists(heads, lambda h: F.contains(body, h))


def mostly_unauthored(paths: Column) -> Column:
    return F.size(F.filter(paths, lambda p: contains_any(F.lower(p), L.UNAUTHORED))) * 2 > F.size(paths)


def path_matches(path: Column, patterns: Sequence[str]) -> Column:
    """*suffix, dir/* or the path itself."""
    tests = [path.endswith(p[1:]) if p.startswith("*") else path.startswith(p[:-2]) & (F.length(path) > len(p) - 1) if p.endswith("/*") else path == p for p in patterns]
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def grounding_miss(body: Column, diff: Column, paths: Column) -> Column:
    """At least two code mentions between backticks, and the change has none of them."""
    spans = F.filter(F.split(body, "`"), lambda x, i: i % 2 == 1)
    spans = F.filter(F.transform(spans, F.trim), lambda s: (F.octet_length(s) >= 3) & (F.octet_length(s) <= 80) & ~s.rlike(f"[{SPACE}]") & s.rlike(r"[(/_]|::"))
    core = F.filter(F.transform(spans, lambda s: F.lower(F.regexp_replace(s, r"(?:\(\))+\z", ""))), lambda s: F.octet_length(s) >= 3)

    def none_named(x: Column) -> Column:
        return ~F.exists(x["core"], lambda m: F.contains(x["diff"], m) | F.exists(x["paths"], lambda p: F.contains(p, m) | F.contains(m, p)))

    return let(core, lambda c: (F.size(c) >= 2) & let(F.struct(c.alias("core"), F.lower(diff).alias("diff"), F.transform(paths, F.lower).alias("paths")), none_named))


def extract_prose(col: Column) -> Column:
    """Prose for a detector: without code, comments, addresses, check boxes and heading marks."""
    for pattern, to in (
        (r"(?s)```.*?(?:```|\z)", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"`[^`\n]*`", " "),
        (r"https?://\S+", " "),
        (r"(?m)^\s*[-*]\s*\[[ xX]\]\s*", ""),
        (r"(?m)^#+\s*", ""),
        (r"\s+", " "),
    ):
        col = F.regexp_replace(col, pattern, to)
    return F.trim(col)


def usable(col: Column, least: int = 50) -> Column:
    return n_words(col) >= least


def authoring_rate(times: Column, additions: Column) -> Column:
    """ln(lines an hour) over ln 4000 if a change of 200 lines came at 500 an hour or more, else null."""
    hours = F.greatest((F.array_max(times) - F.array_min(times)) / 3600.0, F.lit(1 / 60))
    rate = additions / hours
    return F.when((F.size(times) >= 2) & (additions >= 200) & (rate >= 500), F.least(F.ln(rate) / F.ln(F.lit(4000.0)), F.lit(1.0)))
