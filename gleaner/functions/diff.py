"""Measures of unified diffs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import lexicons as L
from gleaner.functions.hashing import fnv1a64, hash60
from gleaner.functions.text import blank, contains_any, let, lines, literal, tokens

_COMMENT = "^(?:" + "|".join(literal(p) for p in L.COMMENT_PREFIXES) + ")"
_COMMENT_OR_DOC = _COMMENT[:-1] + '|""")'


def added(diff: Column, marker: str = "+++") -> Column:
    """The added lines without their sign; lines that begin with marker are headers."""
    return F.transform(F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith(marker)), lambda x: F.substring(x, 2, 1 << 30))


def normalize_patch(diff: Column) -> Column:
    """Added lines in lower case with single spaces, empty ones left out, joined by line breaks."""
    norm = F.transform(added(diff), lambda x: F.trim(F.lower(F.regexp_replace(x, r"\s+", " "))))
    return F.array_join(F.filter(norm, lambda x: F.length(x) > 0), "\n")


def whitespace_only(diff: Column) -> Column:
    a = added(diff)
    return (F.size(a) > 0) & F.forall(a, lambda x: ~x.rlike(r"[\p{IsAlphabetic}\p{N}]"))


def comment_density(diff: Column) -> Column:
    """Comments over comments and code of the added lines; null under ten."""
    full = F.filter(F.transform(added(diff), F.trim), lambda x: ~blank(x))
    return F.when(F.size(full) >= 10, F.size(F.filter(full, lambda x: x.rlike(_COMMENT_OR_DOC))) / F.size(full))


def code_lines(diff: Column) -> Column:
    return F.filter(F.transform(added(diff), F.trim), lambda x: ~blank(x))


def _words(line: Column) -> Column:
    return F.filter(F.transform(tokens(line), lambda t: F.regexp_replace(t, r"\P{IsAlphabetic}", "")), lambda w: F.octet_length(w) >= 2)


def placeholder(ls: Column) -> Column:
    n = F.size(F.filter(ls, lambda x: contains_any(F.lower(x), L.PLACEHOLDERS)))
    return F.when((F.size(ls) >= 8) & (n >= 2), F.least(n / 3.0, F.lit(1.0)))


def comment_restate(ls: Column) -> Column:
    """Comments most of whose words are in the code line below; words that occur twice count twice."""

    def close(x: Column) -> Column:
        both = F.size(F.filter(x["said"], lambda w: F.array_contains(x["code"], w)))
        return (F.size(x["said"]) >= 2) & (both * 10 >= F.size(x["said"]) * 6)

    def restates(p: Column) -> Column:
        words = F.struct(F.filter(_words(p["a"]), lambda w: ~w.isin(*L.STOPWORDS)).alias("said"), _words(p["b"]).alias("code"))
        return p["a"].rlike(_COMMENT) & ~p["b"].rlike(_COMMENT) & let(words, close)

    def counted(ls: Column) -> Column:
        return F.when(F.size(ls) >= 8, F.size(F.filter(F.transform(F.sequence(F.lit(0), F.size(ls) - 2), lambda i: F.struct(F.get(ls, i).alias("a"), F.get(ls, i + 1).alias("b"))), restates)))

    return let(let(ls, counted), lambda n: F.when(n >= 2, F.least(n / 4.0, F.lit(1.0))))


def generic_ident(ls: Column) -> Column:
    words = F.flatten(F.transform(F.filter(ls, lambda x: ~x.rlike(_COMMENT)), _words))
    share = lambda ws: F.size(F.filter(ws, lambda w: w.isin(*L.GENERIC_WORDS))) / F.size(ws)
    most = let(words, lambda ws: F.when(F.size(ws) >= 20, share(ws)))
    return let(F.when(F.size(ls) >= 8, most), lambda s: F.when(s >= 0.3, s))


def pathset(paths: Column) -> Column:
    """The paths in order, joined: what the path-set hash is taken of."""
    return F.array_join(F.array_sort(paths), "\u001f")


def pathset_hash(paths: Column, exact: bool = False) -> Column:
    """The hash of a set of paths in any order: the portable 60 bits, or 64-bit FNV-1a."""
    return fnv1a64(pathset(paths)) if exact else hash60(pathset(paths))
