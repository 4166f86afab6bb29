"""Code-structure lexers over unified diffs, as one Arrow UDF: the only lane that column expressions can't say.

The UDF sees one diff at a time, so rows are split over tasks in any way and no
shuffle is needed.  A null or short diff fires nothing.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import lexicons as L

LEAST_LINES, BLOCK, MOST_FUNCTIONS, BODY = 20, 5, 60, 60
RULES = ("CODE_DUP_BLOCK", "CODE_DUP_FUNC", "CODE_MAGIC_NUMBER", "CODE_REPEAT_LITERAL", "CODE_HARDCODED_CONFIG", "CODE_BLANKET_CATCH", "CODE_DOC_SCAFFOLD", "CODE_DEAD_HELPER", "CODE_STYLE_DRIFT")

_LITERAL = re.compile(r""""((?:[^"\\]|\\.)*)"|(?<![<&])'((?:[^'\\]|\\.)*)'|(?<!\w)([0-9][0-9A-Za-z._]*)""", re.S)
_QUOTED = re.compile(r'"(?:\\.?|[^"\\])*(?:"|\Z)|`(?:\\.?|[^`\\])*(?:`|\Z)', re.S)
_SIGNATURE = re.compile(r"\s*(?:\([^)]*\)\s*)?(\w*)\s*\(")
_ESCAPE = re.compile(r"\\.", re.S)


def _any(words) -> re.Pattern:
    return re.compile("|".join(re.escape(w) for w in words))


_CONST, _CONFIG, _ENV, _BROAD, _DOC = map(_any, (L.CONSTANT_MARKERS, L.CONFIG_MARKERS, L.CONFIG_SOURCES, L.BROAD_CATCHES, L.DOC_MARKERS))
_SKIPPED = _any(L.NOT_AUTHORED + L.NOT_PRODUCTION)


@dataclass
class Change:
    path: str = ""
    added: list[str] = field(default_factory=list)
    existing: list[str] = field(default_factory=list)


@dataclass
class Function:
    name: str
    visible: bool
    body: list[str]
    line: int
    change: Change


def text_lines(text: str) -> list[str]:
    out = text.split("\n")
    if not out[-1]:
        out.pop()
    return [x.removesuffix("\r") for x in out]


def comment(line: str) -> bool:
    return line.startswith(L.COMMENT_PREFIXES)


def changes(diff: str) -> list[Change]:
    """The files of a diff with the lines that are added and those that were there."""
    out = [Change()]
    for line in text_lines(diff):
        if line.startswith("diff --git "):
            head = line[len("diff --git ") :]
            out.append(Change(head[head.rfind(" b/") + 3 :].strip() if " b/" in head else head.strip()))
        elif line.startswith("+++ "):
            name = re.sub(r"^(?:b/)+", "", line[4:].strip())
            if not out[-1].path and name != "/dev/null":
                out[-1].path = name
        elif line.startswith(("---", "@@")):
            pass
        elif line.startswith("+"):
            out[-1].added.append(line[1:])
        elif line.startswith(("-", " ")):
            out[-1].existing.append(line[1:])
    return [c for c in out if c.path or c.added]


def production(path: str) -> bool:
    """Source that is held to production standards; a diff without names is judged."""
    low = path.lower()
    return not (low.endswith(L.DOC_EXT + L.DATA_EXT) or _SKIPPED.search(low))


def normal_form(line: str) -> str:
    """Strings to S, runs of digits to N, lower case, single spaces."""
    low = re.sub(r"[0-9]+", "N", _QUOTED.sub("\0", line).lower())
    return " ".join(low.split()).replace("\0", "S")


def literals(line: str) -> list[str]:
    """Strings of four characters and numbers that aren't trivial."""
    out = []
    for m in _LITERAL.finditer(line):
        if m[3]:
            v = m[3].rstrip(".").rstrip("_")
            if v and v not in L.TRIVIAL_NUMBERS:
                out.append("n:" + v)
        else:
            v = _ESCAPE.sub("", m[1] if m[1] is not None else m[2])
            if len(v) >= 4:
                out.append("s:" + v.lower())
    return out


def defined(line: str) -> tuple[str, bool] | None:
    """(name, visible outside) if the line defines a function."""
    t = line.strip()
    if not t or comment(t):
        return None
    low = t.lower()
    seen = low.startswith(("export ", "pub ", "pub(", "public ")) or any(x in low for x in (" pub fn ", "export function", "public static"))
    for word in ("def ", "fn ", "func ", "function ", "sub "):
        at = 0 if low.startswith(word) else low.find(" " + word) + 1 or None
        if at is not None and (m := _SIGNATURE.match(low, at + len(word))) and len(m[1].encode()) >= 2:
            return m[1], seen
    if low.endswith("{") and low.startswith(L.MODIFIERS) and "(" in low:
        m = re.search(r"\w+\Z", low[: low.index("(")])
        if m and len(m[0].encode()) >= 2 and not "0" <= m[0][0] <= "9":
            return m[0], seen
    return None


def _body(lines: list[str]) -> list[str]:
    full = (x.strip() for x in lines)
    return [n for n in (normal_form(x) for x in full if x and not comment(x)) if len(n.encode()) >= 3]


def functions(files: list[Change]) -> list[Function]:
    out: list[Function] = []
    for c in files:
        starts = [(i, d) for i, d in enumerate(map(defined, c.added)) if d]
        ends = [i for i, _ in starts[1:]] + [len(c.added)]
        out += [Function(name, seen, _body(c.added[i + 1 : min(end, i + BODY)]), i, c) for (i, (name, seen)), end in zip(starts, ends)]
    return out[:MOST_FUNCTIONS]




def repeated_blocks(files: list[Change]) -> float | None:
    blocks = Counter()
    for c in files:
        body = _body(c.added)
        blocks.update(w for w in zip(*(body[k:] for k in range(BLOCK))) if len(set(w)) >= 3)
    n = blocks.total()
    share = (n - len(blocks)) / n if n >= 8 else 0
    return min(2 * share, 1.0) if share >= 0.15 else None


def repeated_functions(funcs: list[Function]) -> float | None:
    bodies = [frozenset(f.body) for f in funcs if len(f.body) >= 4]
    n = sum(len(a & b) >= 0.85 * len(a | b) and len(a & b) / len(a | b) >= 0.85 for a, b in itertools.combinations(bodies, 2))
    return min(n / 3, 1.0) if n else None


def _declares(low: str) -> bool:
    return low.startswith(L.IMPORT_OPENERS) or "version" in low or bool(_CONST.search(low))


def _names_constant(line: str) -> bool:
    target, eq, _ = line.partition("=")
    return bool(eq) and any("A" <= c <= "Z" for c in target) and not any(c.islower() for c in target)


def magic_numbers(code: list[str]) -> float | None:
    use = [t for t in code if not _declares(t.lower()) and not _names_constant(t)]
    share = sum(any(x[0] == "n" for x in literals(t)) for t in use) / len(code)
    return min(2 * share, 1.0) if share >= 0.10 else None


def repeated_literals(code: list[str]) -> float | None:
    places = Counter(x for t in code if not _declares(t.lower()) for x in set(literals(t)))
    n = sum(k >= 3 for k in places.values())
    return min(n / 3, 1.0) if n else None


def hardcoded(code: list[str]) -> float | None:
    n = sum(bool(_CONFIG.search(t)) and not _ENV.search(t) for t in map(str.lower, code))
    return min(n / 4, 1.0) if n >= 2 else None


def blanket_catches(files: list[Change]) -> float | None:
    broad = swallowed = 0
    for c in files:
        low = [x.strip().lower() for x in c.added]
        for i, x in enumerate(low):
            if _BROAD.search(x):
                broad += 1
                after = next((y for y in low[i + 1 :] if y and not comment(y)), "").rstrip(";").strip()
                swallowed += after in L.SWALLOWS or after.startswith(("console.", "log", "print"))
    return min((broad + swallowed) / 4, 1.0) if broad >= 2 else None


def doc_tables(funcs: list[Function]) -> float | None:
    def has(f: Function) -> bool:
        inside = False
        for x in f.change.added[f.line + 1 : f.line + 5]:
            low = x.strip().lower()
            inside ^= '"""' in low or "'''" in low
            if (inside or comment(low) or low.startswith('"""')) and _DOC.search(low):
                return True
        return False

    if len(funcs) < 2:
        return None
    n = sum(map(has, funcs))
    return n / len(funcs) if n >= 2 and n / len(funcs) >= 0.6 else None


def dead_helpers(funcs: list[Function], diff: str) -> float | None:
    low = diff.lower()
    called = {f.name: low.count(f.name) > 1 for f in funcs if len(f.name.encode()) >= 4 and f.name not in L.HOOKS}
    own = [f for f in funcs if f.name in called]
    dead = sum(not called[f.name] and not f.visible and not f.name.startswith(("on", "test")) for f in own)
    return min(dead / 3, 1.0) if dead >= 2 and any(called.values()) else None


def habits(lines: list[str]) -> tuple[tuple[int, int], ...]:
    """(times, chances) of camel case, tabs, double quotes and comments."""
    full = [x for x in lines if x.strip()]
    code = [x for x in full if not comment(x.strip())]
    names = [w for x in code for w in re.findall(r"\w+", x) if any(c.islower() for c in w)]
    snake = camel = 0
    for w in names:
        under = "_" in w.strip("_")
        hump = any(a.islower() and b.isupper() for a, b in itertools.pairwise(w))
        snake += under and not hump
        camel += hump and not under
    tabs, indented = sum(x[0] == "\t" for x in code), sum(x[0] in " \t" for x in code)
    double = sum(x.count('"') for x in code)
    return (camel, camel + snake), (tabs, indented), (double, double + sum(x.count("'") for x in code)), (len(full) - len(code), len(full))


def style_drift(files: list[Change]) -> float | None:
    best = 0.0
    for c in files:
        if min(len(c.added), len(c.existing)) >= 10:
            pairs = zip(habits(c.added), habits(c.existing), (8, 5, 6, 12))
            gaps = [abs(a / n - b / m) for (a, n), (b, m), least in pairs if min(n, m) >= least]
            if gaps:
                best = max(best, max(gaps) + 0.15 * max(sum(g >= 0.3 for g in gaps) - 1, 0))
    return min(best, 1.0) if best >= 0.5 else None


def code_rules(diff: str | None) -> tuple[float | None, ...]:
    """The value of each of RULES, None where it doesn't fire."""
    files = [c for c in changes(diff or "") if production(c.path)]
    code = [t for c in files for t in map(str.strip, c.added) if t and not comment(t)]
    if len(code) < LEAST_LINES:
        return (None,) * len(RULES)
    funcs = functions(files)
    return (
        repeated_blocks(files),
        repeated_functions(funcs),
        magic_numbers(code),
        repeated_literals(code),
        hardcoded(code),
        blanket_catches(files),
        doc_tables(funcs),
        dead_helpers(funcs, diff),
        style_drift(files),
    )


@F.arrow_udf(T.StructType([T.StructField(r, T.DoubleType()) for r in RULES]))
def code_rule_values(diff: pa.Array) -> pa.Array:
    rows = [code_rules(x.as_py()) for x in diff]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(len(RULES))], list(RULES))
