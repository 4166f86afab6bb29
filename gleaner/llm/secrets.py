"""Secret scans by grammar inference (ALERGIA).

Labelled credentials are what follows a credential's name in an assignment
(token = "...", password: '...', api_key=...).  For each format (length and
kinds of characters, or the kinds alone where a length is rare) a prefix tree of the
credentials is built over character classes, and states whose next-symbol frequencies
don't differ by Hoeffding's bound are merged, red-blue, until a probabilistic
automaton remains.  All other candidates of all texts together give the background: the
frequency of each class after the two before it.  Every candidate in every text is scored
by the log likelihood per character under its best format less that of the
background; the threshold is calibrated on labelled rows that weren't trained on.

Candidates are the values after a credential's name, of any length (one in quotes
whole, whatever its characters; one without them up to white space, & , or ;), and elsewhere
runs of characters that credentials can have: of LEAST or more, or of SHORT or more if
letters and digits are among them (a shorter run, or one of letters or digits alone, is a
word or a number).

At most FIT_ROWS labelled credentials are used to fit, half of them to calibrate, with as
many other candidates; all are chosen by hash.  All candidates of whole texts are scored.
Null and empty texts have no candidate.  Repeated rows and repeated strings are reported
each time.  Without labelled credentials nothing is scored as a secret.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import kernel as K
from gleaner.llm.common import written

LEAST, SHORT, FIT_ROWS, ALPHA, FORMAT_ROWS = 16, 8, 2000, 0.05, 8
_NAMED = regex.compile(
    rb"(?i)(?:token|secret|passwo?r?d|passwd|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s*[:=]\s*"
    rb"(?:\"(?P<v>(?:[^\"\\\n]|\\.)+)\"|'(?P<v>(?:[^'\\\n]|\\.)+)'|[\"']?(?P<v>[^\s\"'&,;]*[^\s\"'&,;()\[\]{}<>]))"
)
_CAND = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=.":
    _CAND[_c] = True


#: symbol of each byte: digit, hex letter or other letter by case; other ASCII characters are themselves, the rest is one
SYMBOL = np.full(256, 5, np.uint8)
SYMBOL[:128] = np.arange(128)
for _k, _s in enumerate(("0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ")):
    SYMBOL[list(_s.encode())] = _k
# control characters give way to the classes
SYMBOL[:5] = 5
SYMBOLS = 128


def symbols(text: str) -> list[int]:
    return SYMBOL[np.frombuffer(text.encode(), np.uint8)].tolist()


def kinds(text: str) -> str:
    return ".".join(map(str, sorted(set(symbols(text)))))


class Automaton:
    """A probabilistic deterministic automaton, merged from a prefix tree of samples."""

    def __init__(self, samples: Counter, alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.final = [0]
        self.total = [0]
        for text, n in sorted(samples.items()):
            q = 0
            self.total[0] += n
            for c in symbols(text):
                self.count[q][c] = self.count[q].get(c, 0) + n
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.final.append(0)
                    self.total.append(0)
                q = self.next[q][c]
                self.total[q] += n
            self.final[q] += n
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _near(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) < self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.total[p], self.total[q]
            if not n or not m:
                continue
            # no difference of counts this small can pass the bound, nor can their successors'
            if self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) >= 1:
                continue
            if not self._near(self.final[p], n, self.final[q], m):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if not self._near(self.count[p].get(c, 0), n, self.count[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    stack.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree under q to state p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.final[p] += self.final[q]
            self.total[p] += self.total[q]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
            for c, t in self.next[q].items():
                if c in self.next[p]:
                    stack.append((self.next[p][c], t))
                else:
                    self.next[p][c] = t

    def _infer(self) -> None:
        red, known = [0], {0}
        while True:
            blue = [(-self.total[t], t, r, c) for r in red for c, t in self.next[r].items() if t not in known]
            if not blue:
                break
            _, t, r, c = min(blue)
            for p in red:
                if self._compatible(p, t):
                    self.next[r][c] = p
                    self._fold(p, t)
                    break
            else:
                red.append(t)
                known.add(t)
        number = {r: i for i, r in enumerate(red)}
        self.states = []
        for r in red:
            n = self.total[r] + 0.05 * 70
            arcs = {c: (math.log((k + 0.05) / n), number[self.next[r][c]]) for c, k in self.count[r].items()}
            self.states.append((arcs, math.log(0.05 / n), math.log((self.final[r] + 0.05) / n)))

    def score(self, text: str) -> float:
        """Log likelihood per symbol, its end included; unseen symbols have a small share and stay in the state."""
        q, s = 0, 0.0
        for c in symbols(text):
            arcs, none, _ = self.states[q]
            if c in arcs:
                w, q = arcs[c]
                s += w
            else:
                s += none
        return (s + self.states[q][2]) / (len(text.encode()) + 1)


def candidates(arr: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list[bool]]:
    """(strings, rows, byte offsets in the text, whether a credential's name comes before)."""
    data, off = K.flat(arr, lower=False)
    raw = data.tobytes()
    whole, spans = np.zeros(len(data), bool), []
    for m in _NAMED.finditer(raw, overlapped=True):
        a, b = m.span("v")
        if np.searchsorted(off, m.start(), "right") != np.searchsorted(off, a, "right"):
            continue  # the name ends its text
        if spans and spans[-1][1] <= a and spans[-1][1] > m.start():
            spans.pop()  # what follows the name before was a name itself
        if not spans or spans[-1][1] < b:
            spans.append((a, b))
        whole[m.start() : b] = True
    n = len(spans)
    ok = _CAND[data]
    cut = np.flatnonzero(np.diff(ok.view(np.int8), prepend=np.int8(0)))
    ends = np.append(cut[1:], len(ok))
    use = ok[cut] if len(cut) else np.zeros(0, bool)
    s, e = cut[use], ends[use]
    held = np.concatenate([[0], np.cumsum(whole)])
    count = lambda ok: np.concatenate([[0], np.cumsum(ok)])
    digit, letter = count(SYMBOL[data] == 0), count((SYMBOL[data] >= 1) & (SYMBOL[data] <= 4))
    mixed = (e - s >= SHORT) & (digit[e] > digit[s]) & (letter[e] > letter[s])
    big = ((e - s >= LEAST) | mixed) & (held[e] == held[s])
    own = np.array(spans, np.int64).reshape(-1, 2)
    s, e = np.concatenate([own[:, 0], s[big]]), np.concatenate([own[:, 1], e[big]])
    named = np.arange(len(s)) < n
    o = np.argsort(s, kind="stable")
    s, e, named = s[o], e[o], named[o]
    row = np.searchsorted(off, s, "right") - 1
    text = [raw[a:b].decode(errors="replace") for a, b in zip(s.tolist(), e.tolist())]
    return text, row, s - off[row], named.tolist()


def _extract(batches):
    for batch in batches:
        for at, part in K.chunks(batch.column(1)):
            text, row, where, named = candidates(part)
            if text:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array(where.astype(np.int32)), pa.array(text), pa.array(named)], ["doc_id", "at_byte", "candidate", "named"])


class Formats:
    """Automata of all formats as one table, so that a batch is scored a character position at a time."""

    def __init__(self, made: dict[str, Automaton]):
        self.names = sorted(made)
        first, nxt, weight, end = [], [], [], []
        for name in self.names:
            base = len(end)
            first.append(base)
            for k, (arcs, none, last) in enumerate(made[name].states):
                to, w = np.full(SYMBOLS, base + k), np.full(SYMBOLS, none)
                for c, (p, q) in arcs.items():
                    to[c], w[c] = base + q, p
                nxt.append(to)
                weight.append(w)
                end.append(last)
        self.first, self.next, self.weight, self.end = np.array(first), np.array(nxt).ravel(), np.array(weight).ravel(), np.array(end)

    def best(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """(greatest log likelihood per symbol, its format) of each text; ties go to the last name."""
        raw = [t.encode() for t in texts]
        size = np.array([len(t) for t in raw])
        score, which = np.empty(len(raw)), np.empty(len(raw), np.int64)
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(order):
            longest = max(1, size[order[at]])
            part = order[at : at + max(1, min(4096, (1 << 22) // longest))]
            grid = np.zeros((len(part), longest), np.uint8)
            for k, i in enumerate(part):
                grid[k, : size[i]] = SYMBOL[np.frombuffer(raw[i], np.uint8)]
            grid = np.ascontiguousarray(grid.T)
            n = size[part]
            live = np.searchsorted(-n, -np.arange(longest), "left")
            q = np.repeat(self.first[:, None], len(part), 1)
            s = np.zeros(q.shape)
            for t in range(longest):
                m = live[t]
                cell = q[:, :m] * SYMBOLS + grid[t, :m]
                s[:, :m] += self.weight[cell]
                q[:, :m] = self.next[cell]
            s = (s + self.end[q]) / (n + 1)
            top = len(s) - 1 - np.argmax(s[::-1], 0)
            which[part], score[part] = top, s[top, np.arange(len(part))]
            at += len(part)
        return score, [self.names[k] for k in which]


class Background:
    """Frequency of each symbol after the two before it; the last symbol is the end."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(-1, SYMBOLS + 1).astype(np.float64)
        self.log = np.log((n + 0.05) / (n.sum(1, keepdims=True) + 0.05 * (SYMBOLS + 1))).ravel()

    @staticmethod
    def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cell, offsets): a cell for each symbol of each text and for its end."""
        raw = [t.encode() for t in texts]
        size = np.array([len(t) + 1 for t in raw], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        c = np.full(off[-1], SYMBOLS, np.int64)
        body = np.ones(len(c), bool)
        body[off[1:] - 1] = False
        c[body] = SYMBOL[np.frombuffer(b"".join(raw), np.uint8)]
        one, two = np.full(len(c), SYMBOLS), np.full(len(c), SYMBOLS)
        one[1:], two[2:] = c[:-1], c[:-2]
        # a text's first symbols follow starts, which are ends
        one[off[:-1]] = two[off[:-1]] = SYMBOLS
        two[np.minimum(off[:-1] + 1, len(c) - 1)[size > 1]] = SYMBOLS
        return (two * (SYMBOLS + 1) + one) * (SYMBOLS + 1) + c, off

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        cell, off = self.cells(texts)
        return np.add.reduceat(self.log[cell], off[:-1]) / np.diff(off)


def _cells(batches):
    total = np.zeros((SYMBOLS + 1) ** 3, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(Background.cells(batch.column(0).to_pylist())[0], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])


def background(found: DataFrame) -> Background:
    """From all unnamed candidates: each task sends its cells once, Spark adds them up."""
    counts = np.zeros((SYMBOLS + 1) ** 3)
    for c, n in found.filter("not named").select("candidate").mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[c] = n
    return Background(counts)


def grammars(secret: list[str]) -> dict[str, Automaton]:
    """The automaton of each format of these credentials."""
    size = lambda t: f"{len(t.encode())}:{kinds(t)}"
    lengths, sets = Counter(map(size, secret)), Counter(map(kinds, secret))
    by = defaultdict(Counter)
    for t in secret:
        by[size(t) if lengths[size(t)] >= FORMAT_ROWS else f"*:{kinds(t)}" if sets[kinds(t)] >= FORMAT_ROWS else "other"][t] += 1
    return {k: Automaton(v) for k, v in sorted(by.items())}


def fit(found: DataFrame) -> tuple[Formats, Background, float] | None:
    """(automata of the formats, background, threshold)."""
    distinct = found.groupBy("candidate").agg(F.max("named").alias("named"))
    order = (F.xxhash64("candidate"), "candidate")
    take = lambda cond: [r[0] for r in distinct.filter(cond).orderBy(*order).limit(FIT_ROWS).collect()]
    secret, other = take("named"), take("not named")
    if not secret:
        return None
    made, plain = Formats(grammars(secret[::2])), background(found)
    good = ratios(secret[1::2] or secret, made, plain)[0]
    bad = ratios(other, made, plain)[0] if other else np.array([-9.0])
    levels = np.unique(np.concatenate([good, bad, [0.0]]))
    good, bad = np.sort(good), np.sort(bad)
    gain = (1 - np.searchsorted(good, levels) / len(good)) - (1 - np.searchsorted(bad, levels) / len(bad))
    return made, plain, float(levels[np.argmax(gain)])


def ratios(texts: list[str], made: Formats, plain: Background) -> tuple[np.ndarray, list[str]]:
    best, name = made.best(texts)
    return np.round(best - plain.score(texts), 6), name


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, at_byte, candidate, format, log_ratio, is_secret) of every candidate."""
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_extract, "doc_id long, at_byte int, candidate string, named boolean"))
    held = docs.sparkSession.sparkContext.broadcast(fit(found))

    def run(batches):
        model = held.value
        for batch in batches:
            text = batch.column(2)
            if model is None or not len(text):
                best, name, hit = pa.nulls(len(text), pa.float64()), pa.nulls(len(text), pa.string()), pa.array([False] * len(text), pa.bool_())
            else:
                d = text.dictionary_encode()
                score, names = ratios(d.dictionary.to_pylist(), model[0], model[1])
                best, name, hit = (pa.array(x).take(d.indices) for x in (score, names, score >= model[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, name, best, hit], ["doc_id", "at_byte", "candidate", "format", "log_ratio", "is_secret"])

    return found.mapInArrow(run, "doc_id long, at_byte int, candidate string, format string, log_ratio double, is_secret boolean")
