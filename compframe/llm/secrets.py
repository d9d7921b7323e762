"""Secret scan: plain patterns, and credential values that would be expensive to guess.

**Base.** Three patterns, each leftmost and non-overlapping by itself: assignments of a
credential name, access keys, and long hexadecimal runs. A match that is too short is dropped
after it was matched, so it still covers its text.

**Method.** Values that stand in a credential context (a name such as ``auth`` or ``private_key``,
a separator, a value; or ``Bearer`` and a value) are rated by how many guesses a cracker needs.
A dynamic programme finds the cheapest segmentation of the value into dictionary words, dates,
repeats of a unit, keyboard walks and brute-force spans; the guesses of segments multiply, and
k segments can stand in k! orders. Values of at least ``GUESSES`` (log10) become spans of kind
``value``. They are added to the base spans, which always stay. The programme runs over the whole
value and over every number of segments; what is dropped on the way is only what costs as much as
something that has no more segments, or what needs enough guesses already.

**Edge cases.** Null and empty texts have no spans. Texts and values are read whole. Null ids and
equal rows pass through; no rows give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.llm.common import by_slice

BASE_KINDS = ("assign", "access", "hex")
VALUE = "value"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run has no longer match inside
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|auth(?:orization)?|credentials?|private_?key|access_?key|client_?secret)"""
    r"""["']?\x20*(?::=|=>|[:=])\x20*["']?|\bbearer\x20+)([^\s"'`,;<>(){}]{8,})""", re.I | re.A)
#: Text that every match of ASSIGN or CONTEXT has, in lower case.
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")

GUESSES = 10.0
BRUTE = 10  # guesses a character of a brute-force span, as published estimators take it
#: Frequent words of passwords, most frequent first (fixed values).
COMMON = """password admin welcome letmein qwerty monkey dragon master login princess sunshine football baseball shadow
superman michael secret token test example changeme default root user guest demo sample hello love
abc key pass my the your this that null none true false value string""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
BY_LETTER = {c: [(w, r) for w, r in RANK.items() if w[0] == c] for c in {w[0] for w in RANK}}
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
KEYS = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _adjacent(a: str, b: str) -> bool:
    p, q = KEYS.get(a), KEYS.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _patterns(value: str, low: str, plain: str, i: int, most: float, unit_before: tuple[str, ...]) -> Iterator[tuple[int, float, str]]:
    """(end, log10 guesses, unit if it is a repeat) of every pattern that starts at i and costs less than ``most``, brute force excepted.

    ``unit_before``: if every way to i worth going on with ends in a repeat, the units; a repeat that only goes on with one is the longer repeat.
    """
    n = len(value)
    for word, rank in BY_LETTER.get(plain[i], ()):
        if plain.startswith(word, i):
            part, end = value[i:i + len(word)], i + len(word)
            times = 1 + (part != part.lower()) + (low[i:end] != plain[i:end])
            yield end, math.log10(2 * rank * 2 ** (times - 1)), ""
    if m := DATE.match(value, i):
        yield m.end(), math.log10(365 * 120 * (4 if len(m[0]) > 8 else 1)) if len(m[0]) > 4 else math.log10(120), ""
    for size in range(1, 5):
        unit = value[i:i + size]
        if len(unit) < size or unit_before and all(len(u) <= size and size % len(u) == 0 and unit == u * (size // len(u)) for u in unit_before):
            continue
        times = 1
        while value.startswith(unit, i + times * size):
            times += 1
            cost = size * math.log10(BRUTE) + math.log10(times)
            if cost >= most:
                break
            if times * size >= 3 or value.startswith(unit, i + times * size):  # two equal letters count at the head of a longer run
                yield i + times * size, cost, unit
    j, turns = i + 1, 0
    while j < n and _adjacent(low[j - 1], low[j]):
        if j - i >= 2 and (KEYS[low[j]][0] - KEYS[low[j - 1]][0], KEYS[low[j]][1] - KEYS[low[j - 1]][1]) != (
                KEYS[low[j - 1]][0] - KEYS[low[j - 2]][0], KEYS[low[j - 1]][1] - KEYS[low[j - 2]][1]):
            turns += 1
        j += 1
        if j - i >= 3:
            cost = math.log10(47 * 4.6) + math.log10(j - i) + turns * math.log10(4.6)
            if cost >= most:
                break
            yield j, cost, ""


@lru_cache(maxsize=4096)
def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation needs, or ``enough`` if it needs no fewer.

    ``ways[j]``: for the first j characters, by number of segments the cheapest product and the unit of its last segment if
    that is a repeat. ``brute[k]``: the cheapest product of k segments the last of which is an open brute-force span.
    """
    low = value.lower()
    low = low if len(low) == len(value) else value  # a few letters have two in lower case
    plain, n = low.translate(LEET), len(value)
    ways: dict[int, dict[int, tuple[float, str]]] = {0: {0: (0.0, "")}}
    step = math.log10(BRUTE)
    brute: dict[int, float] = {}

    def total(k: int, cost: float) -> float:
        return cost + math.lgamma(k + 1) / math.log(10)

    def put(row: dict[int, tuple[float, str]], k: int, cost: float, unit: str) -> None:
        if total(k, cost) < enough and (k not in row or cost < row[k][0]):
            row[k] = cost, unit

    for j in range(n + 1):
        row = ways.pop(j, {})
        for k, cost in brute.items():
            put(row, k, cost, "")
        # of two ways the one with fewer segments and no higher cost is as good whatever follows
        live, least = {}, math.inf
        for k in sorted(row):
            if row[k][0] < least:
                live[k], least = row[k], row[k][0]
        if j == n:
            return min((total(k, cost) for k, (cost, _) in live.items()), default=enough)
        if live:
            most = max(enough - total(k + 1, cost) for k, (cost, _) in live.items())
            units = tuple({u for _, u in live.values()})
            for end, more, unit in _patterns(value, low, plain, j, most, units if all(units) else ()):
                at = ways.setdefault(end, {})
                for k, (cost, _) in live.items():
                    put(at, k + 1, cost + more, unit)
        for k, (cost, _) in live.items():
            brute[k + 1] = min(brute.get(k + 1, math.inf), cost)
        brute = {k: cost + step for k, cost in brute.items() if total(k, cost + step) < enough}
        if not brute and not any(ways.values()):
            return enough
    return enough


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def value_spans(text: str, guesses: float = GUESSES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of credential values that need at least so many guesses."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    return [(m.start(1), m.end(1), VALUE) for m in CONTEXT.finditer(text) if guess_cost(m[1], guesses) >= guesses]


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, guesses: float = GUESSES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text.

    Spans are ``kind:start:end`` in code points, the end excluded, by start and then kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_slice(batch, 1)):
            counts, digests, spans = [], [], []
            for t in pc.fill_null(b.column(1), "").to_pylist():
                base = base_spans(t)
                kinds = [k for _, _, k in base]
                counts.append([kinds.count(k) for k in BASE_KINDS])
                digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                order = (*BASE_KINDS, VALUE)
                spans.append(spelled(sorted(base + value_spans(t, guesses), key=lambda s: (s[0], order.index(s[2]), s[1]))))
            yield pa.record_batch([b.column(0), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)], pa.array(digests, pa.string()),
                                   pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
