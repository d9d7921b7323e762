"""Conversation structure repair by block tables (the method of the Four Russians).

A conversation should read ``(s?(ua)+)?`` in the initials of its roles, without blank turns and
repeats. The cheapest edits that get it there are a shortest path over four states: nothing yet,
after s, after u, after a. What the rest of a conversation costs from each state is a vector of
four numbers; less its smallest it takes few values, which are found by trying every symbol on
every vector (a symbol is a turn's role class and fault).

**Block tables.** For every such vector and every block of ``BLOCK`` symbols the vector in front
of the block and the cost it adds are computed once. A conversation is then read from its end,
one look-up a block; only the vectors at block borders are kept. For the edits themselves it is
read forward once more: each block is expanded backward from the vector at its end, and at every
turn the ASCII-least edit is taken among those that keep to the optimum. So ties are settled over
the whole conversation and not block by block.

**Scale.** Rows are dealt by ranges of (conversation, turn, digest, row number), so that a
conversation of any share of the rows is spread over as many tasks as it fills. A conversation
inside one range is finished there. The first and the last one of a range may go on in the
neighbours and are worked on in pieces, one a range: repeats are found by the smallest position of
every (conversation, digest); a piece is summed up as a table from each possible vector behind it
to the vector in front and to the state each state leads to; these summaries, a few hundred bytes
a piece, meet by conversation; then every piece expands its own part. What is left of a long
conversation in one task is its digest, which streams through in order.

**Edge cases.** A null role or text counts as one space, a null turn comes first, null ids are
one conversation of their own. Equal turns are put in the order of the MD5 of role and text;
repeated rows are duplicates. An empty role, or one that begins with none of s, u, a, can only be
changed or deleted. A row marked as dropped only makes its conversation known. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.llm.common import importable
from compframe.session import staged

DELETE, INSERT, REROLE, SHORT = 4, 3, 3, 3
BLOCK = 4
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: States: nothing yet, after s, after u, after a. Where a user or assistant turn leads, and where a role class (s, u, a) may be kept.
ONWARD = (2, 2, 3, 2)
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
CLASSES = {"s": 0, "u": 1, "a": 2}
#: Symbols: role class (other: 3) of a sound turn, of a truncated one, and any turn that must go.
GONE = 8
SYMBOLS = 9
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows of one range; longer ranges do not occur.
RANGE = 1 << 40
#: Bytes of a transcript that go into one row.
CHUNK = 1 << 20


def _closed(v: list[int]) -> tuple[int, ...]:
    """A cost vector after inserts: as many as it takes."""
    for _ in range(len(v)):
        v = [min(x, INSERT + v[ONWARD[q]]) for q, x in enumerate(v)]
    return tuple(v)


def _before(v: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The cost vector in front of a turn, from the one behind it."""
    out = []
    for q in range(4):
        costs = [DELETE + v[q]]
        if symbol < GONE:
            role, extra = symbol % 4, SHORT * (symbol >= 4)
            costs.append(REROLE + extra + v[ONWARD[q]])
            if (q, role) in KEPT:
                costs.append(extra + v[KEPT[q, role]])
        out.append(min(costs))
    return _closed(out)


LAST = _closed([0, 99, 99, 0])


class Tables:
    """Normalised vectors and what one symbol, or one block of symbols, makes of them."""

    def __init__(self) -> None:
        low = min(LAST)
        self.vectors = [tuple(x - low for x in LAST)]
        number = {self.vectors[0]: 0}
        one: list[list[tuple[int, int]]] = []
        while len(one) < len(self.vectors):
            row = []
            for s in range(SYMBOLS):
                v = _before(self.vectors[len(one)], s)
                low = min(v)
                v = tuple(x - low for x in v)
                if v not in number:
                    number[v] = len(self.vectors)
                    self.vectors.append(v)
                row.append((number[v], low))
            one.append(row)
        self.one = [[n for n, _ in row] for row in one]
        step = np.array(self.one)
        cost = np.array([[c for _, c in row] for row in one])
        #: Row v, column the block's symbols as digits, first symbol first.
        self.next, self.cost = step, cost
        for _ in range(BLOCK - 1):  # one more symbol in front
            self.next, self.cost = (
                np.stack([step[self.next, s] for s in range(SYMBOLS)], axis=1).reshape(len(step), -1),
                np.stack([self.cost + cost[self.next, s] for s in range(SYMBOLS)], axis=1).reshape(len(step), -1))
        self.block_next, self.block_cost = self.next.tolist(), self.cost.tolist()
        self.one_cost = cost.tolist()
        #: For the vector behind a turn, its symbol and a state: the least edits at that turn and the state they lead to.
        self.turn = [[[self._turn(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in self.vectors]
        #: State after a turn, by vector, symbol and state, as an array.
        self.leads = np.array([[[q2 for _, q2 in row] for row in rows] for rows in self.turn])
        self.step = step

    @staticmethod
    def _turn(v: tuple[int, ...], symbol: int, q: int) -> tuple[str, int]:
        here, edits = _before(v, symbol), ""
        while True:
            role, extra = symbol % 4, SHORT * (symbol >= 4)
            if DELETE + v[q] == here[q]:
                return edits + "D", q
            if INSERT + here[ONWARD[q]] == here[q]:
                edits, q = edits + "I", ONWARD[q]
                continue
            if symbol < GONE and (q, role) in KEPT and extra + v[KEPT[q, role]] == here[q]:
                return edits + "K", KEPT[q, role]
            return edits + "R", ONWARD[q]

    @staticmethod
    def closing(q: int) -> str:
        """Inserts behind the last turn."""
        edits = ""
        while q not in (0, 3):
            edits, q = edits + "I", ONWARD[q]
        return edits


@cache
def tables() -> Tables:
    return Tables()


@lru_cache(1 << 16)
def _expanded(v: int, symbols: bytes, q: int) -> tuple[str, int]:
    """Least edits of a block and the state behind it: inner vectors backward from ``v``, then forward from ``q``."""
    t = tables()
    inner = [v]
    for s in symbols[:0:-1]:
        inner.append(t.one[inner[-1]][s])
    edits = ""
    for s, w in zip(symbols, reversed(inner), strict=True):
        more, q = t.turn[w][s][q]
        edits += more
    return edits, q


def _blocks(symbols: bytes) -> list[bytes]:
    """Whole blocks from the end, and a shorter one at the beginning."""
    odd = len(symbols) % BLOCK
    return [symbols[:odd]] * bool(odd) + [symbols[i:i + BLOCK] for i in range(odd, len(symbols), BLOCK)]


def _borders(blocks: list[bytes], v: int) -> tuple[list[int], int]:
    """Vectors at the borders of blocks, first one in front of all, and the cost that normalising took away."""
    t, out, cost = tables(), [v], 0
    for b in reversed(blocks):
        if len(b) == BLOCK:
            code = 0
            for s in b:
                code = code * SYMBOLS + s
            cost += t.block_cost[v][code]
            v = t.block_next[v][code]
        else:
            for s in reversed(b):
                cost += t.one_cost[v][s]
                v = t.one[v][s]
        out.append(v)
    return out[::-1], cost


def trace(symbols: bytes, v: int = 0, q: int = 0, last: bool = True) -> tuple[str, int]:
    """Least cheapest edits of a row of turns, from state ``q`` on, and their cost; ``v`` is the vector behind them."""
    t, blocks = tables(), _blocks(symbols)
    border, cost = _borders(blocks, v)
    cost += t.vectors[border[0]][q] - (0 if last else min(t.vectors[v]))
    out = []
    for b, w in zip(blocks, border[1:], strict=True):
        edits, q = _expanded(w, b, q)
        out.append(edits)
    if last:
        out.append(t.closing(q))
    return "".join(out), cost


def summary(symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every vector behind a piece: the vector in front of it, the cost taken away, and the state each state leads to."""
    t = tables()
    n = len(t.vectors)
    v, cost = np.arange(n), np.zeros(n, np.int64)
    one_cost = np.array(t.one_cost)
    behind = np.zeros((len(symbols), n), np.int16)
    for i in range(len(symbols) - 1, -1, -1):
        behind[i] = v
        cost += one_cost[v, symbols[i]]
        v = t.step[v, symbols[i]]
    state = np.tile(np.arange(4), (n, 1))
    for i, s in enumerate(symbols):
        state = t.leads[behind[i], s][np.arange(n)[:, None], state]
    return v, cost, state


def symbol(role: str, fault: int) -> int:
    """A turn's symbol."""
    if fault in (BLANK, DUPLICATE):
        return GONE
    return CLASSES.get(role[:1], 3) + 4 * (fault == TRUNCATED)


def fault_of(text: str) -> int:
    """Blank, truncated or fine, by the text alone."""
    body = text.rstrip(BLANKS)
    return BLANK if not body else FINE if body[-1] in ENDS else TRUNCATED


def repaired(turns: Iterator[tuple[str, str]], edits: str, q: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits, which begin in state ``q``."""
    for e in edits:
        if e == "D":
            next(turns)
            continue
        role, text = ("assistant" if q == 2 else "user"), ""
        if e == "R":
            text = next(turns)[1]
        if e == "K":
            role, text = next(turns)
            q = KEPT[q, CLASSES[role[0]]]
        else:
            q = ONWARD[q]
        yield role, text


def _legal(a: str, b: str) -> bool:
    return (a + b) in ("su", "ua", "au")


class Tally:
    """Counters of a run of turns in order, which can be joined with those of the next run."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.first = self.final = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        if self.first is None:
            self.first = role[:1]
        else:
            self.illegal += not _legal(self.final, role[:1])
        self.final = role[:1]
        self.faults[fault] += 1

    def join(self, low, high, turns, illegal, blank, duplicate, truncated, first, final) -> None:
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low = low if self.low is None else self.low
            self.high = high
        if first is not None:
            self.illegal += illegal + (self.final is not None and not _legal(self.final, first))
            self.first, self.final = first if self.first is None else self.first, final
        for f, n in ((BLANK, blank), (DUPLICATE, duplicate), (TRUNCATED, truncated)):
            self.faults[f] += n

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


FIRST = pa.schema([
    ("open", pa.bool_()), ("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
    ("text", pa.string()), ("digest", pa.string()), ("fault", pa.int32()), ("gaps", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
FIRST_DDL = ("open boolean, conv_id long, part long, at long, turn long, role string, text string, digest string, fault int, gaps long, "
             "blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _whole(conv_id, rows: list[tuple]) -> tuple:
    """The finished row of a conversation; its text is the transcript."""
    tally, seen, turns = Tally(), set(), []
    symbols = bytearray()
    for turn, role, text, _, dropped in rows:
        if dropped:
            continue
        fault = fault_of(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        tally.add(turn, role, fault)
        symbols.append(symbol(role, fault))
        turns.append((role, text))
    edits, cost = trace(bytes(symbols))
    transcript = "\n".join(f"{r}:{t}" for r, t in repaired(iter(turns), edits))
    return (False, conv_id, None, None, None, None, transcript, None, None, tally.gaps, *tally.faults[1:], tally.illegal, cost, edits)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int, weight) -> Iterator[pa.RecordBatch]:
    """Rows put together to batches of about ``size`` bytes."""
    held, bytes_ = [], 0
    for r in rows:
        held.append(r)
        bytes_ += 64 + weight(r)
        if bytes_ >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, bytes_ = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of rows in order: inner conversations are finished, turns of the first and the last go on as they are."""
    part = TaskContext.get().partitionId()

    def opened(conv_id, row, n):
        turn, role, text, digest, dropped = row
        fault = None if dropped else fault_of(text)
        return (True, conv_id, part, part * RANGE + n, turn, role, text, digest, fault, *[None] * 7)

    def rows() -> Iterator[tuple]:
        n, first, current, held = 0, True, None, []
        for b in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n and conv_id != current:
                    if not first:
                        yield _whole(current, held)
                    first, held = False, []
                current = conv_id
                if first:
                    yield opened(conv_id, row, n)
                else:
                    held.append(row)
                n += 1
        for i, row in enumerate(held):
            yield opened(current, row, n - len(held) + i)

    yield from _batches(rows(), FIRST, 4 << 20, lambda r: len(r[6] or ""))


PIECE = pa.schema([
    ("key", pa.string()), ("part", pa.int64()), ("conv_id", pa.int64()), ("symbols", pa.binary()), ("front", pa.binary()), ("cost", pa.binary()),
    ("leads", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("illegal", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("first", pa.string()), ("final", pa.string())])
PIECE_DDL = ("key string, part long, conv_id long, symbols binary, front binary, cost binary, leads binary, low long, high long, turns long, "
             "illegal long, blank long, duplicate long, truncated long, first string, final string")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows that agree in the first ``width`` columns; a run is read as it comes."""
    from itertools import groupby
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    yield from groupby(rows, key=lambda r: r[:width])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of pieces; input: key, part, conv_id, at, turn, role initial, fault in order."""

    def rows():
        for (key, part, conv_id), run in _runs(batches, 3):
            tally, symbols = Tally(), bytearray()
            for _, _, _, _, turn, role, fault in run:
                if fault is not None:
                    tally.add(turn, role, fault)
                    symbols.append(symbol(role, fault))
            front, cost, leads = summary(bytes(symbols))
            yield (key, part, conv_id, bytes(symbols), front.astype("<i2").tobytes(), cost.astype("<i8").tobytes(), leads.astype("i1").tobytes(),
                   tally.low, tally.high, tally.turns, tally.illegal, *tally.faults[1:], tally.first, tally.final)

    yield from _batches(rows(), PIECE, 1 << 20, lambda r: len(r[3]) + 600)


PLAN = pa.schema([("key", pa.string()), ("part", pa.int64()), ("v", pa.int32()), ("q", pa.int32()), ("last", pa.bool_()), ("gaps", pa.int64()),
                  ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64())])
PLAN_DDL = ("key string, part long, v int, q int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, "
            "cost long")


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every piece the vector behind it and the state in front; the conversation's counters stand with its last piece."""

    def rows():
        t = tables()
        for (key,), run in _runs(batches, 1):
            pieces, tally = [], Tally()
            for _, part, front, cost, leads, *counters in run:
                pieces.append((part, np.frombuffer(front, "<i2"), np.frombuffer(cost, "<i8"), np.frombuffer(leads, "i1").reshape(-1, 4)))
                tally.join(*counters)
            v, total, behind = 0, 0, []
            for _, front, cost, _ in reversed(pieces):
                behind.append(v)
                total += int(cost[v])
                v = int(front[v])
            total += t.vectors[v][0]
            q = 0
            for i, ((part, _, _, leads), w) in enumerate(zip(pieces, reversed(behind), strict=True)):
                last = i == len(pieces) - 1
                yield (key, part, w, q, last, *((tally.gaps, *tally.faults[1:], tally.illegal, total) if last else (None,) * 6))
                q = int(leads[w, q])

    yield from _batches(rows(), PLAN, 1 << 20, lambda r: 64)


TEXT = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("transcript", pa.string()), ("audit", pa.string())])
TEXT_DDL = "key string, conv_id long, part long, chunk long, transcript string, audit string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transcripts of pieces in chunks; a piece's first row holds its symbols and plan, its turns follow."""

    def rows():
        for (key, part, conv_id), run in _runs(batches, 3):
            _, _, _, _, symbols, v, q, last, _, _ = next(run)
            edits, _ = trace(symbols, v, q, last)
            turns = ((r[8], r[9]) for r in run)
            n, held, size, audit = 0, [], 0, edits
            for role, text in repaired(turns, edits, q):
                line = f"{role}:{text}"
                held.append(line)
                size += len(line)
                if size >= CHUNK:
                    yield (key, conv_id, part, n, "\n".join(held), audit)
                    n, held, size, audit = n + 1, [], 0, ""
            if held or not n:
                # None: a piece that leaves no line, so no line break either
                yield (key, conv_id, part, n, "\n".join(held) if held else None, audit)

    yield from _batches(rows(), TEXT, 4 << 20, lambda r: len(r[4] or "") + len(r[5]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, conv_id, audit, sha256) of conversations in pieces, chunk by chunk."""
    schema = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def rows():
        for (key, conv_id), run in _runs(batches, 2):
            digest, audit, lines = hashlib.sha256(), [], False
            for _, _, _, _, transcript, edits in run:
                audit.append(edits)
                if transcript is not None:
                    digest.update((("\n" if lines else "") + transcript).encode("utf-8", "surrogatepass"))
                    lines = True
            yield key, conv_id, "".join(audit), digest.hexdigest()

    yield from _batches(rows(), schema, 1 << 20, lambda r: len(r[2]))


COUNTERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           dropped: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repairs conversations.

    Returns (whole, verdicts, transcripts). ``whole`` has one row for each conversation that lay in one range: conv_id, the
    counters (gaps, blank, duplicate, truncated, illegal, cost), audit and transcript. The others are in ``verdicts`` (key,
    counters) and ``transcripts`` (key, conv_id, part, chunk, transcript, audit), in order of part and chunk.
    """
    importable(turns.sparkSession)
    r, t = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    gone = F.col(dropped) if dropped else F.lit(False)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"),
                        F.when(gone, "").otherwise(t).alias("text"), F.md5(F.concat(r, F.lit("\0"), t)).alias("digest"), gone.alias("dropped"),
                        F.monotonically_increasing_id().alias("row"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest", "row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    first = staged(ranged.mapInArrow(_in_range, FIRST_DDL), "turns")
    whole = first.where("NOT open").select("conv_id", *COUNTERS, "audit", F.col("text").alias("transcript"))

    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    opened = first.where("open").select(key.alias("key"), "part", "conv_id", "at", "turn", "role", "text", "digest", "fault")
    # the first of equal turns is known by its position, which no other row has
    leaders = opened.where("fault IS NOT NULL").groupBy("key", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("leads"))
    judged = opened.select("key", "part", "conv_id", "at", "turn", F.substring("role", 1, 1).alias("role"), "fault").join(leaders, "at", "left").select(
        "key", "part", "conv_id", "at", "turn", "role",
        F.when(F.col("fault").isNull() | (F.col("fault") == BLANK) | F.col("leads"), F.col("fault")).otherwise(DUPLICATE).alias("fault"))
    pieces = staged(judged.repartition("key", "part").sortWithinPartitions("key", "part", "at").mapInArrow(_pieces, PIECE_DDL), "pieces")
    plans = staged(pieces.select("key", "part", "front", "cost", "leads", "low", "high", "turns", "illegal", "blank", "duplicate", "truncated",
                                 "first", "final").repartition("key").sortWithinPartitions("key", "part").mapInArrow(_composed, PLAN_DDL), "plans")
    heads = pieces.select("key", "part", "conv_id", "symbols").join(plans.select("key", "part", "v", "q", "last"), ["key", "part"]).select(
        "key", "part", "conv_id", F.lit(-1).cast("long").alias("at"), "symbols", "v", "q", "last", F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"))
    nothing = F.lit(None)
    bodies = opened.where("fault IS NOT NULL").select(
        "key", "part", "conv_id", "at", nothing.cast("binary").alias("symbols"), nothing.cast("int").alias("v"), nothing.cast("int").alias("q"),
        nothing.cast("boolean").alias("last"), "role", "text")
    transcripts = heads.unionByName(bodies).repartition("key", "part").sortWithinPartitions("key", "part", "at").mapInArrow(_applied, TEXT_DDL)
    verdicts = plans.where("last").select("key", *COUNTERS)
    return whole, verdicts, transcripts


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with the faults that the query plants, by CRC-32 of ``conv_id:turn`` modulo 20; a dropped turn stays as a mark."""
    c = {n: F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(c["conv_id"], F.lit(":"), c["turn"])) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(c["role"]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(c["text"], ENDS, "")).otherwise(c["text"]).alias("text"),
        (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy", "copies")


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after the damage."""
    whole, verdicts, transcripts = repair(damaged(conversations), dropped="dropped")
    done = whole.select("conv_id", *COUNTERS, "audit", F.sha2(F.col("transcript"), 256).alias("repaired_sha256"))
    pieces = staged(transcripts, "transcripts").select("key", "conv_id", "part", "chunk", "transcript", "audit")
    hashed = pieces.repartition("key").sortWithinPartitions("key", "part", "chunk").mapInArrow(
        _digest, "key string, conv_id long, audit string, repaired_sha256 string")
    split = hashed.join(verdicts, "key").select("conv_id", *COUNTERS, "audit", "repaired_sha256")
    return done.unionByName(split)


def brute(symbols: bytes) -> tuple[str, int]:
    """Least cheapest edits by trying every path in order of cost; for tests on short rows of turns."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    n = len(symbols)
    for i, q in product(range(n, -1, -1), range(4)):
        best[i, q] = (0, "") if i == n and q in (0, 3) else (1 << 30, "")
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in range(4):
                found = [best[i, q], (INSERT + best[i, ONWARD[q]][0], "I" + best[i, ONWARD[q]][1])]
                if i < n:
                    s = symbols[i]
                    found.append((DELETE + best[i + 1, q][0], "D" + best[i + 1, q][1]))
                    if s < GONE:
                        extra = SHORT * (s >= 4)
                        after = best[i + 1, ONWARD[q]]
                        found.append((REROLE + extra + after[0], "R" + after[1]))
                        if (q, s % 4) in KEPT:
                            after = best[i + 1, KEPT[q, s % 4]]
                            found.append((extra + after[0], "K" + after[1]))
                best[i, q] = min(found)
    return best[0, 0][1], best[0, 0][0]
