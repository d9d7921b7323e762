"""Token counts of a sentence-piece BPE model by rank-synchronous merging of arrays.

**Method.** With spaces written as the mark ``\\u2581`` and one put in front, no piece has a mark
after another character; so a text falls into pre-tokens, a run of marks and what follows up to
the next mark, that merge independently. The distinct pre-tokens of a slice are held as one
ragged array of symbols. A round finds each sequence's pair of lowest rank (leftmost of equals),
merges it in all sequences at once, and looks up the two new pairs; sequences without a pair leave
the array with their number of symbols. A character without a piece counts its UTF-8 bytes.

Sequences longer than ``LONG`` symbols would need as many rounds as they have symbols; they go
through a priority queue of the same pairs instead, in n log n. A text's count is the sum over
its pre-tokens.

**Scale.** One scan without a shuffle; a task holds a slice of text and a memo of bounded size.

**Edge cases.** Null and empty texts have no tokens and 0 bytes. Strings of control tokens in a
text are ordinary text. Null ids and equal rows pass through; no rows give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.llm.common import binary, by_slice

MARK = "▁"
PRETOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LONG = 256
#: Pre-tokens merged at once, and known counts kept from one slice to the next.
BLOCK, MEMO = 100_000, 300_000
NONE = np.int64(1 << 40)


class Model:
    """Symbols and ranked pairs of a model file (its normalizer must be the identity, with byte fallback)."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): i for i in ids}
        if any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:], strict=False)):
            raise ValueError(f"{path}: a piece has a mark after another character")
        if any(len(c.encode()) > 1 and c not in pieces for p in pieces for c in p):
            raise ValueError(f"{path}: a piece has a character that is no piece")
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.size = sp.get_piece_size()
        levels = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in ids}, reverse=True))}
        pairs = {}
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = pieces.get(p[:cut]), pieces.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (levels[sp.get_score(i)], i)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.rank = np.array([pairs[k][0] for k in keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] + [-1], np.int32)
        self.pairs = pairs

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; ``NONE`` where they do not merge."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.merged[at], -1)

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Number of symbols that survive in each pre-token."""
        out = np.zeros(len(pretokens), np.int64)
        lens = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        for i in np.flatnonzero(lens > LONG).tolist():
            out[i] = self.count_long(pretokens[i])
        rows = np.flatnonzero((lens > 0) & (lens <= LONG))
        for at in range(0, len(rows), BLOCK):
            part = rows[at:at + BLOCK]
            out[part] = self._count([pretokens[i] for i in part.tolist()], lens[part])
        return out

    def _count(self, pretokens: list[str], lens: np.ndarray) -> np.ndarray:
        points = np.frombuffer("".join(pretokens).encode("utf-32-le"), np.uint32)
        symbol = self.symbol[points]
        extra = np.where(symbol < 0, 0 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 0)
        starts = np.cumsum(lens) - lens
        result = np.add.reduceat(extra, starts)
        rank = np.full(len(symbol), NONE)
        merged = np.full(len(symbol), -1, np.int32)
        rank[:-1], merged[:-1] = self.look_up(symbol[:-1], symbol[1:])
        rank[starts[1:] - 1] = NONE  # no pair over the end of a sequence
        row = np.arange(len(lens))
        while len(row):
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                result[row[~live]] += lens[~live]
                stay = np.repeat(live, lens)
                symbol, rank, merged = symbol[stay], rank[stay], merged[stay]
                row, lens, least = row[live], lens[live], least[live]
                starts = np.cumsum(lens) - lens
                if not len(row):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, lens))
            of = np.searchsorted(starts, hits, side="right") - 1
            at = hits[np.concatenate(([True], of[1:] != of[:-1]))]  # the leftmost of each sequence
            symbol[at] = merged[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            last = at + 1 == starts + lens - 1  # the pair was the last one
            at -= np.arange(len(at))
            symbol, rank, merged = symbol[stay], rank[stay], merged[stay]
            lens = lens - 1
            starts = np.cumsum(lens) - lens
            rank[at[last]], merged[at[last]] = NONE, -1
            for pos in (at[~last], at[at > starts] - 1):
                rank[pos], merged[pos] = self.look_up(symbol[pos], symbol[pos + 1])
        return result

    def count_long(self, pretoken: str) -> int:
        """The same count for one long pre-token, with a queue of (rank, place)."""
        points = np.frombuffer(pretoken.encode("utf-32-le"), np.uint32)
        symbol = self.symbol[points].tolist()
        n, size, pairs = len(symbol), self.size, self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and symbol[i] >= 0 and symbol[j] >= 0 and (got := pairs.get(symbol[i] * size + symbol[j])):
                heapq.heappush(queue, (got[0], i, symbol[i], symbol[j], got[1]))

        for i in range(n - 1):
            push(i)
        gone, total = [False] * n, sum(1 if s >= 0 else len(chr(p).encode()) for s, p in zip(symbol, points.tolist(), strict=True))
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], gone[j], after[i] = new, True, after[j]
            total -= 1
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return total


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a whole text."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" in parts:  # runs of spaces belong together
        return PRETOKEN.findall(MARK + MARK.join(parts))
    return [MARK + p for p in parts]


class Counter:
    """Counts texts of a slice together; the counts of pre-tokens are kept, as many as ``MEMO`` allows."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        split = [pretokens(t) for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        new = list({p for parts in split for p in parts if p not in self.known})
        self.known.update(zip(new, self.model.count(new).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, parts)) for parts in split]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; ``over_limit``: more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Model(model))
        for b in (part for batch in batches for part in by_slice(batch, 1)):
            raw = [t.as_py() for t in binary(b.column(1))]
            n = counter.counts([t.decode() for t in raw])
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64()),
                                   pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
