"""Hidden Markov language model: distributed Baum-Welch, scaled forward scoring.

**Tokens.** Lower-cased (A-Z) words and one end per text. A word is known by a 64-bit hash of its bytes;
of a billion different words some two share one with a chance of three in a hundred.

**Model.** ``STATES`` hidden states emit the ``SYMBOLS`` most frequent training words, the end, or the class of
all rarer words; inside that class a word has its share of the additively smoothed counts, with one
share for all words never seen. So every text has a proper probability.

**Training.** Texts whose crc32 of the id is not 0 modulo ``FOLDS`` are learnt from, all of them in word counts and in
each of ``ROUNDS`` rounds from random but reproducible parameters. Their words are turned into symbols once and
staged, two bytes a token; in a round each task sums expected starts, moves and emissions in single precision by
batches and double precision over them, Spark adds them by symbol, the driver normalises the fixed-size
result. For training only, a longer text is cut into pieces of ``PIECE`` tokens; later pieces start from the
moves' stationary distribution. Every token counts.

**Scoring.** The forward recursion runs over the whole text, scaled at each token, many texts at a time. Counts
of the ``KNOWN`` most frequent words are broadcast (fixed size); all other words of a text meet their
counts in a join by hash, so base scores use exact counts of every word.

**Edge cases.** Null and empty texts are one end token. A null id counts as the text '' in the crc32. No training
text: every count is 0, N is 0, and base scores use a vocabulary of none. Equal rows each get their row;
no rows give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.llm.common import by_slice, words
from compframe.session import staged, unstage

STATES = 8
SYMBOLS = 20_000
KNOWN = 200_000
FOLDS = 10
PIECE = 512
ROUNDS = 14
#: Pieces trained, and tokens scored, at once.
TRAIN_ROWS, SCORE_TOKENS = 2048, 4_000_000
LAST = (1 << 63) - 1
ALPHA = 0.1  # additive smoothing of the base score
PRIOR = 1.0  # pseudo-tokens per state and symbol-share in the emissions, and per move


class Vocabulary(NamedTuple):
    """Sorted hashes of the known words, their counts, and their symbol (``SYMBOLS`` at most; the rest are rare)."""

    hash: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    n_symbols: int
    tokens: int
    types: int
    texts: int

    @property
    def rare(self) -> int:
        return self.n_symbols

    @property
    def end(self) -> int:
        return self.n_symbols + 1

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, index in the known words or -1)."""
        if not len(self.hash):
            return np.full(len(h), self.rare), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = self.hash[at] == h
        return np.where(hit, self.symbol[at], self.rare), np.where(hit, at, -1)


class Model(NamedTuple):
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols + 2, states)


def held_out(id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


# --- counts ----------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) over all words of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_slice(batch, 0)):
            h, n = np.unique(words(b.column(0), lower=True).hash, return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, n_texts: int, symbols: int, known: int) -> Vocabulary:
    """The most frequent words, at most ``known`` and all that are equally frequent or none, and the totals of a table of counts."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the least count that still fits is found on the numbers of words by count, so no task sorts words
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(known).collect()
    least, held = LAST, 0
    for r in sizes:
        held += r.words
        if held > known:
            break
        least = r.n
    top = counts.where(F.col("n") >= least).toArrow()
    h, n = top.column("hash").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((h, -n))
    symbol = np.empty(len(h), np.int64)
    own = min(symbols, len(h))
    symbol[order] = np.minimum(np.arange(len(h)), own)
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], n[by_hash], symbol[by_hash], own, int(total[0]) + n_texts, int(total[1]) + (n_texts > 0), n_texts)


# --- Baum-Welch --------------------------------------------------------------------------------


def sequences(column: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts one after the other, an end after each; where each text begins; hash and known index of every word."""
    w = words(column, lower=True)
    symbol, index = v.find(w.hash)
    return np.insert(symbol, w.first[1:], v.end).astype(np.int32), w.first + np.arange(len(w.first)), w.hash, index


def pieces(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, whether it begins a text) of pieces of at most ``PIECE`` tokens."""
    lens = np.diff(first)
    n = -(-lens // PIECE)
    head = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(head, n)
    begin = np.repeat(first[:-1], n) + k * PIECE
    return begin, np.minimum(PIECE, np.repeat(first[1:], n) - begin), k == 0


def stationary(move: np.ndarray) -> np.ndarray:
    p = np.full(len(move), 1 / len(move))
    for _ in range(64):
        p = p @ move
    return p / p.sum()


def expectations(flat: np.ndarray, first: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of some texts, and their log likelihood by pieces, computed in the model's precision.

    Arrays hold a row a state, a column a token; tokens stand by their place in the piece, so that a step is a range of columns.
    """
    k, kind = len(m.start), m.emit.dtype
    starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape), 0.0
    begin, length, heads = pieces(flat, first)
    order = np.argsort(-length, kind="stable")
    later, turned, emit = stationary(m.move), np.ascontiguousarray(m.move.T), np.ascontiguousarray(m.emit.T)
    for at in range(0, len(order), TRAIN_ROWS):
        rows = order[at:at + TRAIN_ROWS]
        b, n, h = begin[rows], length[rows], heads[rows]
        active = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()  # pieces longer than t
        cut = np.cumsum([0, *active]).tolist()
        symbols = np.concatenate([flat[b[:c] + t] for t, c in enumerate(active)])
        e = emit.take(symbols, axis=1)
        forward, scale = np.empty_like(e), np.empty(len(symbols), kind)
        a = np.where(h, m.start[:, None], later[:, None])
        for t, c in enumerate(active):
            step = slice(cut[t], cut[t + 1])
            f = forward[:, step]
            np.multiply(turned @ a[:, :c] if t else a, e[:, step], out=f)
            f /= f.sum(axis=0, out=scale[step])
            a = f
        total += float(np.log(scale).sum(dtype=np.float64))
        e /= scale
        back = np.ones((k, active[-1]), kind)
        for t in range(len(active) - 1, -1, -1):
            step = slice(cut[t], cut[t + 1])
            forward[:, step] *= back  # the state's probability given the piece
            if t:
                w = e[:, step]
                w *= back
                moves += forward[:, cut[t - 1]:cut[t - 1] + active[t]] @ w.T
                back = np.ones((k, active[t - 1]), kind)
                np.matmul(m.move, w, out=back[:, :active[t]])
        starts += forward[:, :active[0]][:, h].sum(axis=1, dtype=np.float64)
        for j in range(k):
            emits[:, j] += np.bincount(symbols, weights=forward[j], minlength=len(emits))
    return starts, moves * m.move, emits, total


def normalised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray) -> Model:
    """Parameters from expected counts; every emission keeps a part of the symbol's overall share."""
    start = starts + 1.0
    move = moves + PRIOR
    emit = emits + PRIOR * len(share) * share[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def shares(v: Vocabulary) -> np.ndarray:
    """Overall share of each symbol in the training tokens, none zero."""
    out = np.full(v.n_symbols + 2, 0.5)
    np.add.at(out, v.symbol, v.count)
    out[v.end] += v.texts
    out[v.rare] += max(v.tokens - v.texts - int(v.count.sum()), 0)
    return out / out.sum()


def class_total(v: Vocabulary) -> float:
    """Smoothed count of all words of the rare class together, with one share for the unseen."""
    own = v.symbol < v.rare
    n_words, n_types = v.tokens - v.texts, v.types - (v.texts > 0)
    return n_words - int(v.count[own].sum()) + ALPHA * (n_types - int(own.sum()) + 1)


def first_model(v: Vocabulary, states: int) -> Model:
    """Random but reproducible parameters around the overall shares."""
    rng = np.random.default_rng(7)
    emit = shares(v)[:, None] * rng.uniform(0.5, 1.5, (v.n_symbols + 2, states))
    move = rng.uniform(0.5, 1.5, (states, states)) + 4 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def symbols_of(texts: DataFrame, v: Vocabulary) -> DataFrame:
    """The symbols of every text as bytes, ``symbol_type`` each."""
    sent, kind = texts.sparkSession.sparkContext.broadcast(v), symbol_type(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in (part for batch in batches for part in by_slice(batch, 0)):
            flat, first, _, _ = sequences(b.column(0), v)
            data = flat.astype(kind)
            packed = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(first * data.itemsize), pa.py_buffer(data)])
            yield pa.record_batch([packed.cast(pa.binary())], ["symbols"])

    return texts.mapInArrow(run, "symbols binary")


def symbol_type(v: Vocabulary) -> np.dtype:
    return np.dtype("<u2" if v.end < 1 << 16 else "<i4")


def one_round(symbols: DataFrame, v: Vocabulary, m: Model) -> Model:
    """One Baum-Welch round over the texts' ``symbols_of``: tasks sum expected counts, Spark adds them by symbol."""
    sent, kind = symbols.sparkSession.sparkContext.broadcast(Model(*(x.astype(np.float32) for x in m))), symbol_type(v)
    k, size = len(m.start), len(m.emit)
    names = ["row", *(f"s{j}" for j in range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        sums = np.zeros((size + k + 1, k))
        for b in (part for batch in batches for part in by_slice(batch, 0)):
            column = b.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(kind)
            starts, moves, emits, _ = expectations(flat, (offsets - offsets[0]) // kind.itemsize, m)
            sums[:size] += emits
            sums[size:size + k] += moves
            sums[size + k] += starts
        rows = np.flatnonzero(sums.any(axis=1))
        yield pa.record_batch([pa.array(rows.astype(np.int32)), *(pa.array(sums[rows, j].astype(np.float32)) for j in range(k))], names)

    schema = "row int, " + ", ".join(f"{c} float" for c in names[1:])
    got = symbols.mapInArrow(run, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    sent.destroy()
    sums = np.zeros((size + k + 1, k))
    sums[got.column("row").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names[1:]], axis=1)
    return normalised(sums[size + k], sums[size:size + k], sums[:size], shares(v))


def trained(texts: DataFrame, v: Vocabulary, states: int = STATES) -> Model:
    """A model of the training texts (id, text), all of them in every round."""
    symbols = staged(symbols_of(texts.select("text"), v), "lm-symbols")
    m = first_model(v, states)
    for _ in range(ROUNDS):
        m = one_round(symbols, v, m)
    unstage(symbols)
    return m


# --- scoring -----------------------------------------------------------------------------------


def log10_likelihood(flat: np.ndarray, first: np.ndarray, m: Model) -> np.ndarray:
    """log10 of each text's probability by the scaled forward recursion over all its tokens."""
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    begin, n = first[:-1][order], lens[order]
    out = np.zeros(len(n))
    if not len(n):
        return out
    active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
    a = np.broadcast_to(m.start, (len(n), len(m.start)))
    for t, c in enumerate(active.tolist()):
        a = (a[:c] @ m.move if t else a[:c]) * m.emit[flat[begin[:c] + t]]
        s = a.sum(axis=1)
        a = a / s[:, None]
        out[:c] += np.log10(s)
    result = np.empty(len(n))
    result[order] = out
    return result


def _scored(docs: DataFrame, v: Vocabulary, m: Model) -> DataFrame:
    """A row per text: what the known words give, and the hashes of the others with how often they stand."""
    sent = docs.sparkSession.sparkContext.broadcast((v, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = sent.value
        base = TaskContext.get().partitionId() << 33
        logs = np.append(np.log10(v.count + ALPHA), 0.0)  # index -1: not known
        in_class = np.append(v.symbol == v.rare, False)
        held, tokens = [], 0
        row = 0

        def out() -> pa.RecordBatch:
            nonlocal row
            flat = np.concatenate([x[0] for x in held])
            firsts, shift = [np.zeros(1, np.int64)], 0
            for x in held:
                firsts.append(x[1][1:] + shift)
                shift += len(x[0])
            score = log10_likelihood(flat, np.concatenate(firsts), m)
            n = len(score)
            rows = base + row + np.arange(n)
            row += n
            cols = [pa.concat_arrays([x[2][i] for x in held]) for i in range(7)]
            return pa.record_batch([pa.array(rows, pa.int64()), *cols[:5], pa.array(score), *cols[5:]],
                                   ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_known", "log_class", "rare", "times"])

        for b in (part for batch in batches for part in by_slice(batch, 2)):
            flat, first, h, index = sequences(b.column(2), v)
            n = b.num_rows
            at = first - np.arange(n + 1)  # first word of each text
            of = np.repeat(np.arange(n), np.diff(at))
            known = index >= 0
            summed = np.bincount(of, weights=logs[index], minlength=n)
            inner = np.bincount(of, weights=np.where(in_class[index], logs[index], 0.0), minlength=n)
            other, text = h[~known], of[~known]
            order = np.lexsort((other, text))
            other, text = other[order], text[order]
            begins = np.flatnonzero(np.concatenate(([True], (other[1:] != other[:-1]) | (text[1:] != text[:-1])))) if len(other) else np.zeros(0, np.int64)
            times = np.diff(np.append(begins, len(other)))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text[begins], minlength=n)))), pa.int32())
            held.append((flat, first, [
                b.column(0), b.column(1), pa.array(np.diff(first), pa.int64()), pa.array(np.bincount(of, weights=known, minlength=n).astype(np.int64)),
                pa.StructArray.from_arrays([pa.array(summed), pa.array(inner)], ["all", "rare"]),
                pa.ListArray.from_arrays(offsets, pa.array(other[begins].view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]))
            tokens += len(flat)
            if tokens >= SCORE_TOKENS:
                yield out()
                held, tokens = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_known struct<all:double,rare:double>, "
                                "log_class double, rare array<long>, times array<int>")


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", states: int = STATES, symbols: int = SYMBOLS, known: int = KNOWN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    own = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("text"))
    train = own.where("NOT held_out").select(F.col("doc_id").alias("id"), "text")
    counts = staged(word_counts(train.select("text")), "word-counts")
    v = vocabulary(counts, train.count(), symbols, known)
    m = trained(train, v, states)
    m.emit[v.rare] /= class_total(v)  # from here on a rare word's own smoothed count is the other factor
    rows = staged(_scored(own, v, m), "scored")
    each = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("t"))
    met = each.join(counts, "hash", "left").groupBy("row").agg(
        F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("t"))), F.lit(0)).alias("seen"),
        F.sum(F.col("t") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("logs"))
    whole = float(np.log10(v.tokens + ALPHA * (v.types + 1)))
    end = float(np.log10(v.texts + ALPHA))
    seen, logs = F.coalesce("seen", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return rows.drop("rare", "times").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen + int(v.texts > 0)).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("log_known.all") + logs + end - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("log_class") + F.col("log_known.rare") + logs).alias("score"))
