"""Document fingerprints by a randomised edit embedding.

**Embedding.** A walker stands on the first character. At every step it notes the character
under it and then stays or goes on by one, as a random bit of (step, character) says; all texts
share these bits. Two texts that differ by an edit fall out of step there and, as both walks are
random, into step again soon after: edit distance turns into Hamming distance between the notes.
A text over ``SECTION`` characters is walked in sections, each from step 0.

**Fingerprint.** Of the notes only sampled steps are kept. A step has a fixed random rank, and a
text of up to 2^k characters keeps the steps whose rank is below a rate that halves from one k
to the next. So a text has about ``SAMPLES`` / 2 to ``SAMPLES`` notes over its whole length, and
the steps of one scale are among those of every finer one: texts of different scales are compared
at the coarser one's steps. Written: two hex digits for k, then a digit for every step: 0 when
the walk is over, else one of 15 classes of the character. Trailing zeros are dropped.

**Likeness.** The share of equal digits among the steps where either text still has characters.

**Near-duplicates.** A band is ``ROWS`` sampled steps; texts with equal digits there share a
bucket (a text also enters the next scale's bands, so that lengths on both sides of a power of
two meet). In a bucket every text meets ``LEADERS`` random members, never all others; many bands
make up for it. Pairs are verified by their likeness and then by the exact edit distance, at
most ``EDITS`` of the longer text.

**Scale.** Texts are dealt once, by ranges of the id, so that a text and its successor are
neighbours in a task; only the first and the last text of every range meet in a second step. No
key is dealt whole: rows of equal ids and texts are spread by their number. Equal texts are one
node in the near-duplicate search, and its buckets hold numbers and digits, not texts. The walk
takes many texts at a time in numpy.

**Edge cases.** Null and empty texts have the fingerprint ``00`` and likeness 1 to each other, 0
to any other text. The successor is by id, descending; null ids come last, equal ids are put in the
order of their texts' digests. A single row is its own successor. Repeated rows are each
returned. An empty table gives no rows. Extra columns are ignored. Bytes that are no UTF-8 count
as U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compframe.llm.common import binary, by_slice, importable, mix
from compframe.operators.duplicates import connected
from compframe.session import staged

SECTION_SCALE = 14
SECTION = 1 << SECTION_SCALE
SAMPLES = 256
#: Finest and coarsest scale; longer texts have longer fingerprints.
FINEST, COARSEST = 5, 20
#: Characters walked at once.
BLOCK = 1 << 22
#: Steps after which finished walks are put aside.
PAUSE = 256
BANDS = 32
ROWS = 4
LEADERS = 3
EDITS = 0.03
#: Likeness under which a pair is not worth an exact comparison: unrelated texts of one language reach 0.3.
ALIKE = 0.25

_STEPS = 3 * SECTION
STEP_CODE = mix(np.arange(1, _STEPS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP_RANK = mix(np.arange(1, _STEPS + 1, dtype=np.uint64) ^ np.uint64(0x5DEECE66D2B7A131)) / 2.0 ** 64
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
VALUE = np.zeros(256, np.uint8)
VALUE[HEX] = np.arange(16)


def scale_of(n: int) -> int:
    """The smallest k with n <= 2^k, within the bounds."""
    return min(max((n - 1).bit_length() if n else FINEST, FINEST), COARSEST)


@cache
def steps(k: int) -> np.ndarray:
    """Sampled steps of a section at scale k, ascending."""
    length = 1 << min(k, SECTION_SCALE)
    reach = 3 * length if k < 10 else 9 * length // 4  # a walk of n characters takes 2n steps, give or take sqrt(2n)
    return np.flatnonzero(STEP_RANK[:reach] < SAMPLES / 2.0 / (1 << k))


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _walk(lanes: list[np.ndarray], k: int) -> np.ndarray:
    """Digits of every lane at the steps of scale k."""
    sizes = np.array([len(x) for x in lanes])
    begin = np.cumsum(sizes + 1) - sizes - 1
    value = np.zeros(int(sizes.sum()) + len(lanes), np.uint64)  # a zero behind every lane holds its walker
    solid = np.ones(len(value), bool)
    solid[begin + sizes] = False
    value[solid] = mix(np.concatenate(lanes).astype(np.uint64) + np.uint64(0x1F3D5B79)) | np.uint64(1)
    at = steps(k)
    notes = np.zeros((len(lanes), len(at)), np.uint64)
    place, who, done = begin.copy(), np.arange(len(lanes)), 0
    shift = np.uint64(63)
    for step in range(int(at[-1]) + 1 if len(at) else 0):
        under = value[place]
        if at[done] == step:
            notes[who, done] = under
            done += 1
        place += ((under * STEP_CODE[step]) >> shift).astype(np.int64)
        if step % PAUSE == PAUSE - 1:
            going = value[place] != 0
            if not going.all():
                place, who = place[going], who[going]
                if not len(who):
                    break
    return np.where(notes == 0, 0, 1 + (notes >> np.uint64(40)) % np.uint64(15)).astype(np.uint8)


def fingerprints(texts: list[np.ndarray]) -> list[str]:
    """Fingerprints of texts, given as code points."""
    scales = [scale_of(len(t)) for t in texts]
    digits: list[list[np.ndarray]] = [[] for _ in texts]
    for k in sorted(set(scales)):
        lanes: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def flush(k=k):
            nonlocal lanes, owner, held
            if lanes:
                for i, row in zip(owner, _walk(lanes, k), strict=True):
                    digits[i].append(row)
            lanes, owner, held = [], [], 0

        for i in [i for i, s in enumerate(scales) if s == k and len(texts[i])]:
            for a in range(0, len(texts[i]), SECTION):
                lanes.append(texts[i][a:a + SECTION])
                owner.append(i)
                held += len(lanes[-1])
                if held >= BLOCK:
                    flush()
        flush()
    out = []
    for t, k, rows in zip(texts, scales, digits, strict=True):
        body = HEX[np.concatenate(rows)].tobytes().decode().rstrip("0") if rows else ""
        out.append(f"{k:02x}{body}" if len(t) else "00")
    return out


@cache
def _kept(fine: int, coarse: int) -> np.ndarray:
    """Which steps of a section at the finer scale are steps of the coarser one."""
    return STEP_RANK[steps(fine)] < SAMPLES / 2.0 / (1 << coarse)


def restricted(print_: str, coarse: int) -> np.ndarray:
    """Digits of a fingerprint at the steps of a coarser scale or its own, section by section."""
    k = int(print_[:2], 16)
    digits = VALUE[np.frombuffer(print_[2:].encode(), np.uint8)]
    if k == coarse or not len(digits):
        return digits
    keep = _kept(k, coarse)
    if k <= SECTION_SCALE:
        return digits[keep[:len(digits)]]
    return digits[np.resize(keep, len(digits))]


def likeness(a: str, b: str) -> float:
    """Share of equal digits where either text still has characters; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if len(a) == 2 or len(b) == 2:
        return 0.0
    coarse = max(int(a[:2], 16), int(b[:2], 16))
    x, y = restricted(a, coarse), restricted(b, coarse)
    if len(x) > len(y):
        x, y = y, x
    head = y[:len(x)]
    live = int(np.count_nonzero(x | head)) + int(np.count_nonzero(y[len(x):]))
    return float(np.count_nonzero((x == head) & (x != 0))) / live if live else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters of the following text, or all it has."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def distance(a: str, b: str) -> int:
    """Edit distance, bit-parallel: a column of the table is two numbers of len(a) bits."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, out = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | (full & ~(d0 | up)), up & d0
        out += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | 1) & full
        up = ((hn << 1) | (full & ~(d0 | hp))) & full
        down = hp & d0
    return out


PARTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
         "near_next double, part int, head string, tail string")


def _compared(ids: list, texts: list[str], after: str, part: int) -> pa.RecordBatch:
    """Result rows of texts in order, each compared with the one behind it; ``after`` is behind the last."""
    behind = [*texts[1:], after]
    new = [edited(t, f) for t, f in zip(texts, behind, strict=True)]
    every = [*texts, after]
    prints = fingerprints([codes(t) for t in [*every, *new]])
    own, changed = prints[:len(every)], prints[len(every):]
    n = len(texts)
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]), pa.array(own[:n]), pa.array(changed),
         pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
         pa.array([likeness(own[i], own[i + 1]) for i in range(n)], pa.float64()),
         pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "head", "tail"])


def _decoded(column: pa.Array) -> list[str]:
    return [t.as_py().decode("utf-8", "replace") for t in binary(column)]


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of ids: all but the last are compared; the first and the last text go on as ``head`` and ``tail``."""
    part = TaskContext.get().partitionId()
    last: tuple | None = None
    names = [c.split()[0] for c in PARTS.split(", ")]

    def edge(id, head, tail):
        row = {c: None for c in names} | {"doc_id": id, "part": part, "head": head, "tail": tail}
        return pa.RecordBatch.from_pylist([row], pa.schema([
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()),
            ("head", pa.string()), ("tail", pa.string())]))

    for whole in batches:
        for b in by_slice(whole, 1):
            ids, texts = b.column(0).to_pylist(), _decoded(b.column(1))
            if last is None:
                yield edge(ids[0], texts[0], None)
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            if len(texts) > 1:
                yield _compared(ids[:-1], texts[:-1], texts[-1], part)
    if last is not None:
        yield edge(last[0], None, last[1])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            yield _compared([b.column(0)[i].as_py()], [b.column(1)[i].as_py()], b.column(2)[i].as_py(), 0)


def successors(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of ``docs``: fingerprints of its text and of its edited text, and their likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    importable(docs.sparkSession)
    order = [F.col("doc_id").desc_nulls_last(), F.col("digest"), F.col("row")]
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    parts = staged(ranged.mapInArrow(_in_range, PARTS), "walks")
    # one row a range: which range follows it, the last one being followed by the first
    numbers = parts.where("head IS NOT NULL").select("part")
    line = Window.orderBy("part")
    following = numbers.select("part", F.lead("part").over(line).alias("later"), F.first("part").over(line).alias("least"))
    following = following.select("part", F.coalesce("later", "least").alias("next"))
    heads = parts.where("head IS NOT NULL").select(F.col("part").alias("next"), "head")
    tails = parts.where("tail IS NOT NULL").select("part", "doc_id", "tail")
    meeting = tails.join(following, "part").join(heads, "next").select("doc_id", "tail", "head")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    edges = meeting.mapInArrow(_at_edges, PARTS).select(*columns)
    return parts.where("fingerprint IS NOT NULL").select(*columns).unionByName(edges)


@cache
def bands(k: int, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Positions, among the first section's sampled steps of scale k, of every band: inside every text that enters it."""
    inside = np.flatnonzero(steps(k) < 3 * (1 << min(k, SECTION_SCALE)) // 4)
    random = np.random.default_rng(k)
    return np.array([np.sort(random.choice(inside, rows, replace=len(inside) < rows)) for _ in range(count)])


def _keys(count: int, rows: int):
    """(node, fingerprint, band keys) of nodes: bands of the text's own scale, and of the next one if the text fills them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for print_, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                k = int(print_[:2], 16)
                found = []
                for s in ([k, k + 1] if FINEST <= k < SECTION_SCALE and n >= 0.8 * (1 << k) else [k]) if len(print_) > 2 else []:
                    digits = restricted(print_, s)
                    digits = np.concatenate((digits, np.zeros(max(len(steps(s)) - len(digits), 0), np.uint8)))
                    found += [f"{s:02x}{j:02x}" + HEX[digits[at]].tobytes().decode() for j, at in enumerate(bands(s, count, rows))]
                keys.append(found)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.string()))], ["node", "fingerprint", "keys"])

    return run


def _verify(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, x, y = (b.column(i).to_pylist() for i in range(4))
            ok = [distance(s, t) <= limit * max(len(s), len(t)) for s, t in zip(x, y, strict=True)]
            yield pa.record_batch([pa.array([a for a, o in zip(u, ok, strict=True) if o], pa.int64()),
                                   pa.array([a for a, o in zip(v, ok, strict=True) if o], pa.int64())], ["u", "v"])

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [likeness(x, y) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: float = EDITS, count: int = BANDS,
                    rows: int = ROWS, least: float = ALIKE) -> DataFrame:
    """(doc_id, class_id): the class is the smallest id that verified pairs reach; rows without an id take part as copies only.

    At scale, ``rows`` should grow with the logarithm of the number of texts: about one digit for every factor of eight.
    """
    importable(docs.sparkSession)
    d = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = F.sha2("text", 256).alias("digest")
    seen = d.select("doc_id", digest)
    nodes = seen.groupBy("digest").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL")
    # the node's own row is the text of its class of copies
    texts = staged(d.select("doc_id", digest, "text").join(nodes.withColumnRenamed("node", "doc_id"), ["doc_id", "digest"], "left_semi")
                   .groupBy("doc_id", "digest").agg(F.first("text").alias("text")), "node-texts")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_slice(whole, 1):
                found = [codes(t) for t in _decoded(b.column(1))]
                yield pa.record_batch([b.column(0), pa.array(fingerprints(found)), pa.array([len(t) for t in found], pa.int64())],
                                      ["node", "fingerprint", "n"])

    # a text stands under its digest; two nodes may share an id, so nodes are numbered by the digest's first 63 bits
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    walked = texts.select(number.alias("node"), "text").mapInArrow(prints, "node long, fingerprint string, n long")
    entered = staged(walked.mapInArrow(_keys(count, rows), "node long, fingerprint string, keys array<string>"), "bands").select(
        "node", "fingerprint", F.explode("keys").alias("key"))
    # leaders of a bucket by partial aggregation: no task holds a whole bucket
    order = [F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), "fingerprint", "node")).alias(f"l{j}") for j in range(LEADERS)]
    led = entered.groupBy("key").agg(*order).select("key", F.explode(F.array(*[f"l{j}" for j in range(LEADERS)])).alias("l"))
    stars = entered.join(led, "key").select(F.col("l.node").alias("u"), F.col("node").alias("v"), F.col("l.fingerprint").alias("x"),
                                            F.col("fingerprint").alias("y"))
    pairs = stars.where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(F.col("u") < F.col("v"), F.col("x")).otherwise(F.col("y")).alias("x"),
        F.when(F.col("u") < F.col("v"), F.col("y")).otherwise(F.col("x")).alias("y")).dropDuplicates(["u", "v"])
    close = pairs.mapInArrow(_alike(least), "u long, v long")
    known = texts.select(number.alias("node"), "text")
    full = close.join(known.toDF("u", "x"), "u").join(known.toDF("v", "y"), "v").select("u", "v", "x", "y")
    groups = connected(staged(full.mapInArrow(_verify(edits), "u long, v long"), "verified"))
    labelled = texts.select(number.alias("node"), "doc_id", "digest").join(groups, "node", "left").select(
        "doc_id", "digest", F.coalesce("cluster", "node").alias("group"))
    least_id = labelled.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    classes = labelled.join(least_id, "group").select("digest", "class_id")
    return seen.join(classes, "digest", "left").select("doc_id", "class_id")
