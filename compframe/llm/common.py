"""Words, hashes and row plumbing that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A slice of texts handled at once, in bytes; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20_240_607)
BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its path may be one that only Spark can open."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers started by this session import the package from where the driver has it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def binary(column: pa.Array) -> pa.Array:
    """Text as bytes, null as empty."""
    return pc.fill_null(column, "").cast(pa.large_binary())


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes together, or of one row."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def by_slice(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices by the bytes of its text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes.astype(np.int64), limit):
        yield batch.slice(a, b - a)


class Words(NamedTuple):
    """Words of some texts: byte ranges in ``data``, a 64-bit hash each, and the first word of every text (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def words(column: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null has none.

    Bytes are enough: no byte of a longer UTF-8 character is a separator. The hash is a
    polynomial over random byte codes, mixed with the length.
    """
    column = binary(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), offsets)
    solid = ~IS_SPACE[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    filled = np.flatnonzero(np.diff(offsets))
    at, last = offsets[filled], offsets[filled + 1] - 1
    begins[at], stops[last] = solid[at], solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    lens = end - start
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(data, start, end, np.zeros(0, np.uint64), first, offsets)
    begin = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(begin, lens)
    powers = np.cumprod(np.full(int(lens.max()), BASE, np.uint64))
    codes = (BYTE_CODE[LOWER] if lower else BYTE_CODE)[data[solid]] * powers[place]
    return Words(data, start, end, mix(np.add.reduceat(codes, begin) + lens.astype(np.uint64)), first, offsets)


def window_hashes(h: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every k consecutive values of ``h``, whatever text they are in."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= base
        out += h[j:j + n]
    return mix(out)


def inside(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the n - k + 1 window starts have all their k words in one text."""
    ok = np.ones(max(n_words - k + 1, 0), bool)
    for cut in first[1:-1]:
        ok[max(cut - k + 1, 0):cut] = False
    return ok


def least_hashed(rows: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """``rows`` whose ids have the ``n`` smallest hashes, wholly equal rows once.

    Numbers are ranked first, ``n`` of them a task; texts are looked up afterwards, so that no task gets those of others.
    """
    keys = rows.select(F.xxhash64(id).alias("_h"), F.col(id).alias("_id"), F.xxhash64(text).alias("_tag")).orderBy("_h", "_id", "_tag").limit(n)
    same = rows[id].eqNullSafe(F.col("_id")) & (F.xxhash64(rows[text]) == F.col("_tag"))
    return rows.join(F.broadcast(keys.select("_id", "_tag").distinct()), same, "left_semi").dropDuplicates([id, text])
