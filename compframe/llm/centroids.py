"""Centroid clustering in whole numbers, by an incremental distance matrix.

Every vector keeps its exact dot products with all centroids. A squared distance is
|v|^2 - 2 v.c + |c|^2, so a round needs no new products where a centroid did not move: when
centroid c changes by d, only the components where d is not zero are multiplied, and v.c grows
by their sum. Then the argmin over the row of distances is taken anew.

**Scale.** The matrix (vector, dot products, cluster) is a staged table, one row a vector; a
round reads it, applies the changes of the centroids and writes the next one, and nothing else
is as large. New centroids come from sums per cluster: each task adds its vectors up, one row a
cluster goes on. The driver holds the centroids alone, ``k`` x ``width`` numbers. A cluster may
hold any share of the vectors: its members are never brought together.

**Exactness.** Numbers of any size are right. While the largest possible product sum fits 64
bits a block is worked on as integers of numpy, else as Python's. A distance or an inertia that
does not fit a long is null in the result; it still decides like any other number.

**Edge cases.** A vector that is null, has another width, or has a null, infinite or NaN
component is left out. Repeated ids are vectors of their own; a null id counts as the empty
text where ids are hashed. Equal hashes are put in the order of the vectors. Fewer vectors than
``k``: as many centroids as vectors. An empty table gives no rows. A centroid without vectors
stays where it is. Equal distances: the smaller number. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.llm.common import importable
from compframe.session import staged, unstage

K = 16
WIDTH = 64
ROUNDS = 3
SCALE = 64
#: Magnitude from which a block's numbers are Python's instead of 64 bits wide.
WIDE = 1 << 62
LONG = pa.int64()

MATRIX = "vec_id long, vector binary, dots binary, cluster int, distance string"


def pack(row) -> bytes:
    """Whole numbers as bytes: the narrowest of four widths that holds them all, or decimals joined by commas."""
    top = max((abs(int(x)) for x in row), default=0)
    for mark, kind, bound in ((b"1", "<i1", 7), (b"2", "<i2", 15), (b"4", "<i4", 31), (b"8", "<i8", 63)):
        if top < 1 << bound:
            return mark + np.array(row, dtype=kind).tobytes()
    return b"d" + ",".join(str(int(x)) for x in row).encode()


def pack_all(rows: np.ndarray) -> list[bytes]:
    """``pack`` of every row; one width serves all rows of a block of numpy integers."""
    if rows.dtype == object or not rows.size:
        return [pack(r) for r in rows]
    top = max(-int(rows.min()), int(rows.max()))
    mark, kind = next((m, t) for m, t, bound in ((b"1", "<i1", 7), (b"2", "<i2", 15), (b"4", "<i4", 31), (b"8", "<i8", 64)) if top < 1 << bound)
    data, step = rows.astype(kind).tobytes(), rows.shape[1] * int(mark)
    return [mark + data[i:i + step] for i in range(0, len(data), step)]


def unpack(value: bytes) -> list[int]:
    """The numbers of ``pack``."""
    if value[:1] == b"d":
        return [int(x) for x in value[1:].split(b",")]
    return np.frombuffer(value, f"<i{value[:1].decode()}", offset=1).tolist()


def unpack_all(values: list[bytes], width: int) -> np.ndarray:
    """A matrix of packed rows: 64-bit integers, or Python's where a row needs them."""
    if not values:
        return np.zeros((0, width), np.int64)
    marks = {v[:1] for v in values}
    if len(marks) == 1 and marks != {b"d"}:
        mark = marks.pop()
        body = b"".join(v[1:] for v in values)
        return np.frombuffer(body, f"<i{mark.decode()}").reshape(len(values), width).astype(np.int64)
    rows = [unpack(v) for v in values]
    return np.array(rows, dtype=object if b"d" in marks else np.int64).reshape(len(values), width)


def exact(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, as 64-bit integers or Python's."""
    scaled = np.floor(values * float(scale)) if scale & (scale - 1) == 0 and np.abs(values).max(initial=0.0) < 2.0 ** 900 else None
    if scaled is not None and np.abs(scaled).max(initial=0.0) < 2.0 ** 53:
        return scaled.astype(np.int64)
    whole = [[(n * scale) // d for n, d in (float(x).as_integer_ratio() for x in row)] for row in values]
    return np.array(whole, dtype=object).reshape(values.shape)


def fitting(width: int, *parts: np.ndarray) -> list[np.ndarray]:
    """The parts as they are if a sum of ``width`` products of theirs fits 64 bits, else as Python's integers."""
    if any(p.dtype == object for p in parts):
        return [p.astype(object) for p in parts]
    tops = sorted(max(-int(p.min()), int(p.max())) if p.size else 0 for p in parts)
    return list(parts) if 8 * width * (tops[-1] + 1) ** 2 < WIDE else [p.astype(object) for p in parts]


def vectors(table: DataFrame, id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the usable vectors as packed whole numbers."""
    v = F.col(vector)
    usable = (v.isNotNull() & (F.size(v) == width)
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            yield pa.record_batch([b.column(0), pa.array(pack_all(exact(flat, scale)), pa.binary())], ["vec_id", "vector"])

    importable(table.sparkSession)
    kept = table.where(F.coalesce(usable, F.lit(False)))
    return kept.select(F.col(id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, vector binary")


def first_centroids(rows: DataFrame, k: int, seed: str = "1") -> list[list[int]]:
    """The vectors whose ids have the smallest hashes; the only rows that come to the driver, ``k`` of them."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(hashed.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return [unpack(bytes(r.vector)) for r in first]


def moved(old: list[list[int]], new: list[list[int]]) -> list[tuple[int, list[int], list[int]]]:
    """(centroid, components that changed, by how much) of every centroid that moved."""
    out = []
    for c, (a, b) in enumerate(zip(old, new, strict=True)):
        at = [j for j, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
        if at:
            out.append((c, at, [b[j] - a[j] for j in at]))
    return out


def advance(v: np.ndarray, dots: np.ndarray, changes: list[tuple[int, list[int], list[int]]]) -> np.ndarray:
    """Dot products after the centroids' changes; columns of unmoved centroids are untouched."""
    dots = dots.copy()
    for c, at, by in changes:
        try:
            step = np.array(by, np.int64)
        except OverflowError:
            step = np.array(by, object)
        part, step = fitting(len(at), v[:, at], step)
        grown = part @ step
        if dots.dtype != object and (grown.dtype == object or max(np.abs(grown).max(initial=0), np.abs(dots[:, c]).max(initial=0)) >= WIDE):
            dots = dots.astype(object)
        dots[:, c] = dots[:, c] + grown
    return dots


def nearest(v: np.ndarray, dots: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every vector, by its dot products."""
    norms = [sum(x * x for x in c) for c in centroids]
    v = fitting(v.shape[1], v)[0]
    own = (v * v).sum(axis=1)
    wide = (v.dtype == object or dots.dtype == object or max(norms) >= WIDE >> 2
            or (len(own) and max(int(own.max()), int(np.abs(dots).max())) >= WIDE >> 3))
    if wide:
        own, dots = own.astype(object), dots.astype(object)
        far = own[:, None] - 2 * dots + np.array(norms, dtype=object)[None, :]
        best = np.array([min(range(len(r)), key=r.__getitem__) for r in far.tolist()], np.int64)
    else:
        far = own[:, None] - 2 * dots + np.array(norms, np.int64)[None, :]
        best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def _step(changes, centroids, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = unpack_all(b.column(1).to_pylist(), width)
            dots = unpack_all(b.column(2).to_pylist(), k) if b.num_columns > 2 else np.zeros((len(v), k), np.int64)
            dots = advance(v, dots, changes)
            best, far = nearest(v, dots, centroids)
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(pack_all(dots), pa.binary()), pa.array(best, pa.int32()),
                 pa.array([str(x) for x in far.tolist()], pa.string())], ["vec_id", "vector", "dots", "cluster", "distance"])

    return run


def _add_up(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums per cluster of (cluster, count or null for one vector, numbers), one row a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            v = unpack_all(b.column(2).to_pylist(), width)
            counts = b.column(1).to_numpy(zero_copy_only=False)
            label = b.column(0).to_numpy(zero_copy_only=False)
            small = v.dtype != object and (not v.size or max(-int(v.min()), int(v.max())) < WIDE // (len(v) + 1))
            for c in np.unique(label).tolist():
                part = v[label == c]
                total = part.sum(axis=0).tolist() if small else [sum(col) for col in part.astype(object).T.tolist()]
                n, held = sums.get(c, (0, [0] * width))
                sums[c] = (n + int(counts[label == c].sum()), [x + int(y) for x, y in zip(held, total, strict=True)])
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], LONG),
                                   pa.array([pack(s) for _, s in sums.values()], pa.binary())], ["cluster", "n", "total"])

    return run


def centres(matrix: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of every cluster's vectors; a cluster without vectors keeps its centroid."""
    width = len(centroids[0])
    schema = "cluster int, n long, total binary"
    partial = matrix.select("cluster", F.lit(1).cast("long").alias("n"), "vector").mapInArrow(_add_up(width), schema)
    # a few rows a task, dealt by cluster, and one row a cluster after that
    whole = partial.repartition(len(centroids), "cluster").mapInArrow(_add_up(width), schema)
    out = [list(c) for c in centroids]
    for r in whole.collect():
        out[r.cluster] = [x // r.n for x in unpack(bytes(r.total))]
    return out


def clusters(table: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
             width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """The last matrix (vec_id, vector, dots, cluster, distance as decimal text) and the centroids it belongs to."""
    rows = staged(vectors(table, id, vector, width, scale), "vectors")
    centroids = first_centroids(rows, k)
    if not centroids:
        return staged(rows.selectExpr("vec_id", "vector", "vector AS dots", "CAST(NULL AS INT) AS cluster", "'' AS distance"), "distances"), []
    changes = moved([[0] * width] * len(centroids), centroids)
    matrix = staged(rows.mapInArrow(_step(changes, centroids, width), MATRIX), "distances")
    unstage(rows)
    for _ in range(rounds):
        following = centres(matrix, centroids)
        changes = moved(centroids, following)
        if not changes:
            break
        centroids = following
        further = staged(matrix.select("vec_id", "vector", "dots").mapInArrow(_step(changes, centroids, width), MATRIX), "distances")
        unstage(matrix)
        matrix = further
    return matrix, centroids


def report(table: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    spark = table.sparkSession
    matrix, centroids = clusters(table, id, vector, k, rounds)
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")

    def inertia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for b in batches:
            for c, far in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + int(far)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([str(x) for x in sums.values()])], ["cluster", "distance"])

    parts = matrix.select("cluster", "distance").mapInArrow(inertia, "cluster int, distance string")
    sums = [(r.cluster, int(r.distance)) for r in parts.repartition(max(len(centroids), 1), "cluster").mapInArrow(inertia, "cluster int, distance string").collect()]
    total = sum(x for _, x in sums)
    per = spark.createDataFrame([(c, str(x), str(total)) for c, x in sums], "cluster int, cluster_inertia string, inertia string")
    # both sides hold one row a centroid, k at most
    return matrix.select("vec_id", "cluster", "distance").join(F.broadcast(per), "cluster").join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", *[F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in ("distance", "cluster_inertia", "inertia")], "centroid_sha256")
