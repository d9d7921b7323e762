"""Counts and order statistics of many intervals by running sums.

Cells (place, position, value, n) and the bounds of windows are sorted together by place and position.
One pass over them keeps, for every class of values, the rows so far; a window is the difference of
what stood at its two bounds. The class that holds a wanted rank is cut into classes anew, until
the rows of the classes left are few enough to be looked at one by one.

Work is a fixed number of passes over cells and bounds, whatever the windows overlap. Cells of one class and position are
added up before they are sorted. The pass runs on
ranges of the sort order, so a place with most of the rows fills as many tasks as it needs; what
earlier ranges held is added from one row a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from compframe.session import staged

#: Classes a class is cut into.
FAN = 100
#: Pairs of windows and cells of one class, for each cell and window there, up to which the last step compares them.
PAIRS = 16
#: Cuts after which values that are still together differ by nothing a double shows.
DEEPEST = 9
END = float("nan")  # sorts behind every position; cells without a position stand there

PASS_DDL = "tid long, rank long, sign int, part int, counts binary"


def _digits(value: Column, width: float, classes: int, level: int) -> tuple[Column, Column]:
    """(node, digit) of a value: which class holds it after ``level`` - 1 cuts, and its place in the next cut."""
    node, rest = F.lit(0).cast("bigint"), value
    for depth in range(1, level + 1):
        top = classes if depth == 1 else FAN
        digit = F.least(F.greatest(F.floor(rest / F.lit(width)), F.lit(0)), F.lit(top - 1))
        if depth == level:
            return node, digit.cast("int")
        node, rest, width = node * F.lit(FAN) + digit, rest - digit * F.lit(width), width / FAN
    raise ValueError("levels count from 1")


def _node(value: Column, width: float, classes: int, level: int) -> Column:
    """The class that holds a value after ``level`` cuts."""
    node, digit = _digits(value, width, classes, level)
    return node * F.lit(FAN) + digit


def _look_up(classes: int):
    """Running counts at every bound, and one row with the range's own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = np.zeros(classes, np.int64)

        def out(tid, rank, sign, counts):
            flat = np.ascontiguousarray(counts, "<i8")
            rows = [flat[i].tobytes() for i in range(len(flat))]
            return pa.record_batch([tid, rank, sign, pa.array([part] * len(rows), pa.int32()), pa.array(rows, pa.binary())],
                                   ["tid", "rank", "sign", "part", "counts"])

        for b in batches:
            asked = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            seg = np.cumsum(asked)
            here = np.zeros((int(asked.sum()) + 1, classes), np.int64)
            digit = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)[~asked]
            n = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)[~asked]
            np.add.at(here, (seg[~asked], digit), n)
            here = np.cumsum(here, axis=0) + base
            base = here[-1]
            if len(here) > 1:
                mask = pa.array(asked)
                yield out(b.column(2).filter(mask), b.column(3).filter(mask), b.column(4).filter(mask), here[:-1])
        yield out(pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int32()), base[None, :])

    return run


def _earlier(classes: int):
    """Sums of all ranges before each; input: (part, counts) in order of part, one row a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros(classes, np.int64)
        for b in batches:
            rows = []
            for c in b.column(1).to_pylist():
                rows.append(base.tobytes())
                base = base + np.frombuffer(c, "<i8")
            yield pa.record_batch([b.column(0), pa.array(rows, pa.binary())], ["part", "before"])

    return run


CHOICE_DDL = "tid long, n long, digit int, rank long, low int, high int, high_rank long"


def _choose(classes: int):
    """Sums the look-ups of a window and finds the class of its rank (null: the upper median), its lowest and its highest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int | None, np.ndarray] | None = None

        def rows(tids, ranks, sums):
            upto = np.cumsum(sums, axis=1)
            n = upto[:, -1]
            some = n > 0
            tids, ranks, sums, upto, n = tids[some], ranks[some], sums[some], upto[some], n[some]
            want = np.where(ranks < 0, n // 2, ranks)
            digit = (upto <= want[:, None]).sum(axis=1)
            before = np.where(digit > 0, upto[np.arange(len(n)), np.maximum(digit - 1, 0)], 0)
            low = (sums > 0).argmax(axis=1)
            high = classes - 1 - (sums[:, ::-1] > 0).argmax(axis=1)
            return pa.record_batch(
                [pa.array(tids), pa.array(n), pa.array(digit, pa.int32()), pa.array(want - before), pa.array(low, pa.int32()),
                 pa.array(high, pa.int32()), pa.array(sums[np.arange(len(n)), high] - 1)],
                ["tid", "n", "digit", "rank", "low", "high", "high_rank"])

        for b in batches:
            if not b.num_rows:
                continue
            tid = b.column(0).to_numpy(zero_copy_only=False)
            rank = b.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            sign = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i8").reshape(-1, classes)
            before = np.frombuffer(b"".join(b.column(4).to_pylist()), "<i8").reshape(-1, classes)
            starts = np.flatnonzero(np.r_[True, tid[1:] != tid[:-1]])
            sums = np.add.reduceat((counts + before) * sign[:, None], starts, axis=0)
            tids, ranks = tid[starts], rank[starts]
            if held is not None:
                if held[0] == tids[0]:
                    sums[0] += held[2]
                else:
                    yield rows(np.array([held[0]]), np.array([held[1]]), held[2][None, :])
            held = int(tids[-1]), int(ranks[-1]), sums[-1].copy()
            yield rows(tids[:-1], ranks[:-1], sums[:-1])
        if held is not None:
            yield rows(np.array([held[0]]), np.array([held[1]]), held[2][None, :])

    return run


def _pass(rows: DataFrame, probes: DataFrame, place: list[str], classes: int) -> DataFrame:
    """One sorted pass; ``rows``: place, position, digit, n; ``probes``: tid, rank, place, lo, hi.

    Of a cell only its position and class count here, so cells alike in both are added up before anything is sorted.
    """
    rows = rows.groupBy(*place, "position", "digit").agg(F.sum("n").alias("n"))
    ends = F.explode(F.array(
        F.struct(F.col("lo").alias("position"), F.lit(float("-inf")).alias("value"), F.lit(-1).alias("sign")),
        F.struct(F.col("hi").alias("position"), F.lit(float("inf")).alias("value"), F.lit(1).alias("sign"))))
    asked = probes.select("tid", "rank", *place, ends.alias("e")).select(
        *place, "e.*", "tid", "rank", F.lit(None).cast("int").alias("digit"), F.lit(None).cast("bigint").alias("n"))
    none = F.lit(None)
    every = rows.select(*place, "position", F.lit(0.0).alias("value"), none.cast("int").alias("sign"), none.cast("bigint").alias("tid"), none.cast("bigint").alias("rank"),
                        "digit", "n").unionByName(asked)
    order = [*place, "position", "value"]
    ranged = every.repartitionByRange(*order).sortWithinPartitions(*order).select("digit", "n", "tid", "rank", "sign")
    seen = staged(ranged.mapInArrow(_look_up(classes), PASS_DDL), "running-counts")
    # one row a range, so one task can add them up
    offsets = seen.where("tid IS NULL").select("part", "counts").coalesce(1).sortWithinPartitions("part").mapInArrow(
        _earlier(classes), "part int, before binary")
    placed = seen.where("tid IS NOT NULL").join(offsets, "part").select("tid", "rank", "sign", "counts", "before")
    return placed.repartition("tid").sortWithinPartitions("tid").mapInArrow(_choose(classes), CHOICE_DDL)


def first_cut(cells: DataFrame, windows: DataFrame, place: list[str], width: float, classes: int) -> DataFrame:
    """Rows of every window and the classes of its upper median, lowest and highest value.

    ``cells`` have the place, position (null: behind all others), value and n; ``windows`` have tid, the place, lo and hi
    (``END`` takes in everything), one row for each place. Windows without rows are left out.
    """
    node, digit = _digits(F.col("value"), width, classes, 1)
    rows = cells.select(*place, F.coalesce("position", F.lit(END)).alias("position"), digit.alias("digit"), "n")
    return _pass(rows, windows.withColumn("rank", F.lit(None).cast("bigint")), place, classes)


def _few(targets: DataFrame, rows: DataFrame, keys: list[str]) -> bool:
    """Whether a join of targets and cells of the same class makes at most ``PAIRS`` rows for each of them."""
    both = targets.groupBy(*keys).agg(F.count("*").alias("t")).join(rows.groupBy(*keys).agg(F.count("*").alias("r")), keys)
    pairs, amount = both.agg(F.sum(F.col("t") * F.col("r")), F.sum(F.col("t") + F.col("r"))).first()
    return (pairs or 0) <= PAIRS * (amount or 0)


def values_at(cells: DataFrame, targets: DataFrame, place: list[str], width: float, classes: int) -> DataFrame:
    """(tid, value): the value of every target's rank.

    ``targets`` have tid, the place, lo, hi, digit (the class of the first cut) and rank inside it, one row for each place.
    """
    keys = [*place, "node"]
    targets = targets.withColumnRenamed("digit", "node").withColumn("node", F.col("node").cast("bigint"))
    level = 1
    while True:
        rows = cells.select(*place, F.coalesce("position", F.lit(END)).alias("position"), "value", "n",
                            _node(F.col("value"), width, classes, level).alias("node"))
        if level == DEEPEST or _few(targets, rows, keys):
            break
        level += 1
        touched = targets.select(*keys).distinct()
        _, digit = _digits(F.col("value"), width, classes, level)
        cut = _pass(rows.join(touched, keys, "left_semi").withColumn("digit", digit), targets, keys, FAN)
        targets = staged(targets.drop("rank").join(cut.select("tid", "digit", "rank"), "tid").withColumn(
            "node", F.col("node") * F.lit(FAN) + F.col("digit")).drop("digit"), "running-targets")
    inside = targets.join(rows, keys).where((F.col("position") >= F.col("lo")) & (F.col("position") <= F.col("hi")))
    counted = inside.groupBy("tid", "value").agg(F.sum("n").alias("n"), F.first("rank").alias("rank"))
    run = F.sum("n").over(Window.partitionBy("tid").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("upto", run).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))).select("tid", "value")
