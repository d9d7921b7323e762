"""Burst filter: at most n admitted events per key in any window; rejected ones do not count.

Admission depends on what was admitted before, so no window frame expresses it. The
sequential part is kept small: of events of one key at one instant only the first n can be
admitted, and a gap as long as the window clears the memory, so a key is cut into
independent runs. Tasks then read sorted runs as a stream of Arrow batches and jump from
one admitted event to the next, holding n timestamps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from compframe.config import RATE_LIMIT_MAX, RATE_LIMIT_WINDOW_S
from compframe.operators.ranking import top_per_group


def admit(times: np.ndarray, recent: list[int], limit: int, window: int) -> tuple[list[int], list[int]]:
    """Positions of admitted events among sorted ``times``, and the memory afterwards.

    ``recent`` holds the last admitted times. An event is admitted unless ``limit``
    admitted ones lie less than ``window`` before it.
    """
    taken, i = [], 0
    while i < len(times):
        if len(recent) >= limit:
            i = max(i, int(np.searchsorted(times, recent[-limit] + window, side="left")))
            if i >= len(times):
                break
        taken.append(i)
        recent = (recent + [int(times[i])])[-limit:]
        i += 1
    return taken, recent


def _runs(events: DataFrame, window_s: int) -> DataFrame:
    """(key, slot, run): which independent run every time slot of a key belongs to.

    Works on one row per key and slot, so the length of a key's history is bounded by time,
    not by its events.
    """
    slots = events.groupBy("key", "slot").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    order = Window.partitionBy("key").orderBy("slot")
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(order) >= window_s * 1000000, F.lit(True))
    return slots.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(order)).select(
        "key", "slot", "run")


def burst_filter(events: DataFrame, limit: int = RATE_LIMIT_MAX, window_s: int = RATE_LIMIT_WINDOW_S) -> DataFrame:
    """Admitted events. ``events`` needs key, ts and a unique id; earlier id first at equal times."""
    window = window_s * 1000000
    timed = events.select("key", "ts", "id", F.unix_micros("ts").alias("us")).withColumn(
        "slot", F.floor(F.col("us") / window))
    few = top_per_group(timed, ["key", "ts"], [F.col("id").asc()], limit)
    cut = few.join(_runs(few, window_s), ["key", "slot"]).select("key", "run", "us", "id", "ts")
    ordered = cut.repartition("key", "run").sortWithinPartitions("key", "run", "us", "id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, []
        for batch in batches:
            keys, runs, times = batch["key"].to_numpy(), batch["run"].to_numpy(), batch["us"].to_numpy()
            if not len(times):
                continue
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])) + 1
            taken = []
            for lo, hi in zip([0, *change], [*change, len(times)]):
                name = (keys[lo], runs[lo])
                if name != current:
                    current, recent = name, []
                part, recent = admit(times[lo:hi], recent, limit, window)
                taken.extend(lo + i for i in part)
            yield batch.iloc[taken][["key", "id", "ts"]]

    schema = ordered.select("key", "id", "ts").schema
    return ordered.mapInPandas(walk, schema)
