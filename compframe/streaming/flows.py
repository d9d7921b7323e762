"""Streaming forms of the keyed operators. Each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from compframe.config import RATE_LIMIT_MAX, RATE_LIMIT_WINDOW_S, RETENTION_DAYS
from compframe.operators.bursts import admit
from compframe.session import remove_path


def dedupe_posts(posts: DataFrame, key: str = "id", ts: str = "ts", within: str = "30 days") -> DataFrame:
    """Each id once; the memory of an id ends with the watermark."""
    return posts.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def once_per_event(events: DataFrame, within: str = "7 days") -> DataFrame:
    """Idempotent intake of events that may be delivered again."""
    return dedupe_posts(events, "event_id", "ts", within)


def burst_stream(events: DataFrame, limit: int = RATE_LIMIT_MAX, window_s: int = RATE_LIMIT_WINDOW_S,
                 lateness: str = "10 minutes") -> DataFrame:
    """Admitted events of a stream with key, ts and id; the state of a key is ``limit`` times."""
    window = window_s * 1000000
    key_type = events.schema["key"].dataType.simpleString()
    id_type = events.schema["id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["us", "id"])
        recent = list(state.get[0]) if state.exists else []
        taken, recent = admit(rows["us"].to_numpy(), recent, limit, window)
        state.update((recent,))
        if recent:
            state.setTimeoutTimestamp(max(int(recent[-1] / 1000) + window_s * 1000,
                                          state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[taken][["key", "id", "ts"]]

    timed = events.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("key").applyInPandasWithState(
        step, f"key {key_type}, id {id_type}, ts timestamp", "recent array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)


def upsert_stream(rows: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    """Rows per key as an upsert leaves them: fields of the newest row, first and last time seen.

    The keyed rows are an aggregate in Spark's state store: a micro-batch reads and writes the keys it names, and in update
    mode only those come out. Rows of equal time are settled by their fields, smallest first; a late row can move
    ``first_seen`` back but does not replace newer fields.
    """
    fields = [c for c in rows.columns if c not in (key, ts)]
    newest_first = F.struct((-F.unix_micros(ts)).alias("_age"), *fields)
    kept = rows.groupBy(key).agg(F.min_by(F.struct(*fields), newest_first).alias("f"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return kept.select(key, "f.*", "first_seen", "last_seen", F.lit(True).alias("is_active"))


#: Rows that the state of ``snapshot_stream`` is kept in; part of the state's key, so it must not change while a checkpoint lives.
BUCKETS = 1024
HELD = {"k": "object", "data": "object", "is_expired": "bool", "scraped_at": "int64", "first_seen_at": "int64", "last_updated_at": "int64", "seen": "int64"}


def _as_text(c: str, kind: str) -> Column:
    """An atomic column as text that gives back the same value; times are microseconds, so no time zone plays a part."""
    return F.unix_micros(c).cast("string") if kind == "timestamp" else F.base64(c) if kind == "binary" else F.col(c).cast("string")


def _from_text(c: Column, kind: str) -> Column:
    return F.timestamp_micros(c.cast("bigint")) if kind == "timestamp" else F.unbase64(c) if kind == "binary" else c.cast(kind)


def merge_snapshot() -> Callable[[pd.DataFrame, pd.DataFrame, int], tuple[pd.DataFrame, np.ndarray]]:
    """The function that merges listed ids; nested, so that it travels to executors which do not have this package."""

    def merge(held: pd.DataFrame, rows: pd.DataFrame, passed: int) -> tuple[pd.DataFrame, np.ndarray]:
        """Keyed rows after the listed ones, and which of them changed.

        ``held`` has the columns of ``HELD``, ``rows`` k, us, data and detailed (live details are there). Rows of one key are taken by time.
        """
        gone = ~held["is_expired"].to_numpy() & (held["seen"].to_numpy() < passed)
        held = held.assign(is_expired=held["is_expired"] | gone, last_updated_at=np.where(gone, passed, held["last_updated_at"]))
        rows = rows.sort_values("us", kind="stable")
        turn = rows.groupby("k").cumcount().to_numpy()
        changed = gone
        for i in range(int(turn.max()) + 1 if len(turn) else 0):  # one turn, unless a key is listed twice
            part = rows[turn == i]
            at = pd.Index(held["k"]).get_indexer(part["k"])
            us, data, detailed = part["us"].to_numpy(np.int64), part["data"].to_numpy(object), part["detailed"].to_numpy(bool)
            columns = {c: held[c].to_numpy(copy=True) for c in HELD}
            known = np.flatnonzero(at >= 0)
            known = known[us[known] >= columns["seen"][at[known]]]  # not an older snapshot than the one seen last
            columns["seen"][at[known]] = us[known]
            back = known[columns["is_expired"][at[known]] & detailed[known]]
            for c, v in (("data", data[back]), ("is_expired", False), ("scraped_at", us[back]), ("last_updated_at", us[back])):
                columns[c][at[back]] = v
            changed[at[back]] = True
            new = np.flatnonzero((at < 0) & detailed)
            more = {"k": part["k"].to_numpy(object)[new], "data": data[new], "is_expired": np.zeros(len(new), bool)}
            held = pd.DataFrame({c: np.concatenate([v, more.get(c, us[new])]) for c, v in columns.items()})
            changed = np.concatenate([changed, np.ones(len(new), bool)])
        return held, changed

    return merge


def snapshot_stream(snapshots: DataFrame, fields: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Changes that a stream of full snapshots makes to a keyed table, in update mode.

    ``snapshots`` has id, run (the snapshot's time), ``fields`` and is_expired as the details of that run give them (null: no
    details could be had). A listed id that is not live is inserted or revived with live details and keeps first_seen_at. A
    live id that the next snapshot does not list expires when the watermark passes the run that saw it last. A micro-batch must be one snapshot.

    Ids are dealt out over ``buckets``; the state of a bucket is a table of its ids, with a timer for the one seen longest ago. A
    micro-batch reads and writes the buckets it lists ids of, or whose timer ends, as columns: a full snapshot touches nearly every live
    id anyway, and a call of Python for each id costs far more than copying the rows of a bucket.
    """
    types = {f.name: f.dataType.simpleString() for f in snapshots.schema.fields}
    stamps = ["scraped_at", "first_seen_at", "last_updated_at"]
    shown, merge = ["k", "data", "is_expired", *stamps], merge_snapshot()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else pd.DataFrame({c: np.empty(0, t) for c, t in HELD.items()})
        passed = state.getCurrentWatermarkMs() * 1000
        given = [] if state.hasTimedOut else list(frames)
        rows = pd.concat(given) if given else pd.DataFrame({"k": [], "us": [], "data": [], "detailed": []})
        held, changed = merge(held, rows, passed)
        if not len(held):
            return
        kept, sink = pa.RecordBatch.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_batch(kept)
        state.update((sink.getvalue().to_pybytes(),))
        live = held.loc[~held["is_expired"], "seen"]
        if len(live):
            state.setTimeoutTimestamp(max(int(live.min()), passed) // 1000 + 1)
        if changed.any():
            yield held.loc[changed, shown]

    timed = snapshots.withWatermark("run", "0 seconds").select(
        F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "run",
        F.coalesce(F.concat(F.lit("="), _as_text("id", types["id"])), F.lit("")).alias("k"),
        F.coalesce(F.unix_micros("run"), F.raise_error(F.lit("a snapshot's row has no run")).cast("bigint")).alias("us"),
        F.to_json(F.array(*[_as_text(f, types[f]) for f in fields]).cast("array<string>")).alias("data"),
        F.coalesce(~F.col("is_expired"), F.lit(False)).alias("detailed"))
    out = timed.groupBy("bucket").applyInPandasWithState(
        step, "k string, data string, is_expired boolean, " + ", ".join(f"{s} bigint" for s in stamps), "held binary", "update",
        GroupStateTimeout.EventTimeTimeout)
    values = out.withColumn("data", F.from_json("data", "array<string>"))
    return values.select(
        _from_text(F.when(F.col("k") != "", F.substr("k", F.lit(2))), types["id"]).alias("id"),
        *[_from_text(F.get("data", F.lit(i)), types[f]).alias(f) for i, f in enumerate(fields)],
        "is_expired", *[F.timestamp_micros(s).alias(s) for s in stamps])


def to_changes(path: str) -> Callable[[DataFrame, int], None]:
    """Sink of an update-mode stream: each micro-batch's rows under its number, overwritten if the batch runs again."""
    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return run


def current(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The keyed table that a folder of changes describes: the last change of every key."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("r.*")


class DatedStore:
    """Rows by day, each micro-batch in files of its own; a day behind the retention mark is dropped as a folder.

    No kept row is written again. The mark is the newest time seen less ``days``. A row that arrives behind the mark is not
    stored; one that falls behind it later is left out on reading until its whole day has.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str, days: int = RETENTION_DAYS):
        self.spark, self.path, self.ts, self.days = spark, path.rstrip("/"), ts, days

    def _days(self) -> list[str]:
        """Days that have a folder; their number is bounded by the retention period."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.listStatus(root) if fs.exists(root) else []
        return sorted(f.getPath().getName().removeprefix("day=") for f in found if f.getPath().getName().startswith("day="))

    def mark(self):
        """Oldest time that is kept, from the newest day alone; null while nothing is stored."""
        days = self._days()
        if not days:
            return F.lit(None).cast("timestamp")
        newest = self.spark.read.parquet(f"{self.path}/day={days[-1]}").agg(F.max(self.ts)).first()[0]
        return F.lit(newest) - F.expr(f"INTERVAL {self.days} DAYS")

    def append(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: its rows are written, then days that ended behind the mark are dropped."""
        dated = batch.where(F.coalesce(F.col(self.ts) >= self.mark(), F.col(self.ts).isNotNull())).withColumns(
            {"day": F.date_format(self.ts, "yyyy-MM-dd"), "batch": F.lit(number)})
        # only this batch's folders are overwritten, so a batch that runs again leaves the same files
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)
        oldest = self.spark.range(1).select(F.date_format(self.mark(), "yyyy-MM-dd")).first()[0]
        for day in self._days():
            if oldest is not None and day < oldest:
                remove_path(self.spark, f"{self.path}/day={day}")

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path).drop("day", "batch")
        return rows.where(F.col(self.ts) >= self.mark())


def sync(stream: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None]) -> None:
    """Deliver what is new since the last sync; the mark is the source's offset in the checkpoint.

    A sync that ends in the middle leaves its batch planned: the next one delivers the same rows under the same number
    again, and goes on. ``deliver`` must take a number it knows as the same batch.
    """
    run_to_end(stream, checkpoint, each=deliver)


def run_to_end(stream: DataFrame, checkpoint: str, sink: str | None = None,
               each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process everything that is there now, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    started = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", sink).start()
    started.awaitTermination()
