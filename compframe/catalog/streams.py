"""Queries over the event stream, and their batch twins."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from compframe.catalog import standin as S
from compframe.catalog.registry import query
from compframe.operators.bursts import burst_filter
from compframe.session import new_path
from compframe.streaming import flows as X

LIMIT, WINDOW_S = 3, 6 * 3600


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return S.zoned(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def folder(spark, name):
    return new_path(spark, name)


def requests(df):
    return df.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))


ADMITTED = (
    "WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    "walk AS (SELECT user_id, rn, event_id, [ts] AS seen, true AS ok FROM e WHERE rn = 1 UNION ALL "
    f"SELECT user_id, rn, event_id, CASE WHEN len(f) < {LIMIT} THEN list_append(f, ts) ELSE f END, len(f) < {LIMIT} FROM "
    f"(SELECT e.user_id, e.rn, e.event_id, e.ts, list_filter(w.seen, lambda t: e.ts - t < INTERVAL {WINDOW_S} SECOND) AS f "
    "FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)) SELECT user_id AS key, event_id AS id FROM walk WHERE ok"
)


@query("burst_admitted", ADMITTED)
def burst_admitted(spark, sf):
    """Events admitted by the burst filter."""
    return burst_filter(requests(S.table(spark, sf, "events")), LIMIT, WINDOW_S).select("key", "id")


@query("stream_burst", ADMITTED)
def stream_burst(spark, sf):
    """The same on the stream."""
    out = folder(spark, "burst")
    admitted = X.burst_stream(requests(event_stream(spark, sf)), LIMIT, WINDOW_S)
    X.run_to_end(admitted, f"{out}/state", f"{out}/rows")
    return spark.read.parquet(f"{out}/rows").select("key", "id")


@query("stream_dedupe", "SELECT DISTINCT event_id % 4000 AS id FROM events")
def stream_dedupe(spark, sf):
    """Each id once."""
    out = folder(spark, "dedupe")
    posts = event_stream(spark, sf).select((F.col("event_id") % 4000).alias("id"), "ts")
    X.run_to_end(X.dedupe_posts(posts, within="60 days"), f"{out}/state", f"{out}/rows")
    return spark.read.parquet(f"{out}/rows").select("id")


@query("stream_once", "SELECT min(event_id) AS event_id, count(*) AS n FROM (SELECT DISTINCT event_id FROM events) GROUP BY event_id % 1000")
def stream_once(spark, sf):
    """Every event once although each is delivered twice."""
    out = folder(spark, "once")
    rows = event_stream(spark, sf).select("event_id", "ts")
    twice = rows.unionByName(rows)
    X.run_to_end(X.once_per_event(twice, within="60 days"), f"{out}/state", f"{out}/rows")
    return spark.read.parquet(f"{out}/rows").groupBy(F.col("event_id") % 1000).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n")).select("event_id", "n")


@query("stream_upsert", "SELECT user_id AS id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, "
       "arg_max(event_type, ts) AS event_type, true AS is_active FROM events GROUP BY user_id")
def stream_upsert(spark, sf):
    """Upsert that keeps first_seen, in the state store."""
    out = folder(spark, "upsert")
    rows = event_stream(spark, sf).select(F.col("user_id").alias("id"), "ts", "event_type")
    X.run_to_end(X.upsert_stream(rows), f"{out}/state", each=X.to_changes(f"{out}/rows"), mode="update")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_seen", "last_seen")}
    return X.current(spark, f"{out}/rows").withColumns(shown)


@query("stream_sync", "SELECT event_id, user_id FROM events")
def stream_sync(spark, sf):
    """Two syncs, the first of which breaks off after it has delivered."""
    out = folder(spark, "sync")
    rows = event_stream(spark, sf).select("event_id", "user_id")

    def broken(batch, number):
        X.to_changes(f"{out}/rows")(batch, number)
        raise InterruptedError("the line broke before the sync was marked")

    try:
        X.sync(rows, f"{out}/state", broken)
    except StreamingQueryException:
        X.sync(rows, f"{out}/state", X.to_changes(f"{out}/rows"))
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id")


@query("stream_retain", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def stream_retain(spark, sf):
    """Seven-day retention, batch by batch (T4)."""
    out = folder(spark, "retain")
    rows = event_stream(spark, sf).select("event_id", "user_id", "ts")
    store = X.DatedStore(spark, f"{out}/rows", "ts")
    X.run_to_end(rows, f"{out}/state", each=store.append)
    return store.read().select("event_id", "user_id")


RUN_1, RUN_2 = "2024-03-01 06:00:00", "2024-03-02 06:00:00"


@query("stream_snapshots", "SELECT CAST(p_partkey AS BIGINT) AS id, p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 1000.0 ELSE 0.0 END AS price_eur, "
       f"p_partkey % 5 = 0 AS is_expired, CASE WHEN p_partkey % 3 = 0 THEN '{RUN_2}' ELSE '{RUN_1}' END AS first_seen_at, "
       f"CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN '{RUN_2}' ELSE '{RUN_1}' END AS last_updated_at "
       "FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 <> 0")
def stream_snapshots(spark, sf):
    """Two full snapshots as a stream: new ids come in, missing ones expire, known ones stay."""
    out = folder(spark, "snapshots")
    part = S.table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("id"), "p_retailprice")
    schema = "id bigint, run timestamp, price_eur double, is_expired boolean"
    for run, gone, more in ((RUN_1, 3, 0.0), (RUN_2, 5, 1000.0)):
        part.where(F.col("id") % gone != 0).select(
            "id", F.lit(run).cast("timestamp").alias("run"), (F.col("p_retailprice") + more).alias("price_eur"),
            F.lit(False).alias("is_expired")).write.mode("append").parquet(f"{out}/in")
        rows = spark.readStream.schema(schema).parquet(f"{out}/in")
        X.run_to_end(X.snapshot_stream(rows, ["price_eur"]), f"{out}/state", each=X.to_changes(f"{out}/rows"), mode="update")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen_at", "last_updated_at")}
    return X.current(spark, f"{out}/rows").withColumns(shown).select("id", "price_eur", "is_expired", *shown)
