"""Keyed state between runs: diff, merge, expiry, retention, upsert, ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe import lookups as L
from compframe.config import LEDGER_KEEP_DAYS, RETENTION_DAYS
from compframe.functions import time as D


def snapshot_diff(known: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Keys only in the new snapshot ('new') and only in the old one ('gone')."""
    k = known.select(key).distinct().withColumn("in_known", F.lit(True))
    c = current.select(key).distinct().withColumn("in_current", F.lit(True))
    both = k.join(c, key, "full_outer")
    return both.where(F.col("in_known").isNull() | F.col("in_current").isNull()).select(
        key, F.when(F.col("in_known").isNull(), "new").otherwise("gone").alias("change"))


def full_refresh(details: DataFrame, now: Column) -> DataFrame:
    """The table as one full load leaves it: every first_seen_at is this run."""
    return details.withColumns({"scraped_at": now, "first_seen_at": now, "last_updated_at": now})


def incremental_merge(known: DataFrame, current: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """State after one incremental run.

    Live ids missing from ``current`` expire. Ids of ``current`` that are not live are new:
    with live ``details`` they are inserted or revived, keeping first_seen_at. Everything
    else is unchanged, then rows whose end date has passed expire.
    """
    stamps = {"scraped_at", "first_seen_at", "last_updated_at"}
    fields = [c for c in known.columns if c not in stamps | {"id", "is_expired"}]
    new = details.select("id", F.struct(*fields).alias("d"), F.col("is_expired").alias("d_expired"))
    seen = current.select("id").distinct().withColumn("listed", F.lit(True)).join(new, "id", "left")
    old = known.select("id", F.struct(*fields).alias("o"), "is_expired", *stamps, F.lit(True).alias("had"))
    live = F.coalesce(~F.col("is_expired"), F.lit(False))
    listed = F.coalesce(F.col("listed"), F.lit(False))
    fetched = listed & ~live & F.col("d").isNotNull() & ~F.coalesce(F.col("d_expired"), F.lit(False))
    gone = live & ~listed
    merged = (
        old.join(seen, "id", "full_outer").where(F.col("had") | fetched)
        .select(
            "id", F.when(fetched, F.col("d")).otherwise(F.col("o")).alias("f"),
            F.when(fetched, False).when(gone, True).otherwise(F.col("is_expired")).alias("is_expired"),
            F.when(fetched, now).otherwise(F.col("scraped_at")).alias("scraped_at"),
            F.coalesce("first_seen_at", now).alias("first_seen_at"),
            F.when(fetched | gone, now).otherwise(F.col("last_updated_at")).alias("last_updated_at"))
        .select("id", "f.*", "is_expired", "scraped_at", "first_seen_at", "last_updated_at")
    )
    return expire_by_date(merged, now).select(*known.columns)


def expire_by_date(auctions: DataFrame, now: Column) -> DataFrame:
    """Live rows whose D.M.YYYY end date has passed become expired."""
    passed = ~F.col("is_expired") & F.coalesce(
        D.parse_local_date("auction_end").cast("timestamp") < now, F.lit(False))
    return auctions.withColumns({
        "is_expired": F.col("is_expired") | passed,
        "last_updated_at": F.when(passed, now).otherwise(F.col("last_updated_at"))})


def retain(rows: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than the retention period."""
    return rows.where(F.col("scraped_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def replace_source(store: DataFrame, extract: DataFrame, source: str) -> DataFrame:
    """Store with all rows of one source exchanged for a new extract."""
    return store.where(F.col("source") != source).unionByName(extract.where(F.col("source") == source))


def upsert_keep_first_seen(known: DataFrame, batch: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Insert or update: new fields win, first_seen stays, last_seen is now, active again."""
    fields = [c for c in batch.columns if c != key]
    b = batch.select(key, F.struct(*fields).alias("b"))
    k = known.select(key, F.struct(*fields).alias("k"), "first_seen", "last_seen", "is_active")
    hit = F.col("b").isNotNull()
    return k.join(b, key, "full_outer").select(
        key, F.coalesce("b", "k").alias("f"), F.coalesce("first_seen", now).alias("first_seen"),
        F.when(hit, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(hit, True).otherwise(F.col("is_active")).alias("is_active"),
    ).select(key, "f.*", "first_seen", "last_seen", "is_active")


def pending_pairs(grid: DataFrame, ledger: DataFrame, day: Column) -> DataFrame:
    """City and source pairs that today's ledger does not hold yet."""
    done = ledger.where(F.to_date("completed_at") == day).select("city", "source")
    return grid.join(done, ["city", "source"], "left_anti")


def trim_ledger(ledger: DataFrame, now: Column, keep_days: int = LEDGER_KEEP_DAYS) -> DataFrame:
    return ledger.where(F.to_date("completed_at") >= F.to_date(now - F.expr(f"INTERVAL {keep_days} DAYS")))


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(known.select(key), key, "left_anti")


def unsynced_since(rows: DataFrame, mark: Column, ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts) > mark)


def copy_missing(src: DataFrame, dst: DataFrame, key: str = "email") -> tuple[DataFrame, DataFrame]:
    """Rows to append to ``dst``, and how many were migrated and skipped.

    A key that occurs twice in the source is inserted once, the lowest id first.
    """
    from compframe.operators.ranking import keep_first
    fresh = keep_first(unseen(src, dst, key), [key], [F.col("id").asc()])
    tally = src.select(F.lit(1).alias("total"), F.lit(0).alias("migrated")).unionByName(
        fresh.select(F.lit(0).alias("total"), F.lit(1).alias("migrated")))
    counts = tally.agg(F.sum("migrated").alias("migrated"),
                       (F.sum("total") - F.sum("migrated")).alias("skipped"))
    return fresh, counts


def uncovered_supplements(market: DataFrame, source: str = L.CARD_PORTAL) -> DataFrame:
    """Listed extra searches (city, label, slug) whose district the source has not delivered."""
    rows = [(c, h, s) for c, hs in L.SEARCH_SUPPLEMENTS.items() for h, s in hs]
    wanted = market.sparkSession.createDataFrame(rows, "city string, label string, slug string").withColumn("k", F.lower("label"))
    found = market.where(F.col("source") == source).select("city", F.lower("neighborhood").alias("k")).distinct()
    return wanted.join(found, ["city", "k"], "left_anti").drop("k")
