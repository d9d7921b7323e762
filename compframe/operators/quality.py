"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from compframe import lookups as L
from compframe.config import COVERAGE_ALARM_PCT, MIN_LISTINGS_PER_SOURCE
from compframe.operators.aggregates import coverage


def expected_grid(spark: SparkSession, cities=tuple(L.MARKET_CITIES), sources=tuple(L.DEAL_SOURCES)) -> DataFrame:
    """Every town with every source that a complete run must deliver."""
    return spark.createDataFrame([(c, s) for c in cities for s in sources], "city string, source string")


def grid_completeness(grid: DataFrame, market: DataFrame, minimum: int = MIN_LISTINGS_PER_SOURCE) -> DataFrame:
    """Rows delivered per town and source, with success flag and error text."""
    got = market.groupBy("city", "source").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    few = F.concat(F.lit("Too few listings: "), n.cast("string"), F.lit(f" < {minimum}"))
    return grid.join(got, ["city", "source"], "left").select(
        "city", "source", n.alias("n"), (n >= minimum).alias("success"),
        F.when(n >= minimum, "").otherwise(few).alias("error"))


def run_verdict(grid: DataFrame, ledger: DataFrame) -> DataFrame:
    """All-or-nothing verdict: incomplete, failed or ok."""
    done = ledger.select("city", "source", "success", F.col("n").alias("count"))
    joined = grid.join(done, ["city", "source"], "left")
    return joined.agg(
        F.when(F.count_if(F.col("success").isNull()) > 0, "incomplete")
        .when(F.count_if(~F.col("success")) > 0, "failed").otherwise("ok").alias("verdict"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("count"))), F.lit(0)).alias("listings"))


def coverage_alarm(deals: DataFrame, threshold: float = COVERAGE_ALARM_PCT) -> DataFrame:
    """Share of deals with a market price, and whether it is too small."""
    return coverage(deals, F.coalesce(F.col("market_price") != 0, F.lit(False))).withColumn(
        "alarm", F.col("pct") < threshold)


def invariants(deals: DataFrame) -> DataFrame:
    """Rows that break each of the three output rules; all must be zero."""
    has = F.coalesce(F.col("discount") != 0, F.lit(False))
    return deals.agg(
        F.count_if(has & (F.coalesce("comparables_count", F.lit(0)) < 3)).alias("discount_without_comparables"),
        F.count_if(has & F.col("partial_ownership").isNotNull()).alias("discount_on_partial"),
        F.count_if(F.coalesce(F.col("discount") > 70, F.lit(False))).alias("discount_above_70"))


def parser_success(rows: DataFrame, fields: list[str], minimum: float = 90.0) -> DataFrame:
    """Percentage of rows with each key field, and whether all reach the target."""
    pct = [F.avg(F.when(F.col(f).isNotNull(), 100.0).otherwise(0.0)).alias(f"{f}_pct") for f in fields]
    out = rows.agg(*pct)
    ok = F.lit(True)
    for f in fields:
        ok = ok & (F.col(f"{f}_pct") >= minimum)
    return out.withColumn("ok", ok)


def freshness(rows: DataFrame, ts: str, today: Column) -> DataFrame:
    """Newest date, and whether it is today."""
    return rows.agg(F.to_date(F.max(ts)).alias("newest")).withColumn("fresh", F.col("newest") == today)
