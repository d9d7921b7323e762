"""Grouped reports. All use partial aggregation, so skewed keys do not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from compframe.functions.core import strip
from compframe.operators.ranking import top_per_group


def _holder(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the first value whose running count passes ``rank`` (from 0)."""
    run = F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    before = F.col("_upto") - F.col("n")
    return counted.withColumn("_upto", run).where((F.col("_upto") > F.col("rank")) & (before <= F.col("rank"))).select(
        *keys, value, (F.col("rank") - before).alias("rank"))


def upper_median(rows: DataFrame, keys: list[str], value: str, step: float) -> DataFrame:
    """Exact element n//2 of the sorted values per key, as (keys, n, median).

    Values are counted in steps first; only the step that holds the wanted rank is looked
    at value by value. A key with a third of all rows is never sorted as one group.
    """
    known = rows.where(F.col(value).isNotNull()).withColumn("_step", F.floor(F.col(value) / F.lit(step)))
    steps = known.groupBy(*keys, "_step").agg(F.count("*").alias("n"))
    sizes = steps.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = steps.join(sizes, keys).withColumn("rank", F.floor(F.col("total") / 2)).drop("total")
    held = _holder(ranked, keys, "_step")
    inside = known.join(held, [*keys, "_step"]).groupBy(*keys, value, "rank").agg(F.count("*").alias("n"))
    return _holder(inside, keys, value).drop("rank").join(sizes, keys).select(
        *keys, F.col("total").alias("n"), F.col(value).alias("median"))


def at_ranks(rows: DataFrame, keys: list[str], value: str, step: float, ranks: dict[str, Column]) -> DataFrame:
    """Per key the sorted values at some ranks (from 0), each a column of its name.

    ``ranks`` are expressions of ``total``, the number of values of the key. Steps first, then the
    values of the steps that hold a rank: no key's values are ever in one task as a group.
    """
    known = rows.where(F.col(value).isNotNull()).withColumn("_step", F.floor(F.col(value) / F.lit(step)))
    steps = known.groupBy(*keys, "_step").agg(F.count("*").alias("n"))
    sizes = steps.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = sizes.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])).alias("w")).select(*keys, "w.*")
    held = _holder(steps.join(wanted, keys), [*keys, "name"], "_step")
    inside = known.join(held, [*keys, "_step"]).groupBy(*keys, "name", value, "rank").agg(F.count("*").alias("n"))
    found = _holder(inside, [*keys, "name"], value)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks])


def nearest_rank(values: str, pct: float) -> Column:
    """Nearest-rank percentile of a group that is small by nature, such as a top-k list."""
    return F.expr(f"percentile_disc({pct / 100}) WITHIN GROUP (ORDER BY {values})")


def rank_of(pct: float) -> Column:
    """Rank (from 0) of the nearest-rank percentile among ``total`` values."""
    return F.greatest(F.ceil(F.col("total") * F.lit(pct) / 100), F.lit(1)) - 1


def quartiles(rows: DataFrame, keys: list[str], value: str, step: float) -> DataFrame:
    """Interpolated median, and nearest-rank quartiles, as (keys, median, low, high)."""
    half = F.col("total") / 2
    out = at_ranks(rows, keys, value, step, {"below": F.ceil(half) - 1, "above": F.floor(half), "low": rank_of(25), "high": rank_of(75)})
    return out.select(*keys, ((F.col("below") + F.col("above")) / 2).alias("median"), "low", "high")


def price_stats_by(market: DataFrame, key: str) -> DataFrame:
    """Rows and rounded mean price per m2, by source or by city."""
    return market.where(F.col("price_per_sqm").isNotNull()).groupBy(key).agg(
        F.count("*").alias("listings"), F.round(F.avg("price_per_sqm"), 0).alias("avg_pps"))


def active_by(auctions: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Live auctions per key, largest group first."""
    out = auctions.where(~F.col("is_expired")).groupBy(key).agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), F.col(key).asc_nulls_first())
    return out.limit(top) if top else out


def coverage(rows: DataFrame, known: Column) -> DataFrame:
    """Rows, rows where ``known`` holds, and the percentage."""
    return rows.agg(F.count("*").alias("total"), F.count_if(known).alias("known")).withColumn(
        "pct", F.coalesce(F.col("known") * 100.0 / F.nullif("total", F.lit(0)), F.lit(0.0)))


def top_hoods(auctions: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent districts per town."""
    counted = (auctions.where(~F.col("is_expired") & F.col("neighborhood").isNotNull())
               .groupBy("city", "neighborhood").agg(F.count("*").alias("n")))
    return top_per_group(counted, ["city"], [F.col("n").desc(), F.col("neighborhood").asc()], k, rank="place")


def court_stats(listings: DataFrame) -> DataFrame:
    """Listings and price range per court; prices of zero are left out of the range."""
    p = F.when(F.col("price_eur") > 0, F.col("price_eur"))
    return listings.groupBy("court").agg(
        F.count("*").alias("n"), F.min(p).alias("min_price"), F.max(p).alias("max_price"),
        F.round(F.avg(p), 2).alias("avg_price")).orderBy(F.col("n").desc(), "court")


def run_log(steps: DataFrame) -> DataFrame:
    """Totals of every run."""
    return steps.groupBy("run_id").agg(
        F.sum("pages").alias("pages"), F.sum("seen").alias("seen"), F.sum("saved").alias("saved"),
        F.sum("errors").alias("errors"), F.sum("added").alias("added"))


def hood_range(pairs: DataFrame, market: DataFrame) -> DataFrame:
    """Price range of the districts similar to each subject district."""
    per_hood = market.where(F.col("hood").isNotNull()).groupBy("city", "hood").agg(
        F.min("pps").alias("lo"), F.max("pps").alias("hi"))
    return (pairs.join(per_hood.withColumnRenamed("hood", "m_hood"), ["city", "m_hood"])
            .groupBy("city", "hood").agg(F.min("lo").alias("range_lo"), F.max("hi").alias("range_hi")))


def items_since(posts: DataFrame, start: Column) -> DataFrame:
    """All items, and those of the current day."""
    return posts.agg(F.count("*").alias("items"), F.count_if(F.col("ts") >= start).alias("today"))


def distinct_cities(auctions: DataFrame) -> DataFrame:
    return auctions.select(strip(F.col("city")).alias("city")).distinct()
