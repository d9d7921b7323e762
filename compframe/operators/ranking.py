"""Keep-first, keep-last, top-k, published orders, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from compframe.functions import price as P
from compframe.functions.core import round_exact
from compframe.functions import time as D
from compframe.operators.filters import has_market
from compframe.session import staged


def top_per_group(df: DataFrame, keys: list[Column | str], order: list[Column], k: int,
                  rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group.

    Spark limits each group on the map side before the shuffle, so a group with a third of
    all rows sends k rows per task.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def dedupe_auctions(auctions: DataFrame) -> DataFrame:
    """One row per property that a court listed twice; nulls compare equal."""
    return keep_first(auctions, [
        F.coalesce("address", F.lit("")), round_exact(F.col("price_eur")),
        round_exact(F.col("size_sqm"), 1), F.col("property_type"), F.col("floor"),
    ], [F.col("price_eur").asc(), F.col("id").asc()])


def keep_latest(market: DataFrame) -> DataFrame:
    """Last row per (city, size, price, source); rows without a price never replace each other."""
    tie = [F.col(c).asc_nulls_first() for c in ("neighborhood", "price_per_sqm", "rooms")]
    priced = keep_first(market.where(F.col("price_eur").isNotNull()),
                        ["city", "size_sqm", "price_eur", "source"], [F.col("scraped_at").desc(), *tie])
    return priced.unionByName(market.where(F.col("price_eur").isNull()))


def publish_order() -> list[Column]:
    """Deals with a discount first, largest discount first, then cheapest."""
    has = F.coalesce(F.col("discount") > 0, F.lit(False))
    return [F.when(has, 0).otherwise(1).asc(), F.coalesce("discount", F.lit(0.0)).desc(),
            F.col("price").asc(), F.col("price_eur").asc(), F.col("id").cast("bigint").asc()]


def load_order() -> list[Column]:
    """Deals with a market price first by discount, the rest by price."""
    has = has_market()
    return [F.when(has, 0).otherwise(1).asc(),
            F.when(has, F.coalesce("discount", F.lit(0.0))).desc_nulls_last(),
            F.when(~has, F.col("price")).asc_nulls_first()]


def user_order(sort: str) -> list[Column]:
    """One of the five orders of the browse view; ties keep the load order."""
    end = D.parse_date("auction_end")
    orders = {
        "best": P.best_rank(F.col("discount"), F.coalesce(F.col("savings_eur"), F.lit(0))).desc(),
        "ending": end.asc_nulls_last(),
        "newest": end.desc_nulls_last(),
        "price_asc": F.col("effective_price").asc(),
        "price_desc": F.col("effective_price").desc(),
    }
    return [orders[sort]]


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows with their number (from 1) in their group, in the given order, which must leave no ties.

    The table is sorted once, by ranges of (keys, order); a row's number is its place in the range plus what earlier
    ranges hold of its group. No task sorts a group, however large.
    """
    by = [*[F.col(k) for k in keys], *order]
    rows = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")  # the id has the range above the place in it
    runs = rows.groupBy(part, *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("_part").alias("_run"), *[F.col(k).alias(f"_run_{k}") for k in keys],
                       (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.shiftright("_at", 33) == F.col("_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_run_{k}"))
    return rows.join(runs, same).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)


#: Rows up to which a page is cut from the first rows of the whole; deeper pages number all rows.
SHALLOW = 10_000


def page(ordered: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page. Early pages keep only the rows up to them while sorting; for a deep one the rows are numbered
    range by range, and its own are picked."""
    if number * size <= SHALLOW:
        return ordered.orderBy(*order).limit(number * size).offset((number - 1) * size)
    nth = F.col("_nth")
    return numbered(ordered, [], order, "_nth").where((nth > (number - 1) * size) & (nth <= number * size)).drop("_nth").orderBy(*order)


def cheapest(auctions: DataFrame, max_price: float, k: int = 20) -> DataFrame:
    return (auctions.where((F.col("price_eur") > 0) & (F.col("price_eur") <= max_price))
            .orderBy(F.col("price_eur").asc(), F.col("id").asc()).limit(k))


def newest(posts: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest posts; how many are wanted is for the caller to say."""
    return posts.orderBy(F.col("ts").desc(), F.col("id").asc()).limit(k)
