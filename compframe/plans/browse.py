"""Browse view: load, filter, sort, page, headline numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe import lookups as L
from compframe.config import PAGE_SIZE
from compframe.functions import price as P
from compframe.functions import time as D
from compframe.functions.core import round_half_up
from compframe.operators import filters, ranking


def load_view(deals: DataFrame) -> DataFrame:
    """Deals with a price and a size."""
    return deals.where(filters.loadable())


def card_columns(deals: DataFrame, now: Column) -> DataFrame:
    """Rating, remaining time, flags and price bar of every card."""
    days = D.days_until("auction_end", now)
    pct = F.coalesce("discount", F.lit(0.0))
    market = F.when(filters.has_market(), F.col("market_price"))
    left = D.time_left("auction_end", now)
    return deals.withColumns({
        "rating": P.rating(pct), "days": days, "is_new": D.is_new(days), "is_urgent": D.is_urgent(days),
        "left": left, "bar": P.price_bar(F.col("effective_price"), market),
    })


def browse(deals: DataFrame, now: Column, sort: str = "best", page: int | None = None,
           page_size: int = PAGE_SIZE, **panel) -> DataFrame:
    """Filtered deals in a chosen order; one page of them if ``page`` is given."""
    rows = load_view(deals).where(filters.browse(now, **panel))
    order = ranking.user_order(sort) + ranking.load_order() + [F.col("id").asc()]
    return rows.orderBy(*order) if page is None else ranking.page(rows, order, page, page_size)


def headline(deals: DataFrame) -> DataFrame:
    """Rows, mean positive discount and best discount, as shown on top of the page."""
    d = F.coalesce("discount", F.lit(0.0))
    return deals.agg(
        F.count("*").alias("deals"),
        round_half_up(F.coalesce(F.avg(F.when(d > 0, d)), F.lit(0.0))).alias("avg_discount"),
        round_half_up(F.max(d)).alias("best_discount"))


def city_stats(deals: DataFrame) -> DataFrame:
    """Rows and mean positive discount per town."""
    d = F.col("discount")
    return deals.groupBy("city").agg(
        F.count("*").alias("deals"),
        round_half_up(F.coalesce(F.avg(F.when(d > 0, d)), F.lit(0.0))).alias("avg_discount"))


def city_page(deals: DataFrame, name: str, exact: bool) -> DataFrame:
    """The same for one town's page, matched by equality or by substring."""
    match = F.col("city") == name if exact else F.contains(F.col("city"), F.lit(name))
    d = F.col("discount")
    return deals.where(match).agg(
        F.lit(name).alias("page"), F.count("*").alias("deals"),
        round_half_up(F.coalesce(F.avg(F.when(d > 0, d)), F.lit(0.0))).alias("avg_discount"))


def city_options(deals: DataFrame) -> DataFrame:
    """Major towns that have deals, in their fixed order."""
    place = F.array_position(F.array(*[F.lit(c) for c in L.MAJOR_CITIES]), F.col("city"))
    return deals.groupBy("city").agg(F.lit(1).alias("_")).select(
        (place - 1).cast("int").alias("ord"), "city").where(F.col("ord") >= 0).orderBy("ord")
