"""Deal export: filter, value, score, de-duplicate, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe import lookups as L
from compframe.config import ValuationConfig
from compframe.functions import price as P
from compframe.functions import text as T
from compframe.functions import time as D
from compframe.functions.core import blank_to_null, round_exact
from compframe.operators import filters, ranking
from compframe.operators.comparables import value_subjects
from compframe.session import staged


def with_auction_hood(auctions: DataFrame) -> DataFrame:
    """District of the row itself, else the one its address names (town put first)."""
    city, address = F.coalesce("city", F.lit("")), blank_to_null(F.col("address"))
    named = F.when(city == "", address).otherwise(F.concat_ws(", ", city, address))
    return auctions.withColumn("auction_hood", F.coalesce(
        blank_to_null(F.col("neighborhood")), F.when(address.isNotNull(), T.extract_hood(named))))


def exportable(auctions: DataFrame, now: Column) -> DataFrame:
    """Live, sized, priced auctions of an exported type, with a clean town name."""
    return (
        auctions.where(filters.active_and_sized())
        .where(~filters.excluded_type(F.col("property_type")) & ~D.is_expired("auction_end", now))
        .withColumn("city", F.coalesce(T.clean_city("city"), F.lit("")))
    )


def export_counters(auctions: DataFrame, now: Column) -> DataFrame:
    """Counters of one export, taken before de-duplication. 'commercial' counts as other."""
    excluded = filters.excluded_type(F.col("property_type"))
    expired = ~excluded & D.is_expired("auction_end", now)
    kept = ~excluded & ~expired
    kind = P.type_category(F.trim("property_type"))
    return auctions.where(filters.active_and_sized()).agg(
        F.count("*").alias("total"),
        F.count_if(excluded).alias("excluded"),
        F.count_if(expired).alias("expired"),
        F.count_if(kept & F.col("is_partial_ownership")).alias("partial"),
        F.count_if(kept & (kind == "apartment")).alias("apartments"),
        F.count_if(kept & (kind == "house")).alias("houses"),
        F.count_if(kept & (kind == "garage")).alias("garages"),
        F.count_if(kept & ~kind.isin("apartment", "house", "garage")).alias("other"),
    )


def build_deals(auctions: DataFrame, market: DataFrame, now: Column,
                cfg: ValuationConfig = ValuationConfig()) -> DataFrame:
    """One row per distinct property, with price_eur kept for ordering.

    Copies are dropped before valuation: the fingerprint does not depend on it, so the
    same row survives and less is valued.
    """
    rows = staged(ranking.dedupe_auctions(exportable(auctions, now)), "deal-rows")  # read twice, for the valued kinds and the rest
    valued_kind = P.is_comparable_type(F.trim("property_type")) & ~F.coalesce(
        F.col("is_partial_ownership"), F.lit(False))
    flats = value_subjects(with_auction_hood(rows.where(valued_kind)), market, cfg)
    rest = rows.where(~valued_kind)
    return flats.unionByName(rest, allowMissingColumns=True).select(*deal_columns())


def deal_columns() -> list[Column]:
    price, size, median = F.col("price_eur"), F.col("size_sqm"), F.col("market_median")
    partial = F.coalesce(F.col("is_partial_ownership"), F.lit(False))
    avg = round_exact(median)
    disc = F.when(~partial, P.discount_pct(price, size, median))

    def whole(c: Column) -> Column:
        return c.cast("bigint")

    hood = T.title_hood("neighborhood")
    return [
        F.col("id").cast("string").alias("id"), "city",
        blank_to_null(hood).alias("neighborhood"),
        F.coalesce("address", F.lit("")).alias("address"),
        whole(round_exact(price)).alias("price"), whole(round_exact(price)).alias("effective_price"),
        round_exact(size, 1).alias("sqm"), whole(round_exact(price / size)).alias("price_per_sqm"),
        whole(avg).alias("market_avg"), whole(round_exact(avg * size)).alias("market_price"),
        whole(round_exact(avg * size - price)).alias("savings_eur"),
        F.coalesce("comparables_count", F.lit(0)).cast("int").alias("comparables_count"),
        "comparables_level",
        whole(round_exact(F.col("range_min"))).alias("market_min_sqm"),
        whole(round_exact(F.col("range_max"))).alias("market_max_sqm"),
        disc.alias("discount"),
        P.type_category(F.trim("property_type")).alias("property_type"), "floor",
        F.col("property_type").alias("property_type_bg"),
        F.lit(None).cast("string").alias("auction_start"), "auction_end",
        F.concat(F.lit(L.AUCTION_URL), F.col("id").cast("string")).alias("url"),
        T.title_hood("matched_hood").alias("matched_neighborhood"),
        F.when(partial, L.PARTIAL_LABEL).alias("partial_ownership"),
        P.score5(disc, partial).alias("score"),
        "price_eur",
    ]


def export_deals(auctions: DataFrame, market: DataFrame, now: Column,
                 cfg: ValuationConfig = ValuationConfig()) -> DataFrame:
    """Deals in published order."""
    return build_deals(auctions, market, now, cfg).orderBy(*ranking.publish_order()).drop("price_eur")


def top_discounted(deals: DataFrame, k: int = 5) -> DataFrame:
    """First discounted, wholly owned deals in published order."""
    return deals.where((F.col("discount") > 0) & F.col("partial_ownership").isNull()).orderBy(
        *ranking.publish_order()).limit(k)
