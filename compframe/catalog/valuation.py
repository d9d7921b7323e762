"""Queries of the valuation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from compframe.catalog import checks as C
from compframe.catalog import standin as S
from compframe.catalog.registry import query
from compframe.functions import text as T
from compframe.operators.comparables import city_size_median, similar_hoods, value_subjects
from compframe.plans import export as E


def flats(spark, sf):
    rows = E.ranking.dedupe_auctions(E.exportable(S.auctions(spark, sf), S.now()))
    return rows.where(E.P.is_comparable_type(F.trim("property_type")) & ~F.col("is_partial_ownership"))


@query("valuation_ladder", f"WITH {C.TABLES}, {C.EXPORTABLE}, {C.FLATS}, {C.valuation_ctes('flats')} "
       "SELECT f.id, v.match_pass, v.comparables_count, v.market_median, v.range_min, v.range_max, "
       "v.comparables_level, v.matched_hood FROM flats f LEFT JOIN valued v ON v.id = f.id")
def valuation_ladder(spark, sf):
    """Six-pass comparables ladder."""
    valued = value_subjects(E.with_auction_hood(flats(spark, sf)), S.market(spark, sf))
    return valued.select("id", "match_pass", "comparables_count", "market_median", "range_min",
                         "range_max", "comparables_level", "matched_hood")


DEAL_COLUMNS = ("id, city, neighborhood, address, price, effective_price, sqm, price_per_sqm, market_avg, "
                "market_price, savings_eur, comparables_count, comparables_level, market_min_sqm, market_max_sqm, "
                "discount, property_type, floor, property_type_bg, auction_start, auction_end, url, "
                "matched_neighborhood, partial_ownership, score")


@query("export_deals", f"WITH {C.DEALS} SELECT {DEAL_COLUMNS} FROM deals")
def export_deals(spark, sf):
    """The whole export job."""
    return E.export_deals(S.auctions(spark, sf), S.market(spark, sf), S.now())
