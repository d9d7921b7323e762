"""Row predicates. Each returns a boolean column for ``where``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from compframe import lookups as L
from compframe.config import (
    INGEST_PPS, INGEST_PRICE, INGEST_SIZE, SALE_FLOOR, AppraisalConfig, ValuationConfig,
)
from compframe.functions import text, time
from compframe.functions.core import strip


def active_and_sized() -> Column:
    """Live auctions with a size and a price."""
    return ~F.col("is_expired") & (F.col("size_sqm") > 0) & (F.col("price_eur") > 0)


def excluded_type(c: Column) -> Column:
    """Land, plots and blank types; never null."""
    t = F.coalesce(strip(c), F.lit(""))
    return t.isin(*L.EXCLUDED_TYPES) | (t == "")


def sane_comparable(pps: Column, cfg: ValuationConfig = ValuationConfig()) -> Column:
    """Price per m2 strictly inside the comparison range."""
    return (pps > cfg.pps_low) & (pps < cfg.pps_high)


def ingest_ok(size: Column, pps: Column) -> Column:
    return size.between(*INGEST_SIZE) & pps.between(*INGEST_PPS)


def ingest_price_ok(price: Column, size: Column) -> Column:
    return price.between(*INGEST_PRICE) & size.between(*INGEST_SIZE)


def above_sale_floor(price: Column) -> Column:
    return price >= SALE_FLOOR


def needs_district(city: str | None = None) -> Column:
    """Live rows without a district; a null type is dropped, as in SQL."""
    cond = (~F.col("is_expired")
            & (F.col("neighborhood").isNull() | (F.col("neighborhood") == ""))
            & ~F.col("property_type").isin(*L.EXCLUDED_TYPES))
    return cond & F.contains(F.col("city"), F.lit(city)) if city else cond


def bad_address() -> Column:
    """Live rows whose address is missing, or short without Cyrillic letters."""
    a = F.col("address")
    return (~F.col("is_expired") & ~F.col("property_type").isin(*L.EXCLUDED_TYPES)
            & (a.isNull() | (a == "") | ((F.length(a) < 5) & ~a.rlike("[А-Яа-я]"))))


def has_market() -> Column:
    """A deal with comparables and a market price."""
    return F.coalesce((F.col("comparables_count") > 0) & (F.col("market_price") != 0), F.lit(False))


def browse(now: Column, city: str = "all", min_price: float = 0, max_price: float | None = None,
           min_discount: int = 0, view: str = "all") -> Column:
    """Filter panel of the browse view."""
    price, disc = F.col("effective_price"), F.coalesce(F.col("discount"), F.lit(0.0))
    days = time.days_until("auction_end", now)
    cond = price >= min_price
    if city != "all":
        cond &= F.col("city") == city
    if max_price is not None:
        cond &= price <= max_price
    if min_discount > 0:
        cond &= has_market() & (disc >= min_discount)
    if view == "new":
        cond &= time.is_new(days)
    elif view == "ending":
        cond &= time.is_ending(days)
    elif view == "best":
        cond &= has_market() & (disc >= 40)
    elif view == "sofia":
        cond &= F.contains(F.col("city"), F.lit("София"))
    return F.coalesce(cond, F.lit(False))


def loadable() -> Column:
    return (F.col("effective_price") > 0) & (F.col("sqm") > 0)


def candidate_window(cities: list[str] | None = None, cfg: AppraisalConfig = AppraisalConfig(),
                     inclusive: bool = True) -> Column:
    """Price window and target towns of the older method."""
    p = F.col("price_eur")
    cond = p.between(cfg.min_price, cfg.max_price) if inclusive else \
        (p > cfg.min_price) & (p < cfg.max_price)
    return cond & text.normal_city("city").isin(*cities) if cities else cond


def residential() -> Column:
    """Keeps flats and unknown types, drops clearly other ones."""
    t = F.lower(F.coalesce(F.col("property_type"), F.lit("")))
    flat = F.contains(t, F.lit("стаен")) | F.contains(t, F.lit("apartment")) | F.coalesce(F.col("rooms") > 0, F.lit(False))
    other = F.lit(False)
    for w in ("land", "парцел", "гараж", "garage", "офис", "магазин"):
        other = other | F.contains(t, F.lit(w))
    return F.when(flat, True).when(other, False).otherwise(True)


def sale_listing() -> Column:
    """Active sale adverts with at least one comparable field."""
    return (F.col("is_active") & F.col("listing_url").like("%-prodava-%")
            & (F.col("district").isNotNull() | F.col("area_sqm").isNotNull() | F.col("price_eur").isNotNull()))


def transaction_is(kind: str) -> Column:
    return F.lit(True) if kind == "all" else F.col("transaction_type") == kind


def reportable(score: Column, minimum: int) -> Column:
    """Score threshold; an unscored row counts as zero."""
    return F.coalesce(score, F.lit(0)) >= minimum
