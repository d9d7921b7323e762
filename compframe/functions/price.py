"""Prices, discounts, scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from compframe import lookups as L
from compframe.config import RATE_LIVE
from compframe.functions.core import as_col, let, lookup, round_exact


def to_eur(amount: Column | str, currency: Column | str, rate: float = RATE_LIVE) -> Column:
    """Amount in euro; any currency but EUR is taken as leva."""
    a = as_col(amount)
    return F.when(as_col(currency) == "EUR", a).otherwise(round_exact(a / F.lit(rate), 2))


def price_per_sqm(price: Column | str, size: Column | str) -> Column:
    """Price per m2 to the cent, null for a zero size."""
    return round_exact(as_col(price) / F.nullif(as_col(size), F.lit(0.0)), 2)


def discount_pct(price: Column, size: Column, median: Column) -> Column:
    """Discount to the unrounded median, one decimal; null when negative."""
    d = round_exact((median - price / size) / median * 100, 1)
    return let(d, lambda x: F.when(x >= 0, x))


def score5(discount: Column, partial: Column) -> Column:
    """Deal score 0..5."""
    return (
        F.when(partial, 0)
        .when(discount >= 40, 5).when(discount >= 30, 4)
        .when(discount >= 20, 3).when(discount >= 10, 2)
        .when(discount != 0, 1).otherwise(0)
    )


def rating(pct: Column) -> Column:
    """Rating of the browse view as a struct (level, label, score, stars)."""
    def row(level: str, label: str, score: int, stars: int) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(label).alias("label"),
                        F.lit(score).alias("score"), F.lit(stars).alias("stars"))

    out = F.when(pct < 0, row(*L.RATING_BAD))
    for bound, *values in L.RATINGS:
        out = out.when(pct >= bound, row(*values))
    return out.otherwise(row(*L.RATING_LOW))


def deal_score(discount: Column, comparables: Column, minimum: int = 3) -> Column:
    """Score 0..5 of the older method; null with too few comparables."""
    scale = (
        F.when(discount > 35, 5).when(discount > 25, 4).when(discount > 15, 3)
        .when(discount > 5, 2).when(discount > -5, 1).otherwise(0)
    )
    return F.when(comparables >= minimum, scale)


def verdict(score: Column) -> Column:
    return lookup(score.cast("string"), {str(k): v for k, v in L.VERDICTS.items()})


def confidence(comparables: Column, same_hood: Column, minimum: int = 3) -> Column:
    return (
        F.when(comparables < minimum, "low")
        .when((comparables >= 10) & (same_hood >= 3), "high")
        .when(comparables >= 5, "medium").otherwise("low")
    )


def best_rank(discount: Column, savings: Column) -> Column:
    """Sort key of the "best" order."""
    return F.coalesce(discount, F.lit(0.0)) * F.log(F.greatest(F.lit(0.0), savings.cast("double")) + 1)


def price_bar(price: Column, market_price: Column) -> Column:
    """Position of the price bar, 10..90; 50 without a market price."""
    pct = price / F.nullif(market_price.cast("double"), F.lit(0.0)) * 100
    return F.when(pct.isNull(), 50.0).otherwise(F.greatest(F.lit(10.0), F.least(F.lit(90.0), pct)))


def relative_delta(a: Column, b: Column) -> Column:
    """|a-b| over the larger; null where either is missing or zero."""
    known = (a != 0) & (b != 0)
    return F.when(known, F.abs(a - b) / F.greatest(a, b))


def type_category(c: Column | str) -> Column:
    return F.coalesce(lookup(as_col(c), L.TYPE_CATEGORIES), F.lit("other"))


def is_comparable_type(c: Column | str) -> Column:
    return as_col(c).isin(*L.COMPARABLE_TYPES)


def room_band(c: Column | str) -> Column:
    """Size band of the first room word in the type: struct (lo, hi), null without one."""
    t = F.lower(as_col(c))
    out = None
    for word, lo, hi in L.ROOM_BANDS:
        band = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        out = F.when(F.contains(t, F.lit(word)), band) if out is None else \
            out.when(F.contains(t, F.lit(word)), band)
    return out


def rooms_by_slug(url: Column | str) -> Column:
    u = F.lower(as_col(url))
    out = None
    for word, n in L.ROOMS_BY_SLUG:
        out = F.when(F.contains(u, F.lit(word)), n) if out is None else out.when(F.contains(u, F.lit(word)), n)
    return out


def rooms_by_word(c: Column | str) -> Column:
    c = as_col(c)
    out = None
    for word, n in L.ROOMS_BY_WORD:
        out = F.when(F.contains(c, F.lit(word)), n) if out is None else out.when(F.contains(c, F.lit(word)), n)
    return out


def rooms_by_digit_or_word(c: Column | str) -> Column:
    """Rooms of the first mention: its digit, else the first room word in the text."""
    c = as_col(c)
    words = "|".join(w for w, _ in L.ROOMS_BY_WORD)
    hit = F.regexp_extract(c, rf"(?iU)(\d-?стаен|\d-?стаи|{words})", 1)
    digit = F.regexp_extract(hit, r"^(\d)", 1).try_cast("int")
    return F.when(hit != "", F.coalesce(digit, rooms_by_word(c)))


def rooms_label(rooms: Column) -> Column:
    """Room count to type label."""
    return (F.when(rooms == 1, "1-стаен").when(rooms == 2, "2-стаен").when(rooms == 3, "3-стаен")
            .when(rooms >= 4, "4+-стаен"))


def offer_type(c: Column | str) -> Column:
    """Type word to type label; an unknown word in lower case."""
    t = F.lower(as_col(c))
    return F.coalesce(lookup(t, L.OFFER_TYPES), t)


