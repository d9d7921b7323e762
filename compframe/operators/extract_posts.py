"""Free text to fields: descriptions of auctions and social posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe import lookups as L
from compframe.functions import text as T
from compframe.functions.core import contains_any, first_listed, group, let, string_array
from compframe.operators.ranking import keep_first, newest

MIN_POST_LENGTH = 50
# Number forms in posts.
POST_PRICES = [(r"(\d[\d\s,.]*)\s*(лв|лева|bgn)", 1, "BGN"), (r"(\d[\d\s,.]*)\s*(евро|euro|eur|€)", 1, "EUR"),
               (r"(€|EUR)\s*(\d[\d\s,.]*)", 2, "EUR")]
POST_PHONES = [r"(\+359|0)[\s.-]?(\d{2,3})[\s.-]?(\d{3})[\s.-]?(\d{3,4})", r"(\d{3})[\s.-]?(\d{3})[\s.-]?(\d{3,4})"]
POST_SIZES = [r"(\d+)\s*(?:кв\.?м|квм|m2|м2|sqm)", r"(\d+)\s*(?:sq\.?\s*m)"]
DESCRIPTION_SIZE = r"(\d+(?:[.,]\d+)?)\s*(?:кв\.?\s*м|m2|м2|sqm)"
DESCRIPTION_FLOORS = [r"(\d+)[\s-]?(?:ти|ри|ви)?\s*етаж", r"етаж[\s:]*(\d+)"]


def first_contained(c: Column, words: list[str]) -> Column:
    """First word of an ordered list that the text contains."""
    return let(c, lambda v: F.get(F.filter(string_array(words), lambda w: F.contains(v, w)), F.lit(0)))


def enrich_description(c: Column) -> Column:
    """Type, rooms, size, floor, construction and district of a description, as a struct."""
    return let(c, _description_fields)


def _description_fields(c: Column) -> Column:
    low = F.lower(c)
    rooms = None
    for pattern, n in L.DESCRIPTION_ROOMS:
        hit = c.rlike(f"(?iU){pattern}")
        rooms = F.when(hit, n) if rooms is None else rooms.when(hit, n)
    kind = F.when(rooms.isNotNull(), "apartment").otherwise(first_listed(low, L.DESCRIPTION_TYPES))
    size = F.replace(group(c, DESCRIPTION_SIZE, flags="iU"), F.lit(","), F.lit(".")).try_cast("double")
    floor = F.coalesce(*[group(c, p, flags="iU").try_cast("int") for p in DESCRIPTION_FLOORS])
    return F.struct(
        kind.alias("property_type"), rooms.alias("rooms"), size.alias("size_sqm"), floor.alias("floor"),
        first_listed(low, L.DESCRIPTION_CONSTRUCTION).alias("construction"),
        first_contained(low, L.DESCRIPTION_HOODS).alias("neighborhood"))


def keyword_classes(c: Column) -> dict[str, Column]:
    """One boolean per keyword class: at most one hit counts for each."""
    low = F.lower(c)
    return {name: contains_any(low, [w.lower() for w in words]) for name, words in L.POST_KEYWORDS.items()}


def is_property_post(c: Column, min_length: int = MIN_POST_LENGTH) -> Column:
    """Long enough, two classes or more, one of them transaction or type."""
    hit = keyword_classes(c)
    total = sum((h.cast("int") for h in hit.values()), F.lit(0))
    return (F.length(c) >= min_length) & (total >= 2) & (hit["transaction"] | hit["propertyType"])


def post_price(c: Column, compat: bool = True) -> Column:
    """First plausible price as a struct (amount, currency).

    ``compat`` keeps two quirks of the published rule: a sign before the number gives no price, since
    the sign is read as the number, and "лева" counts as euro, since only "лв" and "bgn" are leva.
    """
    def option(pattern: str, idx: int, currency: str) -> Column:
        raw = F.regexp_replace(group(c, pattern, idx, "iU"), r"(?U)\s", "")
        raw = F.regexp_replace(raw, r"^([^,]*),", "$1")
        number = F.regexp_extract(raw, r"^(\d*\.?\d*)", 1).try_cast("double")
        named = F.lit(currency)
        if compat and currency == "BGN":
            named = F.when(F.lower(group(c, pattern, 2, "iU")) == "лева", "EUR").otherwise(currency)
        return let(number, lambda n: F.when((n > 100) & (n < 10000000), F.struct(
            n.alias("amount"), named.alias("currency"))))

    return F.coalesce(*[option(*p) for p in POST_PRICES if not (compat and p[1] == 2)])


def post_location(c: Column) -> Column:
    """Known district (of the capital), else known town, as a struct (city, neighborhood)."""
    low = F.lower(c)
    hood, town = first_contained(low, L.POST_HOODS), first_contained(low, L.POST_CITIES)
    return (F.when(hood.isNotNull(), F.struct(F.lit("София").alias("city"), hood.alias("neighborhood")))
            .when(town.isNotNull(), F.struct(town.alias("city"), F.lit(None).cast("string").alias("neighborhood"))))


def post_type(c: Column) -> Column:
    return F.coalesce(first_listed(F.lower(c), L.POST_TYPES), F.lit(L.POST_TYPE_DEFAULT))


def post_transaction(c: Column) -> Column:
    kinds = [(pattern.split("|"), kind) for pattern, kind in L.POST_TRANSACTIONS]
    return F.coalesce(first_listed(F.lower(c), kinds), F.lit("unknown"))


def post_phones(c: Column) -> Column:
    """All matches of both phone forms, separators removed, repeats kept; null without any."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(f"(?U){p}"), F.lit(0)) for p in POST_PHONES])
    clean = F.transform(found, lambda p: F.regexp_replace(p, r"(?U)[\s.-]", ""))
    return F.when(F.size(clean) > 0, clean)


def post_size(c: Column) -> Column:
    """First plausible size in m2."""
    options = [let(group(c, p, flags="iU").try_cast("int"), lambda n: F.when((n > 10) & (n < 5000), n))
               for p in POST_SIZES]
    return F.coalesce(*options)


def classify_posts(posts: DataFrame) -> DataFrame:
    """Property posts with their fields; other posts are left out.

    The test comes first and the fields are plain columns, so that a reader of some of them pays for those only.
    """
    t = F.col("text")
    return posts.where(is_property_post(t)).withColumns({
        "price": post_price(t), "location": post_location(t), "property_type": post_type(t),
        "transaction_type": post_transaction(t), "contact": post_phones(t), "size": post_size(t)})


def stored_posts(posts: DataFrame, k: int | None = None) -> DataFrame:
    """The whole job: classify, name by link or text, keep the newest of each id, newest first.

    ``posts`` has link, text and ts. All are kept unless ``k`` says how many.
    """
    named = classify_posts(posts).withColumn("id", T.post_id(F.col("link"), F.col("text")))
    once = keep_first(named, ["id"], [F.col("ts").desc(), F.col("text").asc()])
    return once.orderBy(F.col("ts").desc(), F.col("id").asc()) if k is None else newest(once, k)
