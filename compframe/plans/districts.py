"""District fill for auctions without one: own text first, then an offline gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe import lookups as L
from compframe.functions import text as T
from compframe.functions.core import once
from compframe.operators import filters
from compframe.session import staged

MIN_ADDRESS = 4


def _usable(c: Column) -> Column:
    return F.when((F.length(c) > 2) & ~c.rlike(r"^\d+$"), c)


def hood_from_text(address: Column, city: Column) -> Column:
    """District named by the address alone, else by the address with its town in front."""
    with_city = F.when(F.coalesce(city, F.lit("")) != "", F.concat_ws(", ", city, address))
    return F.coalesce(_usable(T.extract_hood(address)), _usable(T.extract_hood(with_city)))


def hood_from_gazetteer() -> Column:
    """First gazetteer field that holds a district, from suburb down to city district."""
    names = F.transform(F.array(*[F.col(f) for f in L.GAZETTEER_FIELDS]), lambda x: T.normalize_hood(x))
    return F.get(F.filter(names, lambda n: F.length(n) > 2), F.lit(0))


def fill_districts(auctions: DataFrame, gazetteer: DataFrame, city: str | None = None) -> DataFrame:
    """Auctions that need a district, with the one found and how: text, gazetteer, none, no_address.

    ``gazetteer`` has one row per query text with the fields of ``GAZETTEER_FIELDS``.
    """
    rows = auctions.where(filters.needs_district(city)).select("id", "city", "address")
    has = F.coalesce(F.length("address") >= MIN_ADDRESS, F.lit(False))
    # an address costs far more to read than to shuffle, so each is read once, however many auctions give it
    texts = staged(once(rows.where(has).select("city", "address").distinct(), ["city", "address"], hood_from_text(F.col("address"), F.col("city")).alias("by_text"),
                        T.geocode_query("address", "city").alias("query")), "district-texts")
    # only texts that leave the district open go through the join
    found = texts.where("by_text IS NULL").join(gazetteer, "query", "left").select("city", "address", hood_from_gazetteer().alias("neighborhood"))
    found = found.withColumn("method", F.when(F.col("neighborhood").isNotNull(), "gazetteer").otherwise("none"))
    settled = texts.where("by_text IS NOT NULL").select("city", "address", F.col("by_text").alias("neighborhood"), F.lit("text").alias("method"))
    named = settled.unionByName(found).withColumnsRenamed({"city": "_city", "address": "_address"})
    same = (F.col("address") == F.col("_address")) & F.col("city").eqNullSafe(F.col("_city"))
    shown = ["id", "city", "address", "neighborhood", "method"]
    without = rows.where(~has).select("id", "city", "address", F.lit(None).cast("string").alias("neighborhood"), F.lit("no_address").alias("method"))
    return rows.where(has).join(named, same).select(*shown).unionByName(without)


def apply_districts(auctions: DataFrame, filled: DataFrame) -> DataFrame:
    """Auctions with the found districts written in."""
    new = filled.where(F.col("neighborhood").isNotNull()).select("id", F.col("neighborhood").alias("_found"))
    return auctions.join(new, "id", "left").withColumn(
        "neighborhood", F.coalesce("_found", "neighborhood")).drop("_found")


def outcome_counts(filled: DataFrame) -> DataFrame:
    """Rows per outcome of a district fill."""
    return filled.groupBy("method").agg(F.count("*").alias("n"))
