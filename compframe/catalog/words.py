"""Queries of the text, date and price functions, and of the district fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from compframe import lookups as L
from compframe.catalog import checks as C
from compframe.catalog import standin as S
from compframe.catalog.registry import query
from compframe.functions import price as P
from compframe.functions import text as T
from compframe.functions import time as D
from compframe.functions.core import once, round_exact
from compframe.operators import filters
from compframe.plans import districts as X

AUCTIONS = f"WITH {S.auctions_sql()}"
END = C.date_sql("auction_end")


def auctions(spark, sf):
    return S.auctions(spark, sf)


@query("normalize_hood", f"{AUCTIONS}, {C.norm_cte('n', 'SELECT neighborhood AS h FROM auctions')} SELECT a.id, n.norm AS hood, n.h AS raw FROM auctions a LEFT JOIN n ON n.h = a.neighborhood")
def normalize_hood(spark, sf):
    """Normalised districts."""
    return auctions(spark, sf).select("id", T.normalize_hood("neighborhood").alias("hood"), F.col("neighborhood").alias("raw"))


@query("simple_hood", f"{AUCTIONS} SELECT id, lower(trim(regexp_replace(neighborhood, '^(кв\\.|жк\\.|ж\\.к\\.|квартал|жилищен комплекс)\\s*', ''))) AS hood, "
       f"{C.title_sql('neighborhood')} AS title FROM auctions")
def simple_hood(spark, sf):
    """Simple normalisation and title form."""
    return auctions(spark, sf).select("id", T.simple_hood("neighborhood").alias("hood"), T.title_hood("neighborhood").alias("title"))


@query("extract_hood", f"{AUCTIONS}, {C.address_hood_cte('h', chr(83) + 'ELECT address AS a FROM auctions')} SELECT x.id, h.hood FROM auctions x LEFT JOIN h ON h.a = x.address")
def extract_hood(spark, sf):
    """Districts named by addresses."""
    return auctions(spark, sf).select("id", T.extract_hood("address").alias("hood"))


PAIRS = f"{AUCTIONS}, {C.norm_cte('n', 'SELECT neighborhood AS h FROM auctions')}"


@query("hood_similarity", f"{PAIRS}, p AS (SELECT DISTINCT a.neighborhood AS l, b.neighborhood AS r FROM auctions a JOIN auctions b ON b.id = a.id + 1) "
       f"SELECT p.l, p.r, {C.similarity_case('x.norm', 'y.norm')} AS similarity FROM p LEFT JOIN n x ON x.h = p.l LEFT JOIN n y ON y.h = p.r")
def hood_similarity(spark, sf):
    """Likeness of the districts of neighbouring auctions."""
    a = auctions(spark, sf)
    nxt = a.select((F.col("id") - 1).alias("id"), F.col("neighborhood").alias("r"))
    pairs = a.select("id", F.col("neighborhood").alias("l")).join(nxt, "id").select("l", "r").distinct()
    return pairs.select("l", "r", T.hood_similarity("l", "r").alias("similarity"))


@query("hood_by_slug", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 4 WHEN 0 THEN 'левски' WHEN 1 THEN 'кръстова вада' WHEN 2 THEN 'nova zora' END AS hood FROM part")
def hood_by_slug(spark, sf):
    """Districts named by URL slugs."""
    slug = S.pick("p_partkey % 4", ["grad-varna-a-levski-ul-x", "grad-ruse-x-krastova-vada-12", "grad-vidin-x-nova-zora-bl-5", "grad-ruse-x-9-ul"])
    return S.table(spark, sf, "part").selectExpr("CAST(p_partkey AS BIGINT) AS id", f"'obiava-' || ({slug}) AS u").select(
        "id", T.url_segment_hood("u").alias("hood"))


@query("type_bands", f"{AUCTIONS} SELECT id, {C.CATEGORY} AS category, CAST({C.BAND_LO} AS DOUBLE) AS lo, CAST({C.BAND_HI} AS DOUBLE) AS hi, "
       f"coalesce(property_type IN ({C.quoted(L.COMPARABLE_TYPES)}), false) AS comparable, coalesce(trim(property_type), '') IN ('', {C.quoted(L.EXCLUDED_TYPES)}) AS excluded FROM auctions")
def type_bands(spark, sf):
    """Category, size band and exclusion of types."""
    t = F.col("property_type")
    band = P.room_band(t)
    return auctions(spark, sf).select(
        "id", P.type_category(t).alias("category"), band["lo"].alias("lo"), band["hi"].alias("hi"),
        F.coalesce(P.is_comparable_type(t), F.lit(False)).alias("comparable"), filters.excluded_type(t).alias("excluded"))


@query("auction_dates", f"{AUCTIONS} SELECT id, CAST(CAST({END} AS DATE) AS VARCHAR) AS ends, coalesce({END} < {C.NOW}, false) AS expired, "
       f"CAST(ceil((epoch_us({END}) - epoch_us({C.NOW})) / 86400000000.0) AS INTEGER) AS days FROM auctions")
def auction_dates(spark, sf):
    """Parsed end dates, expiry, days left."""
    return auctions(spark, sf).select(
        "id", D.parse_date("auction_end").cast("string").alias("ends"), D.is_expired("auction_end", S.now()).alias("expired"),
        D.days_until("auction_end", S.now()).alias("days"))


@query("euro_prices", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE {C.py_round('o_totalprice / 1.96::DOUBLE', 2)} END AS live, "
       f"CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE {C.py_round('o_totalprice / 1.95583::DOUBLE', 2)} END AS official, "
       f"{C.py_round('o_totalprice / (o_custkey % 90 + 20)', 2)} AS pps FROM orders")
def euro_prices(spark, sf):
    """Currency change and price per m2."""
    cur = F.when(F.col("o_orderkey") % 2 == 0, "EUR").otherwise("BGN")
    return S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), P.to_eur("o_totalprice", cur).alias("live"),
        P.to_eur("o_totalprice", cur, 1.95583).alias("official"),
        P.price_per_sqm("o_totalprice", (F.col("o_custkey") % 90 + 20).cast("double")).alias("pps"))


@query("clean_numbers", "SELECT o_orderkey AS id, o_totalprice AS spaced, o_totalprice AS first, floor(o_totalprice) AS thousands FROM orders")
def clean_numbers(spark, sf):
    """Numbers read back from text forms."""
    plain = F.format_number("o_totalprice", 2)
    spaced = F.concat(F.translate(plain, ",.", " ,"), F.lit(" лв."))
    rows = S.table(spark, sf, "orders")
    return rows.select(F.col("o_orderkey").alias("id"),
                       T.clean_number(F.regexp_replace(spaced, r" лв\.$", " лв")).alias("spaced"),
                       T.leading_number(F.concat(F.lit("цена "), F.translate(plain, ",", " "))).alias("first"),
                       T.thousands_number(F.format_number(F.floor("o_totalprice"), 0)).alias("thousands"))


@query("valuation_columns", f"WITH v AS (SELECT o_orderkey AS id, o_totalprice AS price, CAST(o_custkey % 90 + 20 AS DOUBLE) AS size, CAST(o_orderkey % 4000 + 500 AS DOUBLE) + 0.37::DOUBLE AS med FROM orders), "
       f"d AS (SELECT *, {C.py_round('(med - price / size) / med * 100', 1)} AS d0 FROM v), e AS (SELECT *, CASE WHEN d0 >= 0 THEN d0 END AS discount FROM d) "
       "SELECT id, round_even(med, 0) AS market_avg, discount, round_even(round_even(med, 0) * size, 0) AS market_price, round_even(round_even(med, 0) * size - price, 0) AS savings, "
       "CAST(CASE WHEN id % 10 = 0 THEN 0 WHEN discount >= 40 THEN 5 WHEN discount >= 30 THEN 4 WHEN discount >= 20 THEN 3 WHEN discount >= 10 THEN 2 WHEN discount <> 0 THEN 1 ELSE 0 END AS INTEGER) AS score FROM e")
def valuation_columns(spark, sf):
    """Discount, market price, savings, score of given medians."""
    rows = S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 90 + 20).cast("double").alias("size"),
        ((F.col("o_orderkey") % 4000 + 500).cast("double") + F.lit(0.37)).alias("med"))
    avg, disc = round_exact(F.col("med")), P.discount_pct(F.col("price"), F.col("size"), F.col("med"))
    return rows.select("id", avg.alias("market_avg"), disc.alias("discount"), round_exact(avg * F.col("size")).alias("market_price"),
                       round_exact(avg * F.col("size") - F.col("price")).alias("savings"),
                       P.score5(disc, F.col("id") % 10 == 0).alias("score"))


QUERY = ("CASE WHEN length(address) >= 4 AND NOT regexp_matches(address, '\\d+\\s*часа') AND regexp_matches(address, '[А-Яа-я]') "
         "THEN address || ', ' || trim(regexp_replace(city, '^(гр\\.|с\\.)\\s*', '')) || ', България' END")


@query("geocode_query", f"{AUCTIONS} SELECT id, {QUERY} AS query FROM auctions")
def geocode_query(spark, sf):
    """Query text of an address."""
    return auctions(spark, sf).select("id", T.geocode_query("address", "city").alias("query"))


@query("bad_address", f"{AUCTIONS} SELECT id FROM auctions WHERE NOT is_expired AND property_type NOT IN ({C.quoted(L.EXCLUDED_TYPES)}) "
       "AND (address IS NULL OR address = '' OR (length(address) < 5 AND NOT regexp_matches(address, '[А-Яа-я]')))")
def bad_address(spark, sf):
    """Auctions whose address must be read again."""
    return auctions(spark, sf).where(filters.bad_address()).select("id")


GAZETTEER = [
    "query", "CASE WHEN k % 4 = 1 THEN 'жк Тракия' WHEN k % 4 = 3 THEN 'Аа' END AS suburb",
    "CASE WHEN k % 4 = 2 THEN 'кв. Изток 2' END AS quarter", "CASE WHEN k % 8 = 7 THEN 'Малинова долина' END AS neighbourhood",
    "CASE WHEN k % 4 = 1 THEN 'район Подуяне' END AS city_district",
]
NEED = (f"need AS (SELECT * FROM auctions WHERE NOT is_expired AND coalesce(neighborhood, '') = '' AND property_type NOT IN ({C.quoted(L.EXCLUDED_TYPES)}))")
FILLED = (
    f"{AUCTIONS}, {NEED}, " + C.address_hood_cte("h1", "SELECT address AS a FROM need") + ", "
    + C.address_hood_cte("h2", "SELECT city || ', ' || address AS a FROM need") + ", "
    f"places AS (SELECT DISTINCT {QUERY} AS query, length(address) + length(city) AS k FROM auctions WHERE address IS NOT NULL), "
    f"gaz AS (SELECT {', '.join(GAZETTEER)} FROM places), "
    + C.norm_cte("gn", "SELECT unnest([suburb, quarter, neighbourhood, city_district]) AS h FROM gaz") + ", "
    "g AS (SELECT query, coalesce(" + ", ".join(f"(SELECT CASE WHEN length(norm) > 2 THEN norm END FROM gn WHERE gn.h = gaz.{f})" for f in L.GAZETTEER_FIELDS) + ") AS hood FROM gaz), "
    f"r AS (SELECT n.id, n.address, coalesce(CASE WHEN length(h1.hood) > 2 THEN h1.hood END, CASE WHEN length(h2.hood) > 2 THEN h2.hood END) AS txt, g.hood AS geo FROM need n "
    f"LEFT JOIN h1 ON h1.a = n.address LEFT JOIN h2 ON h2.a = n.city || ', ' || n.address LEFT JOIN g ON g.query = ({QUERY.replace('address', 'n.address').replace('city,', 'n.city,')})), "
    "filled AS (SELECT id, coalesce(txt, geo) AS neighborhood, CASE WHEN coalesce(length(address), 0) < 4 THEN 'no_address' WHEN txt IS NOT NULL THEN 'text' WHEN geo IS NOT NULL THEN 'gazetteer' ELSE 'none' END AS method FROM r)"
)


def filled(spark, sf):
    rows = auctions(spark, sf)
    named = rows.where(F.col("address").isNotNull()).select("address", "city").distinct()
    places = once(named, [], T.geocode_query("address", "city").alias("query"), (F.length("address") + F.length("city")).alias("k")).distinct()
    return X.fill_districts(rows, places.selectExpr(*GAZETTEER))


@query("fill_districts", f"{FILLED} SELECT id, neighborhood, method FROM filled")
def fill_districts(spark, sf):
    """Districts found for auctions without one."""
    return filled(spark, sf).select("id", "neighborhood", "method")


@query("district_outcomes", f"{FILLED} SELECT method, count(*) AS n FROM filled GROUP BY method")
def district_outcomes(spark, sf):
    """Outcome counts of the fill."""
    return X.outcome_counts(filled(spark, sf))


@query("filled_coverage", f"{FILLED} SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(f.neighborhood, a.neighborhood, '') <> '') AS known FROM auctions a LEFT JOIN filled f ON f.id = a.id WHERE NOT a.is_expired")
def filled_coverage(spark, sf):
    """Coverage once the found districts are written in (A10)."""
    rows = X.apply_districts(auctions(spark, sf), filled(spark, sf)).where(~F.col("is_expired"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.coalesce("neighborhood", F.lit("")) != "").alias("known"))
