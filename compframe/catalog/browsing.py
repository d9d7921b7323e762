"""Queries of the browse view and of subscriber alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from compframe import lookups as L
from compframe.catalog import checks as C
from compframe.catalog import standin as S
from compframe.catalog.registry import query
from compframe.functions import price as P
from compframe.functions import text as T
from compframe.plans import alerts as A
from compframe.plans import browse as B

DEALS = S.deals_sql()
D0 = "coalesce(discount, 0.0)"
HAS = "coalesce(comparables_count > 0 AND market_price <> 0, false)"
END = C.date_sql("auction_end")
DAYS = f"CAST(ceil((epoch_us({END}) - epoch_us({C.NOW})) / 86400000000.0) AS INTEGER)"
LOAD = f"CASE WHEN {HAS} THEN 0 ELSE 1 END, CASE WHEN {HAS} THEN {D0} END DESC NULLS LAST, CASE WHEN NOT {HAS} THEN price END NULLS FIRST, id"
SHOW = "id, city, price, market_price, discount, auction_end"
COLS = ["id", "city", "price", "market_price", "discount", "auction_end"]
BASE = f"WITH {DEALS}, shown AS (SELECT * FROM deals WHERE effective_price > 0 AND sqm > 0)"


def deals(spark, sf):
    return S.deals(spark, sf)


@query("browse_best", f"{BASE} SELECT {SHOW} FROM shown WHERE {HAS} AND {D0} >= 40")
def browse_best(spark, sf):
    return B.browse(deals(spark, sf), S.now(), "best", view="best").select(*COLS)


@query("browse_ending", f"{BASE} SELECT {SHOW} FROM shown WHERE coalesce({DAYS} <= 7, false)")
def browse_ending(spark, sf):
    return B.browse(deals(spark, sf), S.now(), "ending", view="ending").select(*COLS)


@query("browse_new", f"{BASE} SELECT {SHOW} FROM shown WHERE coalesce({DAYS} > 20, false) AND effective_price BETWEEN 20000 AND 150000 "
       f"AND {HAS} AND {D0} >= 20")
def browse_new(spark, sf):
    return B.browse(deals(spark, sf), S.now(), "newest", view="new", min_price=20000, max_price=150000,
                    min_discount=20).select(*COLS)


@query("browse_one_city", f"{BASE} SELECT {SHOW} FROM shown WHERE contains(city, 'София')")
def browse_one_city(spark, sf):
    return B.browse(deals(spark, sf), S.now(), "price_desc", view="sofia").select(*COLS)


def page_check(order: str, no: int, where: str = "true") -> str:
    return (f"{BASE} SELECT {SHOW} FROM (SELECT *, row_number() OVER (ORDER BY {order}, {LOAD}) AS rn FROM shown WHERE {where}) "
            f"WHERE rn > {12 * (no - 1)} AND rn <= {12 * no}")


@query("browse_page_best", page_check(
    f"{D0} * ln(greatest(0.0::DOUBLE, coalesce(savings_eur, 0)::DOUBLE) + 1) DESC", 3))
def browse_page_best(spark, sf):
    return B.browse(deals(spark, sf), S.now(), "best", page=3).select(*COLS)


@query("browse_page_ending", page_check(f"{END} NULLS LAST", 2))
def browse_page_ending(spark, sf):
    return B.browse(deals(spark, sf), S.now(), "ending", page=2).select(*COLS)


@query("browse_page_newest", page_check(f"{END} DESC NULLS LAST", 1, "city = 'Варна'"))
def browse_page_newest(spark, sf):
    return B.browse(deals(spark, sf), S.now(), "newest", page=1, city="Варна").select(*COLS)


@query("browse_page_price", page_check("effective_price", 2))
def browse_page_price(spark, sf):
    return B.browse(deals(spark, sf), S.now(), "price_asc", page=2).select(*COLS)


RATING_ARMS = " ".join(f"WHEN {D0} >= {b} THEN '{lv}|{sc}|{st}'" for b, lv, _, sc, st in L.RATINGS)
LEFT_S = f"((epoch_us({END}) - epoch_us({C.NOW})) / 1000000.0)"


@query("browse_cards", f"{BASE} SELECT id, CASE WHEN {D0} < 0 THEN 'bad|20|1' {RATING_ARMS} ELSE 'low|40|1' END AS rating, "
       f"{DAYS} AS days, coalesce({DAYS} > 20, false) AS is_new, coalesce({DAYS} BETWEEN 0 AND 5, false) AS is_urgent, "
       f"CASE WHEN {END} IS NULL THEN 'Неизвестна' WHEN {LEFT_S} <= 0 THEN 'Приключи' "
       f"WHEN floor({LEFT_S} / 86400) > 0 THEN CAST(floor({LEFT_S} / 86400) AS BIGINT) || 'д ' || CAST(floor(({LEFT_S} % 86400) / 3600) AS BIGINT) || 'ч' "
       f"WHEN floor({LEFT_S} / 3600) > 0 THEN CAST(floor({LEFT_S} / 3600) AS BIGINT) || 'ч ' || CAST(floor(({LEFT_S} % 3600) / 60) AS BIGINT) || 'м' "
       f"ELSE CAST(floor({LEFT_S} / 60) AS BIGINT) || ' мин' END AS time_left, "
       f"coalesce({LEFT_S} > 0 AND floor({LEFT_S} / 86400) < 3, false) AS closing, "
       f"CASE WHEN {HAS} THEN greatest(10.0::DOUBLE, least(90.0::DOUBLE, effective_price::DOUBLE / market_price::DOUBLE * 100)) ELSE 50.0::DOUBLE END AS bar FROM shown")
def browse_cards(spark, sf):
    """Card columns."""
    cards = B.card_columns(B.load_view(deals(spark, sf)), S.now())
    rating = F.concat_ws("|", "rating.level", F.col("rating.score").cast("string"), F.col("rating.stars").cast("string"))
    return cards.select("id", rating.alias("rating"), "days", "is_new", "is_urgent",
                        F.col("left.text").alias("time_left"), F.col("left.urgent").alias("closing"), "bar")


@query("headline", f"WITH {DEALS} SELECT count(*) AS deals, CAST(floor(coalesce(avg(CASE WHEN discount > 0 THEN discount END), 0) + 0.5) AS BIGINT) AS avg_discount, "
       f"CAST(floor(max({D0}) + 0.5) AS BIGINT) AS best_discount FROM deals")
def headline(spark, sf):
    return B.headline(deals(spark, sf))


CITY_AVG = "CAST(floor(coalesce(avg(CASE WHEN discount > 0 THEN discount END), 0) + 0.5) AS BIGINT) AS avg_discount"


@query("city_stats", f"WITH {DEALS} SELECT city, count(*) AS deals, {CITY_AVG} FROM deals GROUP BY city")
def city_stats(spark, sf):
    return B.city_stats(deals(spark, sf))


@query("city_page", f"WITH {DEALS} SELECT 'Загора' AS page, count(*) AS deals, {CITY_AVG} FROM deals WHERE contains(city, 'Загора')")
def city_page(spark, sf):
    return B.city_page(deals(spark, sf), "Загора", exact=False)


@query("city_options", f"WITH {DEALS} SELECT CAST(list_position([{C.quoted(L.MAJOR_CITIES)}], city) - 1 AS INTEGER) AS ord, city FROM "
       f"(SELECT DISTINCT city FROM deals WHERE city IN ({C.quoted(L.MAJOR_CITIES)}))")
def city_options(spark, sf):
    return B.city_options(deals(spark, sf))


SUBS = S.subscribers_sql()
LISTS = "coalesce(TRY_CAST(TRY_CAST(nullif({0}, '') AS JSON) AS VARCHAR[]), CAST([] AS VARCHAR[]))"
DEAL_ORDER = "discount DESC, price, CAST(deal_id AS BIGINT)"
MATCHES = (
    f"WITH {DEALS}, {SUBS}, subs AS (SELECT id, {LISTS.format('cities_json')} AS cities, "
    f"coalesce(nullif(min_discount, 0), 20) AS min_discount, {LISTS.format('last_deal_ids_json')} AS sent FROM subscribers WHERE verified), "
    "hits AS (SELECT s.id AS subscriber_id, d.id AS deal_id, d.discount, d.price FROM subs s JOIN deals d "
    "ON d.discount >= s.min_discount AND (len(s.cities) = 0 OR list_contains(s.cities, d.city)) AND NOT list_contains(s.sent, d.id)), "
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY {DEAL_ORDER}) AS rn FROM hits)"
)


@query("alert_match", f"{MATCHES} SELECT subscriber_id, deal_id, CAST(rn AS INTEGER) AS rank, discount FROM ranked WHERE rn <= 10")
def alert_match(spark, sf):
    """Deals per subscriber."""
    return A.match_alerts(deals(spark, sf), S.subscribers(spark, sf))


@query("alert_sent", f"{MATCHES}, run AS (SELECT subscriber_id, list(deal_id ORDER BY rn) AS ids FROM ranked WHERE rn <= 10 GROUP BY 1) "
       f"SELECT s.id, array_to_string(coalesce(r.ids, {LISTS.format('s.last_deal_ids_json')}), ',') AS ids, r.ids IS NOT NULL AS sent_now "
       "FROM subscribers s LEFT JOIN run r ON r.subscriber_id = s.id")
def alert_sent(spark, sf):
    """Sent ids after a run."""
    subs = S.subscribers(spark, sf)
    done = A.mark_sent(subs, A.match_alerts(deals(spark, sf), subs))
    return done.select("id", F.array_join(T.json_list("last_deal_ids_json"), ",").alias("ids"), "sent_now")


@query("clean_subscribers", f"WITH {SUBS} SELECT id, lower(trim(email)) AS email, "
       f"array_to_string(list_filter({LISTS.format('cities_json')}, lambda x: x IN ({C.quoted(L.SUBSCRIBER_CITIES)})), ',') AS cities, "
       "CASE WHEN TRY_CAST(threshold_text AS INTEGER) IS NULL THEN 20 ELSE greatest(10, least(70, TRY_CAST(threshold_text AS INTEGER))) END AS min_discount FROM subscribers")
def clean_subscribers(spark, sf):
    """Accepted subscription requests."""
    return A.clean_subscribers(S.subscribers(spark, sf)).withColumn("cities", F.array_join("cities", ","))


@query("verified_subscribers", f"WITH {SUBS} SELECT count(*) FILTER (WHERE verified) AS verified, count(*) AS total FROM subscribers")
def verified_subscribers(spark, sf):
    return S.subscribers(spark, sf).agg(F.count_if("verified").alias("verified"), F.count("*").alias("total"))


@query("best_rank", f"{BASE} SELECT id, round({D0} * ln(greatest(0.0::DOUBLE, coalesce(savings_eur, 0)::DOUBLE) + 1), 6) AS rank FROM shown")
def best_rank(spark, sf):
    rows = B.load_view(deals(spark, sf))
    return rows.select("id", F.round(P.best_rank(F.col("discount"), F.coalesce("savings_eur", F.lit(0))), 6).alias("rank"))


@query("top_discounted", f"WITH {DEALS} SELECT id, discount FROM deals WHERE discount > 0 ORDER BY discount DESC, price, CAST(id AS BIGINT) LIMIT 5")
def top_discounted(spark, sf):
    """Five best wholly owned deals."""
    from compframe.plans.export import top_discounted as top
    return top(deals(spark, sf)).select("id", "discount")
