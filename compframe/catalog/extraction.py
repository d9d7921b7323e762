"""Queries of the extraction jobs.

Pages are rendered by Spark from the given tables, one page per row, in the forms the
extractors know. The check side reads the same rows directly: what was rendered must be
read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from compframe import lookups as L
from compframe.catalog import checks as C
from compframe.catalog import standin as S
from compframe.catalog.registry import query
from compframe.functions import text as T
from compframe.operators import extract_adverts as X
from compframe.operators import extract_auctions as A
from compframe.operators import extract_posts as W
from compframe.operators import markup as H
from compframe.session import spread

K = "p_partkey"
V = "AS VARCHAR(20))"


def text(x: str) -> str:
    return f"CAST({x} {V}"


def rendered(spark, sf, table: str, html: str, *extra: str):
    return spread(S.table(spark, sf, table)).selectExpr(*extra, f"{html} AS html").withColumn(
        "fetched_at", F.lit(S.NOW).cast("timestamp"))


# ---------------------------------------------------------------- given pages

@query("page_links", "SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS place, unnest(h) AS href FROM "
       "(SELECT page_id, regexp_extract_all(html, '<a [^>]*?href=\"([^\"]*)\"', 1) AS h FROM pages)")
def page_links(spark, sf):
    """All links of the stored pages in page order."""
    pages = S.table(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(H.all_matches(F.col("html"), r'<a [^>]*?href="([^"]*)"')).alias("place", "href"))


@query("page_title", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS h1, "
       "len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def page_title(spark, sf):
    h = F.col("html")
    return S.table(spark, sf, "pages").select(
        "page_id", F.nullif(F.regexp_extract(h, "<title>([^<]*)</title>", 1), F.lit("")).alias("title"),
        F.nullif(F.regexp_extract(h, "<h1>([^<]*)</h1>", 1), F.lit("")).alias("h1"),
        F.size(H.all_matches(h, "<p>", 0)).cast("bigint").alias("paragraphs"))


# the entities that the given pages hold, written out
UNESCAPED = "replace(replace(replace(replace(replace(replace(x, '&nbsp;', chr(160)), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&amp;', '&')"


@query("visible_text", "SELECT page_id, trim(regexp_replace(" + UNESCAPED + ", '\\s+', ' ', 'g')) AS body FROM (SELECT page_id, "
       "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages)")
def visible_text(spark, sf):
    """Visible text of the stored pages."""
    return S.table(spark, sf, "pages").select("page_id", T.visible_text("html").alias("body"))


# ---------------------------------------------------------------- auction pages

LIST_PAGE = ("'<ul><a href=\"/properties/' || " + text("o_orderkey") + " || '\">x</a><a href=\"/properties/' || " + text("o_orderkey + 1")
             + " || '\">y</a><a href=\"/properties/' || " + text("o_orderkey") + " || '\">z</a><a href=\"/other/7\">n</a></ul>'")


@query("extract_ids", "SELECT DISTINCT id FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT o_orderkey + 1 FROM orders)")
def extract_ids(spark, sf):
    """Ids of list pages, united over all pages."""
    return A.extract_ids(rendered(spark, sf, "orders", LIST_PAGE, "o_orderkey AS page_id"))


TYPES = ["Двустаен апартамент", "Къща с парцел", "Гараж", "Магазин"]
TYPE = S.pick(f"{K} % 4", TYPES)
PRICE = text(f"{K} % 900 + 100")
FLOOR = f"({K} % 28 + 1)"
DATE = S.DAY + " || '.' || " + S.MONTH + " || '.2024'"
FLOOR_TEXT = (
    f"CASE {K} % 6 WHEN 0 THEN '<span>Етаж\n ' || " + text(FLOOR) + f" || '</span>' WHEN 1 THEN '<div class=\"info\">бл. 3, ет. ' || " + text(FLOOR)
    + " || ', вх. А</div>' WHEN 2 THEN '<p>находящ се на ' || " + text(FLOOR) + " || ' /трети/ надземен етаж</p>' WHEN 3 THEN '<p>на ' || "
    + text(FLOOR) + " || '-ти етаж</p>' WHEN 4 THEN '<p>на 45-ти етаж</p>' ELSE '' END")
AUCTION_PAGE = (
    f"CASE WHEN {K} % 41 = 0 THEN '' ELSE '<form><ul><li>Парцел</li></ul>\n</div>' || CASE WHEN {K} % 3 = 0 THEN '' ELSE '' END || "
    f"CASE WHEN {K} % 5 = 4 THEN '<p>x</p>' ELSE '' END || '<div class=\"title\">' || ({TYPE}) || '</div>\n<div class=\"' || "
    f"CASE WHEN {K} % 5 = 4 THEN 'category' ELSE 'date' END || '\">x</div><div class=\"price\">' || {PRICE} || CASE WHEN {K} % 2 = 0 THEN '&nbsp;' ELSE ' ' END || '500' || "
    f"CASE WHEN {K} % 7 = 0 THEN '.50 лв' ELSE ' EUR' END || '</div>' || "
    f"'<div class=\"label\">Населено място</div><p>гр. ' || ({S.pick(f'{K} % {len(S.CITIES)}', S.CITIES)}) || '<br></p>' || "
    f"CASE WHEN {K} % 3 = 0 THEN '' ELSE '<div class=\"label\">Район</div><div class=\"info\"><b>' || ({S.HOOD_OF_PART}) || '</b></div>' END || "
    f"CASE WHEN {K} % 4 = 0 THEN '<div class=\"label\">Адрес</div>\n<div class=\"info\">---</div>' ELSE '<div class=\"label\"> Адрес </div>\n<div class=\"info\">бул. &quot;България&quot; <i>' || "
    + text(f"{K} % 90 + 1") + " || '</i></div>' END || '<p>площ ' || " + text("p_size + 20") + f" || CASE WHEN {K} % 2 = 0 THEN ',25 кв. м.' ELSE ' м2' END || '</p>' || {FLOOR_TEXT} || "
    f"CASE WHEN {K} % 3 = 1 THEN '<p>' || " + text(f"{K} % 5 + 1") + " || '-стаен</p>' ELSE '' END || "
    f"CASE {K} % 3 WHEN 0 THEN '<div>СРОК</div>\n<div>от 01.01.2024 до ' || {DATE} || '</div>' WHEN 1 THEN '<div>Край на търга: ' || {DATE} || '</div>' ELSE '' END || "
    f"CASE {K} % 9 WHEN 0 THEN '<p>1/4 ид. част</p>' WHEN 1 THEN '<p>Идеална  част</p>' WHEN 2 THEN '<p>½</p>' ELSE '' END END"
)
P_NUM = f"CAST(({K} % 900 + 100) * 1000 + 500 AS DOUBLE)"


@query("extract_auctions", f"SELECT CAST({K} AS BIGINT) AS id, CASE WHEN {K} % 7 = 0 THEN {C.py_round(f'({P_NUM} + 0.5) / 1.96', 2)} ELSE {P_NUM} END AS price_eur, "
       f"'гр. ' || ({S.pick(f'{K} % {len(S.CITIES)}', S.CITIES)}) AS city, CASE WHEN {K} % 3 <> 0 THEN lower({S.HOOD_OF_PART}) END AS neighborhood, "
       f"CASE WHEN {K} % 4 <> 0 THEN 'бул. \"България\" ' || {text(f'{K} % 90 + 1')} END AS address, {TYPE} AS property_type, "
       f"CASE WHEN {K} % 2 = 0 THEN p_size + 20.25::DOUBLE ELSE p_size + 20.0::DOUBLE END AS size_sqm, "
       f"CAST(CASE WHEN {K} % 3 = 1 THEN {K} % 5 + 1 END AS INTEGER) AS rooms, "
       f"CAST(CASE WHEN {K} % 6 <= 3 THEN {FLOOR} END AS INTEGER) AS floor, {K} % 9 <= 2 AS is_partial_ownership, "
       f"CASE WHEN {K} % 3 <= 1 THEN strptime({DATE}, '%d.%m.%Y') < {C.NOW} ELSE false END AS is_expired, CASE WHEN {K} % 3 <= 1 THEN {DATE} END AS auction_end FROM part WHERE {K} % 41 <> 0")
def extract_auctions(spark, sf):
    """Auction pages (P2 and its fields)."""
    pages = rendered(spark, sf, "part", AUCTION_PAGE, f"CAST({K} AS BIGINT) AS page_id")
    return A.extract_auctions(pages, S.now()).drop("url", "scraped_at")


CARD_PAGE = (
    "'<div class=\"top\">x</div><div class=\"property-card\"><a href=\"/properties/' || " + text("o_orderkey") + " || '\">виж</a>\nНачална цена: ' || "
    + text("o_orderkey % 900 + 5") + " || ' 100.00 EUR\nНАСЕЛЕНО МЯСТО: гр. Русе\nАдрес: ул. Шипка ' || " + text("o_orderkey % 60")
    + " || '\nОКРЪЖЕН СЪД: Видин\nЧАСТЕН СЪДЕБЕН ИЗПЪЛНИТЕЛ: М. Колева\nСРОК: от 09.02.2026 до 10.03.2026\nОБЯВЯВАНЕ НА 10.03.2026 09:00\n</div>"
    "<article>реклама</article><div class=\"property-card\"><a href=\"/properties/' || " + text("o_orderkey + 500000")
    + " || '\">виж</a>\nс. Баня, обл. X\n1 234,5 EUR\n</div>'")


@query("extract_auction_cards", "SELECT o_orderkey AS page_id, CAST(o_orderkey AS VARCHAR) AS id, CAST((o_orderkey % 900 + 5) * 1000 + 100 AS DOUBLE) AS price_eur, 'гр. Русе' AS city, "
       "'ул. Шипка ' || o_orderkey % 60 AS address, 'Видин' AS court, 'М. Колева' AS executor, '2026-02-09' AS bid_start, '2026-03-10' AS bid_end, '2026-03-10T09:00:00' AS announce_date, "
       f"'{L.AUCTION_URL}' || o_orderkey AS url FROM orders UNION ALL SELECT o_orderkey, CAST(o_orderkey + 500000 AS VARCHAR), 1234.5::DOUBLE, 'Баня', NULL, NULL, NULL, NULL, NULL, NULL, "
       f"'{L.AUCTION_URL}' || (o_orderkey + 500000) FROM orders")
def extract_auction_cards(spark, sf):
    """Cards of list pages."""
    return A.extract_auction_cards(rendered(spark, sf, "orders", CARD_PAGE, "o_orderkey AS page_id"))


BLOCK_PAGE = (
    "'<body>' || " + text("o_orderkey % 900 + 5") + " || ' 100.00 EUR /properties/' || " + text("o_orderkey")
    + " || '<p>гр. Русе, ОКРЪЖЕН СЪД: Видин\nот 09.02.2026 до 10.03.2026\nОБЯВЯВАНЕ НА 10.03.2026 09:00</p></body>'")


@query("extract_auction_blocks", "SELECT o_orderkey AS page_id, CAST(o_orderkey AS VARCHAR) AS id, CAST((o_orderkey % 900 + 5) * 1000 + 100 AS DOUBLE) AS price_eur, 'Русе' AS city, "
       f"'Видин' AS court, '2026-02-09' AS bid_start, '2026-03-10' AS bid_end, '2026-03-10T09:00:00' AS announce_date, '{L.AUCTION_URL}' || o_orderkey AS url FROM orders")
def extract_auction_blocks(spark, sf):
    """Fallback by text blocks."""
    return A.extract_auction_blocks(rendered(spark, sf, "orders", BLOCK_PAGE, "o_orderkey AS page_id"))


# ---------------------------------------------------------------- advert pages

INDEX_PAGE = (
    "'<a class=\"x\" href=\"/obiava-' || " + text(K) + " || '-prodava-dvustaen-apartament#photos\">a</a><a href=\"//www.imot.bg/obiava-' || " + text(K)
    + " || '-prodava-tristaen-apartament\">b</a><a href=\"/obiava-' || " + text(K) + " || '-prodava-dvustaen-apartament\">c</a><a href=\"/obiava-9-naem-apartament\">d</a>'")


@query("extract_index_links", f"SELECT CAST({K} AS BIGINT) AS page_id, CAST(0 AS INTEGER) AS place, 'https://www.imot.bg/obiava-' || {K} || '-prodava-dvustaen-apartament' AS url FROM part "
       f"UNION ALL SELECT {K}, 1, 'https://www.imot.bg/obiava-' || {K} || '-prodava-tristaen-apartament' FROM part")
def extract_index_links(spark, sf):
    """Links of index pages."""
    pages = rendered(spark, sf, "part", INDEX_PAGE, f"CAST({K} AS BIGINT) AS page_id", "'София' AS city")
    return X.extract_index_links(pages).drop("city")


SLUGS = ["ednostaen", "dvustaen", "tristaen", "chetiristaen", "mnogostaen"]
ADVERT_PAGE = (
    f"'<html><head><title>Обява ' || {text(K)} || '</title></head><body><h1>Продава в град София, ' || CASE WHEN {K} % 3 = 0 THEN 'Кръстова вада' ELSE '' END || ' - 79</h1>' || "
    f"CASE WHEN {K} % 3 = 1 THEN '<div class=\"location\">кв. Лозенец</div>' ELSE '' END || '<span>такса 120 €</span><b>' || {text('p_size + 40')} || ' ' || {text(f'{K} % 900 + 100')} || ' €</b>"
    f"<i>балкон 4 кв.м</i><i>' || {text('p_size + 20')} || CASE WHEN {K} % 2 = 0 THEN ' кв. м' ELSE ' кв.м' END || '</i></body></html>'")
ADVERT_PRICE = f"CAST((p_size + 40) * 1000 + {K} % 900 + 100 AS DOUBLE)"


@query("extract_agency_adverts", f"SELECT CAST({K} AS BIGINT) AS page_id, CASE {K} % 3 WHEN 0 THEN 'кръстова вада' WHEN 1 THEN 'лозенец' END AS neighborhood, CAST(p_size + 20 AS DOUBLE) AS size_sqm, "
       f"{ADVERT_PRICE} AS price_eur, {C.py_round(f'{ADVERT_PRICE} / (p_size + 20)', 2)} AS price_per_sqm, CAST(least({K} % 5 + 1, 4) AS INTEGER) AS rooms FROM part")
def extract_agency_adverts(spark, sf):
    """Detail pages of the agency portal."""
    pages = rendered(spark, sf, "part", ADVERT_PAGE, f"CAST({K} AS BIGINT) AS page_id", "'София' AS city",
                     f"'https://x/obiava-' || ({S.pick(f'{K} % 5', SLUGS)}) || '-apartament' AS url")
    return X.extract_agency_adverts(pages).select("page_id", "neighborhood", "size_sqm", "price_eur", "price_per_sqm", "rooms")


FACET_PAGE = (
    "'<a href=\"?search%5Bdistrict_id%5D=' || " + text(f"{K} % 40 + 1") + f" || '\"> <b>' || ({S.HOOD_OF_PART}) || '</b> (12) </a>"
    "<a href=\"?search%5Bdistrict_id%5D=' || " + text(f"{K} % 40 + 1") + " || '\">друго</a><a href=\"?search%5Bdistrict_id%5D=99\">Изток (3)</a><a href=\"/x\">y</a>'")


@query("extract_facets", f"SELECT CAST({K} AS BIGINT) AS page_id, CAST({K} % 40 + 1 AS VARCHAR) AS district_id, {S.HOOD_OF_PART} AS label FROM part UNION ALL SELECT {K}, '99', 'Изток' FROM part")
def extract_facets(spark, sf):
    """District filters of a town page (P5)."""
    pages = rendered(spark, sf, "part", FACET_PAGE, f"CAST({K} AS BIGINT) AS page_id", "'Русе' AS city")
    return X.extract_facets(pages).drop("city")


CARDS_PAGE = (
    "'<div class=\"head\">90 кв.м - 1000</div><div data-cy=\"l-card\"><h6>Апартамент</h6><span>' || " + text("p_size + 20") + " || ' кв.м - ' || "
    + text(f"{K} % 3000 + 150") + " || ',5</span></div><div data-cy=\"l-card\">нов <b>' || " + text(f"{K} % 60 + 10") + " || '</b> кв.м  - 900.75</div><article>без данни</article>'")
CARD_ROWS = (f"SELECT {K} AS page_id, ({S.HOOD_OF_PART}) AS facet, CAST(p_size + 20 AS DOUBLE) AS size_sqm, {K} % 3000 + 150.5::DOUBLE AS pps FROM part UNION ALL "
             f"SELECT {K}, ({S.HOOD_OF_PART}), CAST({K} % 60 + 10 AS DOUBLE), 900.75::DOUBLE FROM part")


def cards_check(where: str) -> str:
    return (f"WITH c AS ({CARD_ROWS}), {C.norm_cte('n', 'SELECT facet AS h FROM c')} SELECT CAST(page_id AS BIGINT) AS page_id, n.norm AS neighborhood, size_sqm, "
            f"{C.py_round('size_sqm * pps', 2)} AS price_eur, pps AS price_per_sqm FROM c JOIN n ON n.h = c.facet WHERE size_sqm BETWEEN 15 AND 500 AND pps BETWEEN 200 AND 15000 {where}")


def card_pages(spark, sf):
    return rendered(spark, sf, "part", CARDS_PAGE, f"CAST({K} AS BIGINT) AS page_id", "'Русе' AS city", f"({S.HOOD_OF_PART}) AS facet")


CARD_OUT = ["page_id", "neighborhood", "size_sqm", "price_eur", "price_per_sqm"]


@query("extract_cards", cards_check(""))
def extract_cards(spark, sf):
    """Cards of district pages."""
    return X.extract_cards(card_pages(spark, sf)).select(*CARD_OUT)


@query("extract_search_cards", cards_check(f"AND {C.py_round('size_sqm * pps', 2)} >= 15000"))
def extract_search_cards(spark, sf):
    """Cards of search pages, rentals dropped."""
    return X.extract_cards(card_pages(spark, sf), sale_floor=True).select(*CARD_OUT)


@query("extract_whole_page", f"WITH c AS ({CARD_ROWS} UNION ALL SELECT {K}, NULL, 90.0::DOUBLE, 1000.0::DOUBLE FROM part) SELECT CAST(page_id AS BIGINT) AS page_id, size_sqm, "
       f"{C.py_round('size_sqm * pps', 2)} AS price_eur, pps AS price_per_sqm FROM c WHERE size_sqm BETWEEN 15 AND 500 AND pps BETWEEN 200 AND 15000")
def extract_whole_page(spark, sf):
    """All matches of a page."""
    return X.extract_whole_page(card_pages(spark, sf)).select("page_id", "size_sqm", "price_eur", "price_per_sqm")


WORDS = ["Едностаен", "Двустаен", "Тристаен", "Четиристаен", "Многостаен"]
PARAM_PAGE = (
    f"'<div class=\"listtop-item-params\">' || ({S.pick(f'{K} % 5', WORDS)}) || CASE WHEN {K} % 2 = 0 THEN ' Цена: ' ELSE ' ' END || " + text(f"{K} % 400 + 5")
    + " || ' 900 € Квадратура:' || " + text("p_size + 5") + " || ' кв.м</div><div class=\"listtop-item-params\">без цена</div>'")
PARAM_PRICE = f"CAST(({K} % 400 + 5) * 1000 + 900 AS DOUBLE)"


@query("extract_param_cards", f"SELECT CAST({K} AS BIGINT) AS page_id, CAST(p_size + 5 AS DOUBLE) AS size_sqm, {PARAM_PRICE} AS price_eur, {C.py_round(f'{PARAM_PRICE} / (p_size + 5)', 2)} AS price_per_sqm, "
       f"CAST({K} % 5 + 1 AS INTEGER) AS rooms FROM part WHERE {PARAM_PRICE} BETWEEN 10000 AND 2000000 AND p_size + 5 >= 15")
def extract_param_cards(spark, sf):
    """Cards with labelled parameters."""
    pages = rendered(spark, sf, "part", PARAM_PAGE, f"CAST({K} AS BIGINT) AS page_id", "'Русе' AS city")
    return X.extract_param_cards(pages).select("page_id", "size_sqm", "price_eur", "price_per_sqm", "rooms")


RENDERED_PAGE = (
    f"'<div data-cy=\"l-card\"><h6>' || CASE WHEN {K} % 4 = 0 THEN '3-стаен' WHEN {K} % 4 = 1 THEN 'Многостаен' ELSE 'Имот' END || '</h6><p>' || " + text(f"{K} % 400 + 5")
    + f" || ' 900 €</p><span>гр. Русе, ' || ({S.HOOD_OF_PART}) || ' - Днес</span><span>' || " + text("p_size + 5") + " || ' кв.м - 1647</span></div>'")


@query("extract_rendered_cards", f"SELECT CAST({K} AS BIGINT) AS page_id, {S.HOOD_OF_PART} AS neighborhood, CAST(p_size + 5 AS DOUBLE) AS size_sqm, {PARAM_PRICE} AS price_eur, "
       f"CAST(CASE {K} % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 END AS INTEGER) AS rooms FROM part WHERE {PARAM_PRICE} BETWEEN 10000 AND 2000000 AND p_size + 5 >= 15")
def extract_rendered_cards(spark, sf):
    """Rendered cards."""
    pages = rendered(spark, sf, "part", RENDERED_PAGE, f"CAST({K} AS BIGINT) AS page_id", "'Русе' AS city")
    return X.extract_rendered_cards(pages).select("page_id", "neighborhood", "size_sqm", "price_eur", "rooms")


OFFER_PAGE = (
    f"'<a href=\"/offer/apartament-za-prodazhba/x/as' || {text(K)} || '\">днес' || CASE WHEN {K} % 3 = 0 THEN '' ELSE 'кв. Малинова Долина, Варна' END || 'star<b>Двустаен, ' || "
    + text("p_size + 30") + " || 'm²</b>Тухла, ТЕЦ<i>' || " + text(f"{K} % 300 + 20") + " || ',500 EUR</i> 2,285EUR/m²</a><a href=\"/offer/garazh/as1\">1,000 EUR</a>'")


@query("extract_offer_anchors", f"SELECT CAST({K} AS BIGINT) AS page_id, CAST({K} AS VARCHAR) AS id, '{L.OFFER_PORTAL}' AS source, '{L.OFFER_URL}/offer/apartament-za-prodazhba/x/as' || {K} AS url, "
       f"CASE WHEN {K} % 3 = 0 THEN 'София' ELSE 'Варна' END AS city, CASE WHEN {K} % 3 <> 0 THEN 'Малинова Долина' END AS neighborhood, '2-стаен' AS property_type, CAST(p_size + 30 AS DOUBLE) AS size_sqm, "
       f"'Тухла' AS construction, CAST(({K} % 300 + 20) * 1000 + 500 AS DOUBLE) AS price_eur, 2285.0::DOUBLE AS price_per_sqm FROM part")
def extract_offer_anchors(spark, sf):
    """Offers in link texts."""
    return X.extract_offer_anchors(rendered(spark, sf, "part", OFFER_PAGE, f"CAST({K} AS BIGINT) AS page_id"))


TABLE_PAGE = (
    "'<table><tr><td><a href=\"/obiavi/' || " + text(K) + f" || '\">двустаен</a></td><td>кв. Бояна, ' || " + text("p_size + 30") + " || ' кв.м</td><td>' || " + text(f"{K} % 300 + 20")
    + f" || ' 000 ' || CASE WHEN {K} % 2 = 0 THEN 'EUR' ELSE 'лв' END || '</td></tr><tr><td>заглавие</td></tr><tr><td><a href=\"/obiavi/' || " + text(K) + " || '\">пак</a> 5 EUR</td></tr></table>'")
LEVA = f"({K} % 300 + 20) * 1000"


@query("extract_table_rows", f"SELECT CAST({K} AS BIGINT) AS page_id, CAST({K} AS VARCHAR) AS id, CASE WHEN {K} % 2 = 0 THEN 'EUR' ELSE 'BGN' END AS price_currency, "
       f"CASE WHEN {K} % 2 = 0 THEN CAST({LEVA} AS DOUBLE) ELSE floor({LEVA}::DOUBLE / 1.95583::DOUBLE + 0.5) END AS price_eur, CAST(p_size + 30 AS INTEGER) AS area_sqm, 'двустаен' AS rooms, 'Бояна' AS neighborhood, "
       f"'/obiavi/' || {K} AS url FROM part")
def extract_table_rows(spark, sf):
    """Adverts in table rows."""
    out = X.extract_table_rows(rendered(spark, sf, "part", TABLE_PAGE, f"CAST({K} AS BIGINT) AS page_id"))
    return out.withColumn("price_eur", F.col("price_eur").cast("double"))


AGENCY_PAGE = (
    f"'<p>intro</p><a href=\"https://ag1.imot.bg/obiava-' || {text(K)} || '-prodava-dvustaen-apartament-grad-sofiya-lozenets\">x</a><b>' || "
    + text(f"{K} % 300 + 20") + " || ' 500 €</b> (' || " + text(f"({K} % 300 + 20) * 2")
    + f" || ' 000 лв.) <i>' || {text('p_size + 30')} || ' кв.м</i>, 4-ти ет. от 8, 2008 г. <a href=\"https://ag1.imot.bg/obiava-' || {text(K)} || '-prodava-dvustaen-apartament-grad-sofiya-lozenets\">y</a>"
    "<a href=\"https://ag2.imot.bg/obiava-5-prodava-x-grad-sofiya-y\">z</a><a href=\"https://ag1.imot.bg/obiava-6-naem-x-grad-sofiya-y\">z</a>'")


@query("extract_agency_listings", f"SELECT CAST({K} AS BIGINT) AS page_id, 'ag1' AS agency, 'https://ag1.imot.bg/obiava-' || {K} || '-prodava-dvustaen-apartament-grad-sofiya-lozenets' AS listing_url, "
       f"CAST({K} AS VARCHAR) AS listing_code, 'lozenets' AS district, 'dvustaen-apartament' AS property_type, CAST(p_size + 30 AS DOUBLE) AS area_sqm, '4-ти ет. от 8' AS floor_text, CAST(2008 AS INTEGER) AS construction_year, "
       f"CAST(({K} % 300 + 20) * 1000 + 500 AS DOUBLE) AS price_eur, CAST(({K} % 300 + 20) * 2000 AS DOUBLE) AS price_bgn, 'lozenets|dvustaen-apartament|' || (p_size + 30) || '|' || (({K} % 300 + 20) * 1000 + 500) AS hash_signature FROM part")
def extract_agency_listings(spark, sf):
    """Listings of agency pages with signature."""
    return X.extract_agency_listings(rendered(spark, sf, "part", AGENCY_PAGE, f"CAST({K} AS BIGINT) AS page_id", "'ag1' AS agency"))


# ---------------------------------------------------------------- posts

D = "doc_id"
POST_TEXT = (
    f"CASE {D} % 6 WHEN 0 THEN 'Продавам двустаен апартамент в Лозенец, 65 кв.м, цена ' || {text(f'{D} % 300 + 20')} || ' 000 EUR, тел. 0888 123 456. ' "
    f"WHEN 1 THEN 'Давам под наем гарсониера, София, ' || {text(f'{D} % 900 + 200')} || ' лв месечно, +359 888 123 456. ' "
    f"WHEN 2 THEN 'Търся къща или вила около Варна до €' || {text(f'{D} % 90 + 10')} || ',000 с двор 500 м2. ' "
    f"WHEN 3 THEN 'Офис 45 sqm, euro ' WHEN 4 THEN 'Продавам ап. ' ELSE '' END || text")
POSTS = f"posts AS (SELECT {D} AS id, source AS group_name, {POST_TEXT} AS text FROM documents)"


def any_of(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in words) + ")"


def case_of(table, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {any_of(ws)} THEN '{v}'" for ws, v in table) + f" ELSE {default} END"


CLASS = {k: any_of(v) for k, v in L.POST_KEYWORDS.items()}
RELEVANT = (f"length(text) >= 50 AND ({' + '.join(f'CAST({c} AS INTEGER)' for c in CLASS.values())}) >= 2 AND ({CLASS['transaction']} OR {CLASS['propertyType']})")


def posts(spark, sf):
    return S.table(spark, sf, "documents").selectExpr(f"{D} AS id", "source AS group_name", f"{POST_TEXT} AS text")


@query("post_classify", f"WITH {POSTS} SELECT id, {case_of(L.POST_TYPES, chr(39) + L.POST_TYPE_DEFAULT + chr(39))} AS property_type, "
       f"{case_of([(p.split('|'), k) for p, k in L.POST_TRANSACTIONS], chr(39) + 'unknown' + chr(39))} AS transaction_type, "
       f"CASE WHEN {any_of(L.POST_HOODS)} THEN 'София' ELSE {case_of([([c], c) for c in L.POST_CITIES])} END AS city, {case_of([([h], h) for h in L.POST_HOODS])} AS neighborhood FROM posts WHERE {RELEVANT}")
def post_classify(spark, sf):
    """Property posts with type, transaction and place."""
    out = W.classify_posts(posts(spark, sf))
    return out.select("id", "property_type", "transaction_type", F.col("location.city").alias("city"),
                      F.col("location.neighborhood").alias("neighborhood"))


def post_number(pattern: str) -> str:
    raw = f"regexp_replace(regexp_extract(text, '(?i){pattern}', 1), '\\s', '', 'g')"
    raw = f"regexp_replace({raw}, '^([^,]*),', '\\1')"
    return f"TRY_CAST(nullif(regexp_extract({raw}, '^(\\d*\\.?\\d*)', 1), '') AS DOUBLE)"


# the published forms, written out: amounts, sizes and phones
LEVA_PRICE, EURO_PRICE = "(\\d[\\d\\s,.]*)\\s*(?:лв|лева|bgn)", "(\\d[\\d\\s,.]*)\\s*(?:евро|euro|eur|€)"
POST_NUMBERS = f"{post_number(LEVA_PRICE)} AS n0, {post_number(EURO_PRICE)} AS n1, lower(regexp_extract(text, '(?i)\\d[\\d\\s,.]*\\s*(лв|лева|bgn)', 1)) = 'лева' AS whole_word"
N = [f"CASE WHEN n{i} > 100 AND n{i} < 10000000 THEN n{i} END" for i in range(2)]
PHONES = ("regexp_extract_all(text, '(\\+359|0)[\\s.-]?(\\d{2,3})[\\s.-]?(\\d{3})[\\s.-]?(\\d{3,4})', 0) || "
          "regexp_extract_all(text, '(\\d{3})[\\s.-]?(\\d{3})[\\s.-]?(\\d{3,4})', 0)")
POST_SIZE = [f"TRY_CAST(nullif(regexp_extract(text, '(?i){p}', 1), '') AS INTEGER)" for p in
             ("(\\d+)\\s*(?:кв\\.?м|квм|m2|м2|sqm)", "(\\d+)\\s*(?:sq\\.?\\s*m)")]


@query("post_numbers", f"WITH {POSTS}, v AS (SELECT id, text, {POST_NUMBERS}, {', '.join(f'{x} AS s{i}' for i, x in enumerate(POST_SIZE))} FROM posts WHERE {RELEVANT}) "
       f"SELECT id, coalesce({', '.join(N)}) AS amount, CASE WHEN {N[0]} IS NOT NULL AND NOT whole_word THEN 'BGN' WHEN coalesce({N[0]}, {N[1]}) IS NOT NULL THEN 'EUR' END AS currency, "
       f"coalesce(CASE WHEN s0 > 10 AND s0 < 5000 THEN s0 END, CASE WHEN s1 > 10 AND s1 < 5000 THEN s1 END) AS size, "
       f"nullif(array_to_string(list_transform({PHONES}, lambda p: regexp_replace(p, '[\\s.-]', '', 'g')), ','), '') AS contact FROM v")
def post_numbers(spark, sf):
    """Price, size and phones of property posts (P14b, P14d)."""
    out = W.classify_posts(posts(spark, sf))
    return out.select("id", F.col("price.amount").alias("amount"), F.col("price.currency").alias("currency"), "size",
                      F.array_join("contact", ",").alias("contact"))


@query("posts_for_sale", f"WITH {POSTS} SELECT id FROM posts WHERE {RELEVANT} AND {case_of([(p.split('|'), k) for p, k in L.POST_TRANSACTIONS])} = 'sale'")
def posts_for_sale(spark, sf):
    """Posts of one transaction kind."""
    from compframe.operators.filters import transaction_is
    return W.classify_posts(posts(spark, sf)).where(transaction_is("sale")).select("id")


@query("post_ids", f"WITH {POSTS} SELECT id, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE 'hash_' || sha256(text) END AS post_id FROM posts")
def post_ids(spark, sf):
    """Post ids from links or text hashes."""
    link = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://x/groups/1/posts/"), F.col("id").cast("string")))
    return posts(spark, sf).select("id", T.post_id(link, F.col("text")).alias("post_id"))


# each post is delivered twice, at times of its own; which delivery is the newer one depends on the id
SEEN = "TIMESTAMP '2024-03-15 10:00:00' + INTERVAL 1 SECOND * (id % 1000) * (CASE n WHEN 0 THEN 7 ELSE id % 3 * 5 END)"


@query("stored_posts", f"WITH {POSTS}, two AS (SELECT *, {SEEN} AS ts FROM posts, (VALUES (0), (1)) v(n)), "
       f"named AS (SELECT CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE 'hash_' || sha256(text) END AS id, ts, text, "
       f"{case_of(L.POST_TYPES, chr(39) + L.POST_TYPE_DEFAULT + chr(39))} AS property_type, "
       f"{case_of([(p.split('|'), k) for p, k in L.POST_TRANSACTIONS], chr(39) + 'unknown' + chr(39))} AS transaction_type, "
       f"CASE WHEN {any_of(L.POST_HOODS)} THEN 'София' ELSE {case_of([([c], c) for c in L.POST_CITIES])} END AS city FROM two WHERE {RELEVANT}) "
       "SELECT id, min(sha256(text)) AS text_sha256, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, min(property_type) AS property_type, "
       "min(transaction_type) AS transaction_type, min(city) AS city FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY ts DESC) AS newest FROM named) "
       "WHERE newest = 1 GROUP BY id")
def stored_posts(spark, sf):
    """The whole post job: classified, named, the newest delivery of each kept."""
    seconds = (F.col("id") % 1000) * F.when(F.col("n") == 0, 7).otherwise(F.col("id") % 3 * 5)
    two = posts(spark, sf).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "ts", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-15 10:00:00").cast("timestamp")) + seconds))
    linked = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://x/groups/1/posts/"), F.col("id").cast("string")))
    out = W.stored_posts(two.withColumn("link", linked).drop("id", "n"))
    return out.select("id", F.sha2("text", 256).alias("text_sha256"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                      "property_type", "transaction_type", F.col("location.city").alias("city"))


# ---------------------------------------------------------------- given pages with many cards in them

N_CARDS = "CAST(page_id % 131 AS INTEGER)"  # from none to many
MANY_LINKS = (f"html || array_join(transform(sequence(1, {N_CARDS}), i -> concat('<p><a href=\"/obiava-', i * 7 + page_id, '-prodava-dvustaen-apartament#top\">&sup2;</a></p>')), ' ') || html")
MANY_CARDS = (f"html || array_join(transform(sequence(1, {N_CARDS}), i -> concat('<div class=\"listtop-item-params\">', element_at(array('Едностаен', 'Двустаен', 'Тристаен', 'Имот'), CAST(i % 4 + 1 AS INT)), "
              "' Цена: ', i % 300 + 11, ' 900 &#8364; Квадратура: ', i % 90 + 14, ' кв.м</div>')), '<hr>') || html")


def noisy(spark, sf, html: str):
    return S.table(spark, sf, "pages").where("page_id IS NOT NULL").selectExpr(
        "page_id", "'Русе' AS city", f"CASE WHEN {N_CARDS} > 0 THEN {html} ELSE html END AS html").withColumn("fetched_at", F.lit(S.NOW).cast("timestamp"))


@query("many_index_links", f"SELECT page_id, CAST(i - 1 AS INTEGER) AS place, 'https://www.imot.bg/obiava-' || (i * 7 + page_id) || '-prodava-dvustaen-apartament' AS url "
       f"FROM (SELECT page_id, unnest(range(1, {N_CARDS} + 1)) AS i FROM pages)")
def many_index_links(spark, sf):
    """All links of real pages with up to 130 adverts in them."""
    return X.extract_index_links(noisy(spark, sf, MANY_LINKS)).select("page_id", "place", "url")


MANY_PRICE = "CAST((i % 300 + 11) * 1000 + 900 AS DOUBLE)"


@query("many_param_cards", f"SELECT page_id, CAST(i % 90 + 14 AS DOUBLE) AS size_sqm, {MANY_PRICE} AS price_eur, CAST(CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS INTEGER) AS rooms "
       f"FROM (SELECT page_id, unnest(range(1, {N_CARDS} + 1)) AS i FROM pages) WHERE i % 90 + 14 >= 15")
def many_param_cards(spark, sf):
    """All cards of real pages with up to 130 of them, prices with entities."""
    return X.extract_param_cards(noisy(spark, sf, MANY_CARDS)).select("page_id", "size_sqm", "price_eur", "rooms")


CYRILLIC = bytes(range(192, 256)).decode("cp1251")


@query("decoded_agency_pages", f"SELECT CAST({K} AS BIGINT) AS page_id, ({S.HOOD_OF_PART}) || ' {CYRILLIC} № €' AS html FROM part")
def decoded_agency_pages(spark, sf):
    """Agency pages stored in windows-1251."""
    from compframe.sources.readers import AGENCY_CHARSETS, decode_text
    upper = bytes(range(128, 256))
    body = S.table(spark, sf, "part").selectExpr(f"CAST({K} AS BIGINT) AS page_id", f"({S.HOOD_OF_PART}) || ' {CYRILLIC} № €' AS html")
    stored = F.encode(F.translate("html", upper.decode("cp1251", errors="replace"), upper.decode("latin1")), "ISO-8859-1")
    return body.select("page_id", decode_text(stored, AGENCY_CHARSETS).alias("html"))
