"""Advert pages to market rows, one function per page form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe import lookups as L
from compframe.config import RATE_OFFICIAL
from compframe.functions import price as P
from compframe.functions import text as T
from compframe.functions.core import blank_to_null, group, let, once, round_exact, round_half_up, strip
from compframe.operators import filters, markup as H
from compframe.operators.ranking import keep_first, top_per_group

MARKET = ["city", "neighborhood", "size_sqm", "price_eur", "price_per_sqm", "rooms", "source", "scraped_at"]

# Forms of the advert pages.
ADVERT_PRICE = r"(\d[\d\s]*\d)\s*[€EUR]"
ADVERT_PRICE_FIXED = r"(\d[\d\s]*\d)\s*(?:€|EUR)"
ADVERT_SIZE = r"(\d+)\s*кв\.?\s*м"
HEADINGS = r'<(?:h1\b[^>]*|[a-z0-9]+[^>]*(?:class="(?:[^"]*\s)?(?:breadcrumb|location|adress)(?:\s[^"]*)?"|id="breadcrumb")[^>]*)>(.*?)</'
PAGE_TITLE = r"<title[^>]*>(.*?)</title>"
FACET = r"district_id%5D=(\d+)"
CARD_OPENING = r'<(?:article\b|[a-z]+[^>]*data-cy="l-card"|[a-z]+[^>]*class="(?:[^"]*\s)?offer-wrapper)'
CARD_PRICE = r"(\d+)\s*кв\.м\s*-\s*([\d\.,]+)"
PARAM_OPENING = r'<div[^>]*class="(?:[^"]*\s)?listtop-item-params'
PARAM_PRICES = [r"Цена:\s*([\d\s]+)\s*€", r"([\d\s]+)\s*€"]
PARAM_SIZES = [r"Квадратура:\s*(\d+)", r"(\d+)\s*кв\.?м"]
RENDERED_OPENING = r'<[a-z]+[^>]*data-cy="l-card"'
RENDERED = {"price": r"(\d[\d\s]*)\s*€", "size": r"(\d+)\s*кв\.?м", "hood": r"гр\.\s*\S+,\s*([^-]+?)\s*-"}
OFFER = {
    "place": r"(?:кв\.|жк\.)\s*([^,]+),\s*([А-Яа-я]+)",
    "kind": r"(Едностаен|Двустаен|Тристаен|Четиристаен|Мезонет|Гарсониера),?\s*(\d+)m²",
    "construction": r"(Тухла|ЕПК|Панел)", "price": r"([\d,]+)\s*EUR", "pps": r"([\d,]+)EUR/m²", "id": r"/as(\d+)$",
}
ROW = {
    "price": r"([\d\s]+)\s*(EUR|лв|BGN)", "area": r"(\d+)\s*(?:кв\.?м|m2)",
    "rooms": r"(едностаен|двустаен|тристаен|четиристаен|\d-стаен)",
    "hood": [r"(?:кв\.|жк\.|ж\.к\.)\s*([А-Яа-я\s\d]+?)(?:,|\s+-)", r"София,\s*([А-Яа-я\s\d]+?)(?:,|$)"],
    "link": r'href="([^"]*obiavi[^"]*)"',
}
AGENCY = {
    "url": r"https://[a-z0-9.-]+?\.imot\.bg/obiava-", "rest": r'^([^"\s<]+)',
    "district": [r"-grad-sofiya-([a-z0-9-]+)$", r"-oblast-sofiya-([a-z0-9-]+)$"],
    "kind": [r"-prodava-([a-z0-9-]+?)-grad-sofiya", r"-prodava-([a-z0-9-]+?)-oblast-sofiya"],
    "eur": r"(\d[\d\s\.,]*)\s*€", "bgn": r"(\d[\d\s\.,]*)\s*лв", "area": r"(\d+[\.,]?\d*)\s*кв\.?м",
    "floor": r"(\d+\s*-?\s*ти\s*ет\.?[^,\.]*)", "year": r"(19\d{2}|20\d{2})\s*г",
}
EUR_OUTLIER = 2000000


def _digits(c: Column) -> Column:
    """Number with blanks as thousands marks; null for anything else."""
    return F.regexp_replace(c, r"(?U)\s", "").try_cast("double")


def _market_row(pages: DataFrame, source: str, **fields: Column) -> DataFrame:
    cols = {"neighborhood": F.lit(None).cast("string"), "rooms": F.lit(None).cast("int"), **fields}
    return pages.select("page_id", *[
        (cols[c] if c in cols else {"city": F.col("city"), "source": F.lit(source),
                                    "scraped_at": F.col("fetched_at")}[c]).alias(c) for c in MARKET])


# ---------------------------------------------------------------- agency portal

def extract_index_links(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Links to flats for sale: absolute, without fragment, distinct, in page order; only the first ``cap`` if it is given."""
    def wanted(a: Column) -> Column:
        return F.contains(a, F.lit("obiava")) & F.contains(a, F.lit("prodava")) & F.contains(a, F.lit("apartament"))

    def absolute(h: Column) -> Column:
        full = F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).when(
            F.startswith(h, F.lit("/")), F.concat(F.lit(L.AGENCY_URL), h)).otherwise(h)
        return F.substring_index(full, "#", 1)

    hrefs = H.all_matches(F.col("html"), r'(?is)<a\b[^>]*?href="([^"]*)"')
    links = H.in_order_distinct(F.transform(F.filter(hrefs, wanted), absolute))
    links = links if cap is None else F.slice(links, 1, cap)
    return pages.select("page_id", "city", F.posexplode(links).alias("place", "url"))


def first_in_range(values: Column, accept) -> Column:
    """First accepted value, else the last one seen."""
    return let(values, lambda v: F.coalesce(F.get(F.filter(v, accept), F.lit(0)),
                                            F.get(v, F.size(v) - 1)))


def extract_agency_adverts(pages: DataFrame, compat: bool = True) -> DataFrame:
    """Detail pages of the agency portal; one row per page with a price and a size."""
    html = F.col("html")
    money = F.filter(F.transform("_nodes", lambda t: F.translate(F.regexp_extract(
        t, f"(?U){ADVERT_PRICE if compat else ADVERT_PRICE_FIXED}", 1), "  ", "")), lambda s: s.rlike(r"^\d+$"))
    areas = F.filter(F.transform("_nodes", lambda t: F.regexp_extract(t, f"(?U){ADVERT_SIZE}", 1)), lambda s: s != "")
    price = first_in_range(F.transform(money, lambda s: s.cast("double")), lambda p: p > 5000)
    size = first_in_range(F.transform(areas, lambda s: s.cast("double")), lambda s: s.between(15, 500))
    read = once(once(pages, pages.columns, H.text_nodes(html).alias("_nodes")), pages.columns, price.alias("_price"), size.alias("_size"))
    read = once(read.where((F.col("_price") != 0) & (F.col("_size") != 0)), [*pages.columns, "_price", "_size"],
                P.price_per_sqm("_price", "_size").alias("_pps"))
    read = read.where(F.col("_pps").between(*filters.INGEST_PPS))
    # the title is read first, then the headings in page order; what comes after the first district is not looked at
    places = F.concat(F.array(T.inner_text(F.regexp_extract(html, f"(?is){PAGE_TITLE}", 1))), H.element_text(html, f"(?is){HEADINGS}"))
    read = once(read, read.columns, places.alias("_places"))
    hood = F.aggregate("_places", F.lit(None).cast("string"), lambda seen, t: F.when(seen.isNotNull(), seen).otherwise(T.extract_hood(t, compat)))
    read = once(read, read.columns, hood.alias("_hood"))
    return _market_row(read, L.AGENCY_PORTAL, neighborhood=F.col("_hood"), size_sqm=F.col("_size"), price_eur=F.col("_price"),
                       price_per_sqm=F.col("_pps"), rooms=P.rooms_by_slug("url"))


# ---------------------------------------------------------------- card portal

def extract_facets(pages: DataFrame) -> DataFrame:
    """District filter ids with their labels, first label of an id on a page."""
    each = pages.select("page_id", "city", F.posexplode(H.anchors(F.col("html"))).alias("place", "a"))
    rows = each.select("page_id", "city", "place", group(F.col("a.href"), FACET).alias("district_id"),
                       F.regexp_replace(F.col("a.label"), r"(?U)\s*\(\d+\)\s*$", "").alias("label"))
    rows = rows.where(F.col("district_id").isNotNull() & (F.col("label") != ""))
    return keep_first(rows, ["page_id", "district_id"], [F.col("place").asc()]).drop("place")


def _priced(rows: DataFrame, size: Column, pps: Column) -> DataFrame:
    out = once(rows, rows.columns, size.try_cast("double").alias("size_sqm"),
               F.replace(pps, F.lit(","), F.lit(".")).try_cast("double").alias("price_per_sqm"))
    out = out.where(filters.ingest_ok(F.col("size_sqm"), F.col("price_per_sqm")))
    return once(out, out.columns, round_exact(F.col("size_sqm") * F.col("price_per_sqm"), 2).alias("price_eur"))


def extract_cards(pages: DataFrame, sale_floor: bool = False) -> DataFrame:
    """Cards of a district or search page; ``facet`` is the district the page was asked for.

    ``sale_floor`` drops rentals that leak into search pages.
    """
    hood = F.coalesce(T.normalize_hood("facet"), F.lower(strip(F.col("facet"))))
    pages = once(pages, pages.columns, hood.alias("_hood"))
    kept = [c for c in pages.columns if c != "html"]
    cards = pages.select(*kept, F.explode(H.segments(F.col("html"), CARD_OPENING, whole_page=True)).alias("card"))
    text = once(cards, kept, H.flat_text(F.col("card")).alias("t"))
    t = F.col("t")
    rows = _priced(text, group(t, CARD_PRICE, 1), group(t, CARD_PRICE, 2))
    out = _market_row(rows, L.CARD_PORTAL, neighborhood=F.col("_hood"), size_sqm=F.col("size_sqm"),
                      price_eur=F.col("price_eur"), price_per_sqm=F.col("price_per_sqm"))
    return out.where(filters.above_sale_floor(F.col("price_eur"))) if sale_floor else out


def extract_whole_page(pages: DataFrame) -> DataFrame:
    """Every size and price on the page, no district."""
    text = pages.withColumn("t", H.flat_text(F.col("html")))
    pairs = F.arrays_zip(H.all_matches(F.col("t"), f"(?U){CARD_PRICE}", 1).alias("size"),
                         H.all_matches(F.col("t"), f"(?U){CARD_PRICE}", 2).alias("pps"))
    each = text.select("*", F.explode(pairs).alias("m"))
    rows = _priced(each, F.col("m.size"), F.col("m.pps"))
    return _market_row(rows, L.CARD_PORTAL, size_sqm=F.col("size_sqm"), price_eur=F.col("price_eur"),
                       price_per_sqm=F.col("price_per_sqm"))


def _first_cards(pages: DataFrame, opening: str) -> DataFrame:
    cards = H.segments(F.col("html"), opening, whole_page=False)
    return pages.select("*", F.posexplode(cards).alias("place", "card"))


def _total_price(rows: DataFrame, price: Column, size: Column) -> DataFrame:
    out = rows.withColumns({"price_eur": _digits(price), "size_sqm": size.try_cast("double")})
    return out.where(filters.ingest_price_ok(F.col("price_eur"), F.col("size_sqm")))


def extract_param_cards(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Cards with labelled parameters; if ``cap`` is given, the first ``cap`` that parse per page."""
    rows = _first_cards(pages, PARAM_OPENING).withColumn("t", H.flat_text(F.col("card")))
    t = F.col("t")
    rows = _total_price(rows, F.coalesce(*[group(t, p) for p in PARAM_PRICES]),
                        F.coalesce(*[group(t, p) for p in PARAM_SIZES]))
    rows = rows if cap is None else top_per_group(rows, ["page_id"], [F.col("place").asc()], cap)
    return _market_row(rows, L.PARAM_PORTAL, size_sqm=F.col("size_sqm"), price_eur=round_exact(F.col("price_eur"), 2),
                       price_per_sqm=P.price_per_sqm("price_eur", "size_sqm"), rooms=P.rooms_by_word(t))


def extract_rendered_cards(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Cards of a rendered list page; if ``cap`` is given, the first ``cap`` that parse per page."""
    rows = _first_cards(pages, RENDERED_OPENING).withColumn("t", T.unescape(F.regexp_replace(F.col("card"), r"<[^>]+>", "\n")))
    t = F.col("t")
    rows = _total_price(rows, group(t, RENDERED["price"]), group(t, RENDERED["size"]))
    rows = rows if cap is None else top_per_group(rows, ["page_id"], [F.col("place").asc()], cap)
    return _market_row(rows, L.CARD_PORTAL, neighborhood=strip(group(t, RENDERED["hood"])), size_sqm=F.col("size_sqm"),
                       price_eur=round_exact(F.col("price_eur"), 2),
                       price_per_sqm=P.price_per_sqm("price_eur", "size_sqm"), rooms=P.rooms_by_digit_or_word(t))


# ---------------------------------------------------------------- older page forms

def extract_offer_anchors(pages: DataFrame) -> DataFrame:
    """Offers whose whole data stands in the text of one link."""
    each = pages.select("page_id", F.explode(H.anchors(F.col("html"))).alias("a")).select(
        "page_id", F.col("a.href").alias("href"), F.col("a.label").alias("t"))
    href, t = F.col("href"), F.col("t")
    offers = each.where(F.contains(href, F.lit("/offer/")) & (
        F.contains(href, F.lit("apartament-za-prodazhba")) | F.contains(href, F.lit("kashta-za-prodazhba"))))
    return offers.select(
        "page_id", group(href, OFFER["id"]).alias("id"), F.lit(L.OFFER_PORTAL).alias("source"),
        F.concat(F.lit(L.OFFER_URL), href).alias("url"),
        F.coalesce(group(t, OFFER["place"], 2), F.lit("София")).alias("city"),
        strip(group(t, OFFER["place"], 1)).alias("neighborhood"),
        P.offer_type(group(t, OFFER["kind"], 1, "iU")).alias("property_type"),
        group(t, OFFER["kind"], 2, "iU").try_cast("double").alias("size_sqm"),
        group(t, OFFER["construction"], flags="iU").alias("construction"),
        T.thousands_number(group(t, OFFER["price"])).alias("price_eur"),
        T.thousands_number(group(t, OFFER["pps"])).alias("price_per_sqm"),
    ).where(F.col("price_eur") > 0)


def extract_table_rows(pages: DataFrame) -> DataFrame:
    """Adverts laid out as table rows; the first of each link, or of each whole text without one, is kept per page."""
    trs = pages.select("page_id", F.posexplode(H.all_matches(F.col("html"), r"(?is)(<tr\b.*?</tr>)")).alias("place", "tr"))
    rows = trs.withColumn("t", strip(F.regexp_replace(T.unescape(F.regexp_replace("tr", r"<[^>]+>", " ")), r"(?U)\s+", " ")))
    t = F.col("t")
    amount = _digits(group(t, ROW["price"], 1, "iU"))
    currency = F.when(F.upper(group(t, ROW["price"], 2, "iU")) == "EUR", "EUR").otherwise("BGN")
    url = group(F.col("tr"), ROW["link"], flags="i")
    out = rows.where(group(t, ROW["price"], 2, "iU").isNotNull()).select(
        "page_id", "place", group(url, r"(\d+)").alias("id"), currency.alias("price_currency"),
        F.when(currency == "EUR", amount).otherwise(round_half_up(amount / RATE_OFFICIAL)).alias("price_eur"),
        group(t, ROW["area"], flags="iU").try_cast("int").alias("area_sqm"), group(t, ROW["rooms"], flags="iU").alias("rooms"),
        F.coalesce(*[strip(group(t, p, flags="iU")) for p in ROW["hood"]]).alias("neighborhood"),
        url.alias("url"), F.coalesce(url, t).alias("_key"))
    return keep_first(out, ["page_id", "_key"], [F.col("place").asc()]).drop("place", "_key")


def extract_agency_listings(pages: DataFrame) -> DataFrame:
    """Sale listings of agency pages: slug fields, and numbers from the listing's own text.

    A listing's text runs from a link to it up to the next link to another one; a page that
    links it several times adds the pieces up. ``pages`` carries ``agency``, the subdomain the page belongs to.
    """
    parts = pages.select("page_id", "agency", F.posexplode(F.split(F.col("html"), f"(?={AGENCY['url']})")).alias("i", "part"))
    each = parts.withColumn("url", F.regexp_extract("part", AGENCY["rest"], 1))
    prefix = F.concat(F.lit("https://"), "agency", F.lit(f".{L.AGENCY_PORTAL}/obiava-"))
    sale = F.startswith("url", prefix) & F.contains("url", F.lit("-prodava-")) & (
        F.contains("url", F.lit("-grad-sofiya")) | F.contains("url", F.lit("-oblast-sofiya")))
    own = each.where(sale).groupBy("page_id", "agency", "url").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("own"))
    whole = F.array_join(F.transform("own", lambda x: x["part"]), " ")
    text = strip(F.regexp_replace(F.regexp_replace(whole, r"<[^>]+>", " "), r"(?U)\s+", " "))
    each = own.select("page_id", "agency", F.struct("url").alias("h"), text.alias("t"))
    slug = F.element_at(F.split(F.col("h.url"), "/obiava-"), -1)
    rows = each.select("page_id", "agency", F.col("h.url").alias("listing_url"), slug.alias("slug"), "t")
    s, t = F.col("slug"), F.col("t")
    eur, bgn = T.clean_number(group(t, AGENCY["eur"])), T.clean_number(group(t, AGENCY["bgn"]))
    out = rows.select(
        "page_id", "agency", "listing_url", blank_to_null(F.substring_index(s, "-", 1)).alias("listing_code"),
        F.coalesce(*[group(s, p) for p in AGENCY["district"]]).alias("district"),
        F.coalesce(*[group(s, p) for p in AGENCY["kind"]]).alias("property_type"),
        T.clean_number(group(t, AGENCY["area"], flags="iU")).alias("area_sqm"),
        strip(group(t, AGENCY["floor"], flags="iU")).alias("floor_text"),
        group(t, AGENCY["year"]).try_cast("int").alias("construction_year"),
        F.when((eur > EUR_OUTLIER) & (bgn != 0), round_exact(bgn / RATE_OFFICIAL, 2)).otherwise(eur).alias("price_eur"),
        bgn.alias("price_bgn"))
    return out.withColumn("hash_signature", T.signature(
        F.col("district"), F.col("property_type"), F.col("area_sqm"), F.col("price_eur")))
