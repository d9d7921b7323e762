"""Court-auction pages to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe import lookups as L
from compframe.config import RATE_LIVE
from compframe.functions import text as T
from compframe.functions import time as D
from compframe.functions.core import blank_to_null, group, let, once, round_exact, strip
from compframe.operators import markup as H

# Forms of the auction pages.
PRICE = r'<div class="price">([\d\s&;nbsp\.]+)\s*(EUR|лв)'
TITLE = r'</ul>\s*</div>\s*<div class="title">([^<]+)</div>\s*<div class="date">'
TITLE_BY_WORD = (r'<div class="title">([^<]*(?:апартамент|къща|гараж|вила|парцел|земя|магазин|офис|ателие|склад|'
                 r'земеделска)[^<]*)</div>\s*<div class="(?:date|category)">')
CITY = r"(гр\.\s*[А-Яа-я\s-]+|с\.\s*[А-Яа-я\s-]+)"
FIELD = r'<div[^>]*class="label"[^>]*>\s*{}\s*</div>\s*<div[^>]*class="info"[^>]*>(.*?)</div>'
SIZE = r"(\d+(?:[,\.]\d+)?)\s*(?:кв\.?\s*м|м2|m2)"
INFO = r'<div class="info">(.*?)</div>'
FLOORS = {
    "block": r"Етаж\s*\n\s*(\d{1,2})\b",
    "word": r"(?:ет\.\s*|етаж\s+)(\d{1,2})(?!\d)",
    "of": r"на\s+(\d{1,2})\s*[/\(].*?етаж",
    "ordinal": r"(\d{1,2})\s*[-–]?\s*(?:ия|ти|ен|ри|ви)\s*етаж",
    "info": r"ет\.\s*(\d{1,2})(?!\d)",
}
ROOMS = r"(\d+)\s*(?:-?стаен|стаи|стая)"
TERM = r"СРОК.*?до\s*(\d{2}\.\d{2}\.\d{4})"
END = r"Край[^:]*:?\s*(\d{2}\.\d{2}\.\d{4})"
PARTIAL = r"¼|½|¾|⅓|⅔|\d+/\d+\s*(?:ид|ід)|идеална\s*част|ідеална\s*част"
LISTED_ID = r'href="/properties/(\d+)"'
CARD_OPENING = r'<(?:article\b|[a-z]+[^>]*class="[^"]*(?:card|listing|property)[^"]*")'
CARD = {
    "price": r"([\d\s,.]+)\s*EUR",
    "city": [r"НАСЕЛЕНО МЯСТО[:\s]*([^\n]+)", r"(?:гр\.|с\.)\s*([^\n,]+)"],
    "address": r"Адрес[:\s]*([^\n]+)",
    "court": r"ОКРЪЖЕН СЪД[:\s]*([^\n]+)",
    "executor": r"ЧАСТЕН СЪДЕБЕН ИЗПЪЛНИТЕЛ[:\s]*([^\n]+)",
    "term": r"СРОК[:\s]*от\s*(\d{2}\.\d{2}\.\d{4})\s*до\s*(\d{2}\.\d{2}\.\d{4})",
    "announce": r"ОБЯВЯВАНЕ НА[:\s]*(\d{2}\.\d{2}\.\d{4}\s*\d{2}:\d{2})",
}
BLOCK = {
    "price": [r"([\d\s,.]+)\s*EUR\s*$", r"([\d\s,.]+)\s*EUR"],
    "city": r"(?:гр\.|с\.)\s*([А-Яа-я\s]+?)(?:\n|,|ОКРЪЖЕН)",
    "court": r"ОКРЪЖЕН СЪД[:\s]*([А-Яа-я\s]+?)(?:\n|ЧАСТЕН)",
    "term": r"от\s*(\d{2}\.\d{2}\.\d{4})\s*до\s*(\d{2}\.\d{2}\.\d{4})",
}
MAX_FLOOR = 30


def extract_ids(pages: DataFrame) -> DataFrame:
    """Distinct auction ids linked from list pages; the union over all courts."""
    ids = pages.select(F.explode(H.all_matches(F.col("html"), LISTED_ID)).alias("id"))
    return ids.select(F.col("id").cast("bigint").alias("id")).distinct()


def _labelled(html: Column, label: str, min_length: int) -> Column:
    value = T.inner_text(group(html, FIELD.format(label), flags="isU"))
    return let(value, lambda v: F.when(v.rlike("[А-Яа-я]") & (F.length(v) > min_length), v))


def _floor(html: Column) -> Column:
    def accepted(text: Column) -> Column:
        return let(text.try_cast("int"), lambda n: F.when(n.between(0, MAX_FLOOR), n))

    # an empty first block is a block: the page is searched only where there is none
    info = F.when(html.rlike(f"(?sU){INFO}"), F.regexp_extract(html, f"(?sU){INFO}", 1)).otherwise(html)
    in_blocks = F.filter(
        F.transform(H.all_matches(html, f"(?sU){INFO}"),
                    lambda b: accepted(group(b, FLOORS["info"], flags="iU"))), lambda n: n.isNotNull())
    return F.coalesce(
        accepted(group(html, FLOORS["block"], flags="iU")),
        accepted(group(info, FLOORS["word"], flags="iU")),
        accepted(group(html, FLOORS["of"], flags="iU")),
        accepted(group(html, FLOORS["ordinal"], flags="iU")),
        F.get(in_blocks, F.lit(0)))


def auction_fields(html: Column, now: Column, rate: float = RATE_LIVE) -> list[Column]:
    """Every field of an auction page."""
    number = F.regexp_replace(group(html, PRICE, 1), r"(?U)&nbsp;|\s", "").try_cast("double")
    price = F.when(group(html, PRICE, 2) == "лв", round_exact(number / F.lit(rate), 2)).otherwise(number)
    end = F.coalesce(group(html, TERM, flags="isU"), group(html, END))
    return [
        price.alias("price_eur"),
        strip(F.regexp_replace(strip(group(html, CITY)), r"[,<]+$", "")).alias("city"),
        F.lower(_labelled(html, "Район", 2)).alias("neighborhood"),
        _labelled(html, "Адрес", 3).alias("address"),
        F.coalesce(strip(group(html, TITLE, flags="sU")), strip(group(html, TITLE_BY_WORD, flags="iU"))).alias("property_type"),
        F.replace(group(html, SIZE, flags="iU"), F.lit(","), F.lit(".")).try_cast("double").alias("size_sqm"),
        group(html, ROOMS, flags="iU").try_cast("int").alias("rooms"),
        _floor(html).alias("floor"),
        html.rlike(f"(?iU){PARTIAL}").alias("is_partial_ownership"),
        F.coalesce(D.parse_local_date(end).cast("timestamp") < now, F.lit(False)).alias("is_expired"),
        end.alias("auction_end"),
    ]


def extract_auctions(pages: DataFrame, now: Column, rate: float = RATE_LIVE) -> DataFrame:
    """One row per stored auction page; pages without content give none."""
    kept = pages.where(F.coalesce("html", F.lit("")) != "")
    return kept.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit(L.AUCTION_URL), F.col("page_id").cast("string")).alias("url"),
        *auction_fields(F.col("html"), now, rate), F.col("fetched_at").alias("scraped_at"))


def _stamp(c: Column) -> Column:
    return D.iso_stamp(c)


def extract_auction_cards(pages: DataFrame) -> DataFrame:
    """Auctions from the cards of a list page."""
    cards = pages.select("page_id", F.explode(H.segments(F.col("html"), CARD_OPENING, whole_page=False)).alias("card"))
    t = F.col("text")
    rows = once(cards, ["page_id"], group(F.col("card"), r'href="[^"]*/properties/(\d+)').alias("id"), H.flat_text(F.col("card")).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.contains(t, F.lit("EUR")) | F.contains(t, F.lit("СРОК"))))

    def found(pattern: str, idx: int = 1) -> Column:
        return F.regexp_extract(t, f"(?iU){pattern}", idx)

    def field(name: str) -> Column:
        return strip(blank_to_null(F.col(f"_{name}")))

    texts = {"price": found(CARD["price"]), "city": found(CARD["city"][0]), "town": found(CARD["city"][1]), "address": found(CARD["address"]),
             "court": found(CARD["court"]), "executor": found(CARD["executor"]), "start": found(CARD["term"], 1), "end": found(CARD["term"], 2),
             "announce": found(CARD["announce"])}
    rows = once(rows, ["page_id", "id"], *[c.alias(f"_{name}") for name, c in texts.items()])
    return rows.select(
        "page_id", "id", T.leading_number(field("price")).alias("price_eur"), F.coalesce(field("city"), field("town")).alias("city"),
        field("address").alias("address"), field("court").alias("court"), field("executor").alias("executor"),
        _stamp(field("start")).alias("bid_start"), _stamp(field("end")).alias("bid_end"), _stamp(field("announce")).alias("announce_date"),
        F.concat(F.lit(L.AUCTION_URL), "id").alias("url"))


def extract_auction_blocks(pages: DataFrame) -> DataFrame:
    """Auctions from running text: what stands between an id and its neighbours.

    The price is looked for right before the id first; all other fields after the id first,
    so that what belongs to the id before does not count.
    """
    text = H.flat_text(F.col("html"))
    cut = pages.select("page_id", F.split(text, r"/properties/\d+").alias("parts"),
                       H.all_matches(text, r"/properties/(\d+)").alias("ids"))
    each = cut.select("page_id", "parts", F.posexplode("ids").alias("i", "id"))
    rows = each.select("page_id", "id", F.get("parts", F.col("i")).alias("before"), F.get("parts", F.col("i") + 1).alias("after"))

    def field(pattern: str, idx: int = 1) -> Column:
        return F.coalesce(*[strip(group(F.col(side), pattern, idx, "iU")) for side in ("after", "before")])

    price = F.coalesce(group(F.col("before"), BLOCK["price"][0], flags="iU"), field(BLOCK["price"][1]))
    return rows.select(
        "page_id", "id", T.leading_number(price).alias("price_eur"), field(BLOCK["city"]).alias("city"),
        field(BLOCK["court"]).alias("court"), _stamp(field(BLOCK["term"], 1)).alias("bid_start"),
        _stamp(field(BLOCK["term"], 2)).alias("bid_end"), _stamp(field(CARD["announce"])).alias("announce_date"),
        F.concat(F.lit(L.AUCTION_URL), "id").alias("url"))


