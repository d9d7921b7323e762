"""Pages with more than the scraper's limits, and values that were read wrongly."""

import pytest
from compframe.functions import text as T
from compframe.operators import extract_adverts as X
from compframe.operators import extract_auctions as A
from compframe.operators import extract_posts as W
from compframe.operators.ranking import newest
from compframe.sources.readers import AGENCY_CHARSETS, decode_text
from pyspark.sql import functions as F


def page(spark, html, **more):
    df = spark.createDataFrame([(1, html, "Русе")], "page_id long, html string, city string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_every_link_of_a_page(spark):
    html = "".join(f'<a href="/obiava-{i}-prodava-apartament">x</a>' for i in range(45))
    assert X.extract_index_links(page(spark, html)).count() == 45
    assert X.extract_index_links(page(spark, html), cap=30).count() == 30


@pytest.mark.parametrize("read, opening", [(X.extract_param_cards, 'div class="listtop-item-params"'), (X.extract_rendered_cards, 'div data-cy="l-card"')])
def test_every_card_of_a_page(spark, read, opening):
    bad = f"<{opening}>без цена</div>" * 70
    html = bad + "".join(f"<{opening}>Двустаен {i + 20} 900 € {i + 20} кв.м</div>" for i in range(75))
    assert read(page(spark, html)).count() == 75
    assert read(page(spark, html), cap=60).count() == 60


def test_rows_and_posts_are_known_by_their_whole_text(spark):
    same = "еднакво начало " * 10
    rows = "".join(f"<tr><td>{same} {i} кв.м {i} 000 EUR</td></tr>" for i in (20, 30, 40, 40))
    assert X.extract_table_rows(page(spark, rows)).count() == 3
    ids = spark.createDataFrame([(same + "a",), (same + "b",)], "t string").select(T.post_id(F.lit(None).cast("string"), F.col("t"))).distinct()
    assert ids.count() == 2


def test_a_listing_reaches_to_the_next_link(spark):
    def listing(i, filler):
        return f'<a href="https://ag1.imot.bg/obiava-{i}-prodava-x-grad-sofiya-y">t</a> {filler} <b>{i}0 000 €</b>, {i}5 кв.м '
    html = listing(4, "дума " * 500) + listing(6, "") + '<a href="https://ag1.imot.bg/obiava-4-prodava-x-grad-sofiya-y">пак</a>, 2008 г.'
    got = {r.listing_code: (r.price_eur, r.area_sqm, r.construction_year) for r in X.extract_agency_listings(page(spark, html, agency="ag1")).collect()}
    assert got == {"4": (40000.0, 45.0, 2008), "6": (60000.0, 65.0, None)}


def test_a_block_has_its_own_fields(spark):
    far = "ж" * 900
    html = f"5 100.00 EUR /properties/7 {far} гр. Русе, ОКРЪЖЕН СЪД: Видин\n 6 200.00 EUR /properties/8 {far} гр. Варна, x"
    got = {r.id: (r.price_eur, r.city, r.court) for r in A.extract_auction_blocks(page(spark, html)).collect()}
    assert got["7"] == (5100.0, "Русе", "Видин") and got["8"][:2] == (6200.0, "Варна")


def test_long_addresses_stay_whole(spark):
    address = "ул. " + "Шипка " * 40 + "5"
    q = spark.createDataFrame([(address,)], "a string").select(T.geocode_query("a", F.lit("гр. Русе"))).first()[0]
    assert q == address + ", Русе, България"


def test_an_empty_block_gives_no_floor(spark):
    floor = lambda html: spark.createDataFrame([(html,)], "h string").select(A._floor(F.col("h"))).first()[0]
    assert floor('<div class="info"></div><p>ет. 7</p>') is None
    assert floor("<p>ет. 7</p>") == 7 and floor('<div class="info">ет. 3</div><p>ет. 7</p>') == 3


def test_entities(spark):
    cases = {"m&sup2; &euro;5 &#8364;": "m² €5 €", "&#x20AC;&#X1F600;": "€😀", "&amp;lt;": "&lt;", "&#0; &#55296; &#99999999; &#; &#x;": "&#0; &#55296; &#99999999; &#; &#x;",
             "no entity": "no entity", "&#39;&#x27;&apos;": "'''", None: None, "": "", "a & b": "a & b", "&nbsp;": "\u00a0"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.unescape("t").alias("u")).collect()
    assert {r.t: r.u for r in got} == cases


def test_post_prices_in_both_readings(spark):
    df = spark.createDataFrame([("€50,000",), ("50000 лева",), ("50000 лв",), ("120 000 EUR",)], "t string")
    both = [[None if r[0] is None else tuple(r[0]) for r in df.select(W.post_price(F.col("t"), c)).collect()] for c in (True, False)]
    assert both[0] == [None, (50000.0, "EUR"), (50000.0, "BGN"), (120000.0, "EUR")]
    assert both[1] == [(50000.0, "EUR"), (50000.0, "BGN"), (50000.0, "BGN"), (120000.0, "EUR")]


def test_code_pages(spark):
    rows = [("Цена 5 € № ё".encode("cp1251"), "Цена 5 € № ё"), (b"\x98\xd0\x96".replace(b"\x98", b"\xc3\x98"), "Ø" + "Ж"), (b"\xe9\x98", "é\x98"), (b"", ""), (None, None)]
    got = spark.createDataFrame([(bytes(b) if b is not None else None,) for b, _ in rows], "b binary").select(decode_text(F.col("b"), AGENCY_CHARSETS)).collect()
    assert [r[0] for r in got] == [t for _, t in rows]


def test_newest_needs_a_number(spark):
    with pytest.raises(TypeError):
        newest(spark.range(1))


OPEN = '<div class="card'


@pytest.mark.parametrize("html, want", [
    # text behind, between and before cards belongs to none
    ('70 000 € <div class="card">65 кв.м</div> 80 000 € <div class="card">90 000 €</div> 44 кв.м', ["65 кв.м", "90 000 €"]),
    # elements inside, nested ones of the same name included
    ('<div class="card"><div><p>a<div>b</div></p></div>c</div>d</div>', ["abc"]),
    # a card inside a card is both its own and the outer one's
    ('<div class="card">a<div class="card">b</div>c</div>d<DIV class="card">e</DIV>', ["abc", "b", "e"]),
    # other names that begin alike, and upper case
    ('<div class="card">a<divider>b</divider></DIV>c', ["ab"]),
    # a page that closes nothing: up to the next card
    ('<div class="card">a<div class="card">b', ["a", "b"]),
    ('<p>no card</p>', []), ('', []), (None, None)])
def test_a_card_ends_with_its_element(spark, html, want):
    from compframe.operators import markup as H
    df = spark.createDataFrame([(html,)], "html string")
    cards = df.select(H.segments(F.col("html"), OPEN, whole_page=False).alias("c")).select(F.transform("c", H.flat_text).alias("t")).first().t
    assert cards == want


def test_a_footer_gives_no_advert(spark):
    html = '<div class="listtop-item-params">Двустаен 65 кв.м</div><footer>Цена: 90 000 €</footer>'
    assert X.extract_param_cards(page(spark, html)).count() == 0
    inside = html.replace("</div>", "<div>Цена: 90 000 €</div></div>")
    assert [(r.size_sqm, r.price_eur) for r in X.extract_param_cards(page(spark, inside)).collect()] == [(65.0, 90000.0)]


@pytest.mark.parametrize("text", [
    "a&nbsp;b", "&Agrave;&yuml;&hearts;", "&amp;lt; &#38;nbsp; &amp;amp;", "&#8364; &#x20AC; &#X41;", "&zzz; & &; &&amp;&", "no reference", "",
    "&acE;&lt;tag&gt;&CounterClockwiseContourIntegral;"])
def test_references_are_decoded_once(spark, text):
    import html
    got = spark.createDataFrame([(text,)], "t string").select(T.unescape("t")).first()[0]
    assert got == html.unescape(text)


def test_card_fields_are_searched_once(spark):
    """Every pattern and the text of a card stand once in the optimized plan, although columns and filters share them."""
    from compframe.operators import extract_adverts, extract_auctions
    pages = spark.createDataFrame([(1, "София", "x", "<article>1</article>")], "page_id long, city string, facet string, html string").withColumn(
        "fetched_at", F.current_timestamp())

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert plan(extract_auctions.extract_auction_cards(pages)).count(extract_auctions.CARD["price"]) == 1
    assert plan(extract_adverts.extract_cards(pages, sale_floor=True)).count(extract_adverts.CARD_PRICE) == 2  # a group each
