"""Queries that write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from compframe.catalog import standin as S
from compframe.catalog.registry import query
from compframe.operators import joins
from compframe.session import new_path
from compframe.sources import readers as R
from compframe.sources import writers as W

COLS = ["id", "city", "price", "effective_price", "sqm", "comparables_count", "market_price", "discount", "auction_end"]
DEALS = f"WITH {S.deals_sql()} SELECT {', '.join(COLS)} FROM deals"


def folder(spark, name):
    return new_path(spark, name)


@query("deals_lines", DEALS)
def deals_lines(spark, sf):
    """Deals written as JSON lines and read back."""
    path = folder(spark, "deals")
    W.write_deals(S.deals(spark, sf), path, S.now())
    return R.read_deals(spark, f"{path}/deals", form="lines").select(*COLS)


@query("published_on_ok", f"WITH {S.deals_sql()} SELECT 'ok' AS verdict, count(*) AS deals FROM deals UNION ALL SELECT 'incomplete', 0")
def published_on_ok(spark, sf):
    """Published after a complete run, not after one with a town missing."""
    from compframe.operators import quality as Q
    got = S.market(spark, sf).groupBy("city", "source").agg(F.count("*").alias("n")).withColumn("success", F.col("n") >= 5)
    grid = got.select("city", "source")  # what was delivered was expected
    missing = grid.unionByName(grid.limit(1).withColumn("city", F.lit("Липсва")))
    out = []
    for name, expected in (("full", grid), ("short", missing)):
        path = folder(spark, name)
        said = W.publish_if_ok(S.deals(spark, sf), Q.run_verdict(expected, got), path, S.now())
        deals = R.read_deals(spark, f"{path}/deals", form="lines") if said == "ok" else S.deals(spark, sf).where("false")
        out.append(deals.agg(F.lit(said).alias("verdict"), F.count("*").alias("deals")))
    return out[0].unionByName(out[1])


@query("deals_document", f"WITH {S.deals_sql()} SELECT CAST(count(*) + 2 AS BIGINT) AS lines, count(*) FILTER (WHERE discount > 0) AS discounted FROM deals")
def deals_document(spark, sf):
    """Lines of the envelope document, written and read back."""
    path = folder(spark, "document")
    W.write_deals_document(S.deals(spark, sf), path, S.now())
    lines = spark.read.text(path)
    return lines.agg(F.count("*").alias("lines"), F.count_if(
        F.get_json_object(F.regexp_replace("value", "^,", ""), "$.discount").cast("double") > 0).alias("discounted"))


@query("market_snapshot", f"WITH {S.market_sql()} SELECT size_sqm, price_eur, source FROM market WHERE city = 'Варна'")
def market_snapshot(spark, sf):
    """Market extract stored by town; one town read back."""
    path = folder(spark, "snapshot")
    W.snapshot(S.market(spark, sf).select("city", "size_sqm", "price_eur", "source"), path)
    return R.read_snapshot(spark, path, "Варна").select("size_sqm", "price_eur", "source")


@query("source_partitions", f"WITH {S.market_sql()} SELECT source, CASE WHEN source = 'alo.bg' THEN count(*) FILTER (WHERE rooms = 2) ELSE count(*) END AS n FROM market GROUP BY source")
def source_partitions(spark, sf):
    """One source's partition replaced in the stored table (T5)."""
    path = folder(spark, "store")
    m = S.market(spark, sf).select("city", "size_sqm", "price_eur", "rooms", "source")
    W.write_source(m, path)
    W.write_source(m.where("source = 'alo.bg' AND rooms = 2"), path)
    return spark.read.parquet(path).groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))


@query("decoded_pages", "SELECT page_id, html FROM pages")
def decoded_pages(spark, sf):
    """Pages stored as bytes, decoded."""
    path = folder(spark, "pages")
    S.table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")).write.parquet(path)
    return R.read_raw_pages(spark, path)


@query("read_auctions", f"WITH {S.auctions_sql()} SELECT id, city, price_eur, size_sqm, property_type FROM auctions WHERE NOT is_expired AND size_sqm > 0 AND price_eur > 0")
def read_auctions(spark, sf):
    """Auctions stored and read as the export reads them."""
    path = folder(spark, "auctions")
    S.auctions(spark, sf).write.parquet(path)
    return R.read_auctions(spark, path).select("id", "city", "price_eur", "size_sqm", "property_type")


RULES = [
    "CAST(c_custkey AS BIGINT) AS user_id",
    "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (" + S.pick(f"c_custkey % {len(S.CITIES)}", S.CITIES) + ") END AS city",
    "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 20 * 5000 AS DOUBLE) END AS min_price",
    "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 20 * 5000 + 2000 AS DOUBLE) END AS max_price",
    "CASE WHEN c_custkey % 6 = 0 THEN 'изток' ELSE NULL END AS keyword", "c_custkey % 10 <> 0 AS active",
]


@query("rule_match", f"WITH {S.deals_sql()}, rules AS (SELECT {', '.join(RULES)} FROM customer) SELECT r.user_id, count(*) AS deals, min(d.price) AS cheapest FROM rules r JOIN deals d "
       "ON (r.city IS NULL OR d.city = r.city) AND (r.min_price IS NULL OR d.price >= r.min_price) AND (r.max_price IS NULL OR d.price <= r.max_price) "
       "AND (r.keyword IS NULL OR contains(lower(d.neighborhood), r.keyword)) WHERE r.active GROUP BY r.user_id")
def rule_match(spark, sf):
    """Deals per alert rule, null meaning any."""
    rules = S.table(spark, sf, "customer").selectExpr(*RULES).withColumn(
        "keywords", F.when(F.col("keyword").isNotNull(), F.array("keyword"))).drop("keyword")
    return joins.rule_summary(rules, S.deals(spark, sf).withColumn("text", F.col("neighborhood")))
