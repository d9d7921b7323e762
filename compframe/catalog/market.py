"""Queries over the comparables store and the auctions table."""

from __future__ import annotations

from pyspark.sql import functions as F

from compframe import lookups as L
from compframe.catalog import checks as C
from compframe.catalog import standin as S
from compframe.catalog.registry import query
from compframe.functions import text as T
from compframe.operators import aggregates as G
from compframe.operators import comparables as M
from compframe.operators import filters, incremental as I
from compframe.operators import quality as Q
from compframe.operators import ranking as R
from compframe.plans import export as E

MARKET = f"WITH {S.market_sql()}"
AUCTIONS = f"WITH {S.auctions_sql()}"
LATE = "2001-10-30 12:00:00"
SQL_LATE = f"TIMESTAMP '{LATE}'"


def late():
    return F.lit(LATE).cast("timestamp")


@query("town_size_median", f"WITH {C.TABLES}, {C.EXPORTABLE}, ask AS (SELECT DISTINCT city, size_sqm AS size FROM uniq), "
       "near AS (SELECT a.city, a.size, m.price_per_sqm FROM ask a JOIN market m ON m.city = a.city "
       "AND m.size_sqm BETWEEN a.size - 10 AND a.size + 10 AND m.price_per_sqm > 200 AND m.price_per_sqm < 5000) "
       "SELECT city, size, count(*) AS n, list_sort(list(price_per_sqm))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, "
       "min(price_per_sqm) AS pps_min, max(price_per_sqm) AS pps_max FROM near GROUP BY ALL HAVING count(*) >= 3")
def town_size_median(spark, sf):
    """Town and size +-10 m2 alone."""
    rows = R.dedupe_auctions(E.exportable(S.auctions(spark, sf), S.now()))
    return M.city_size_median(rows, S.market(spark, sf))


PAIRS = (f"WITH {C.TABLES}, " + C.norm_cte("norms", "SELECT neighborhood AS h FROM market UNION ALL SELECT neighborhood AS h FROM auctions"))


@query("similarity_pairs", f"{PAIRS}, a AS (SELECT DISTINCT trim(replace(x.city, 'гр. ', '')) AS city, n.norm FROM auctions x JOIN norms n ON n.h = x.neighborhood), "
       f"b AS (SELECT DISTINCT x.city, n.norm FROM market x JOIN norms n ON n.h = x.neighborhood) SELECT city, l_hood, r_hood, similarity FROM "
       f"(SELECT a.city, a.norm AS l_hood, b.norm AS r_hood, {C.similarity_case('a.norm', 'b.norm')} AS similarity FROM a JOIN b ON a.city = b.city) WHERE similarity >= 0.7")
def similarity_pairs(spark, sf):
    """Similar districts of the same town."""
    a = S.auctions(spark, sf).select("neighborhood", T.clean_city("city").alias("city"))
    b = S.market(spark, sf).select("city", "neighborhood")
    return M.similar_hoods(*[M.normal_names(x, "neighborhood", "hood").select("city", "hood").distinct() for x in (a, b)])


@query("hood_range", f"{PAIRS}, sub AS (SELECT DISTINCT trim(replace(x.city, 'гр. ', '')) AS city, n.norm AS hood FROM auctions x JOIN norms n ON n.h = x.neighborhood), "
       "ok AS (SELECT m.city, n.norm, m.price_per_sqm AS pps FROM market m JOIN norms n ON n.h = m.neighborhood WHERE price_per_sqm > 200 AND price_per_sqm < 5000), "
       "per AS (SELECT city, norm, min(pps) AS lo, max(pps) AS hi FROM ok GROUP BY ALL) "
       f"SELECT s.city, s.hood, min(lo) AS range_lo, max(hi) AS range_hi FROM sub s JOIN per p ON p.city = s.city WHERE {C.similarity_case('s.hood', 'p.norm')} >= 0.7 GROUP BY ALL")
def hood_range(spark, sf):
    """Price range of similar districts."""
    cfg = M.ValuationConfig()
    cells = M.staged(M.sane_market(S.market(spark, sf), cfg).groupBy("city", "hood").agg(
        F.min("pps").alias("pps_min"), F.max("pps").alias("pps_max")).where(F.col("hood") != ""), "range-cells")
    subj = S.auctions(spark, sf).select(T.clean_city("city").alias("city"), "neighborhood")
    keys = M.normal_names(subj, "neighborhood", "hood")
    ranges = cells.select("city", "hood", F.explode(F.array("pps_min", "pps_max")).alias("pps"))
    return G.hood_range(M.market_pairs(keys, cells, cfg), ranges)


STATS = "count(*) AS listings, round(avg(price_per_sqm), 0) AS avg_pps FROM market WHERE price_per_sqm IS NOT NULL GROUP BY"


@query("market_by_source", f"{MARKET} SELECT source, {STATS} source")
def market_by_source(spark, sf):
    return G.price_stats_by(S.market(spark, sf), "source")


@query("market_by_city", f"{MARKET} SELECT city, {STATS} city")
def market_by_city(spark, sf):
    return G.price_stats_by(S.market(spark, sf), "city").orderBy(F.col("listings").desc())


@query("city_medians", f"{MARKET} SELECT city, count(*) AS n, list_sort(list(price_per_sqm))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM market GROUP BY city")
def city_medians(spark, sf):
    """Upper median per town (A1)."""
    return G.upper_median(S.market(spark, sf).select("city", "price_per_sqm"), ["city"], "price_per_sqm", 50.0)


@query("city_quartiles", f"{MARKET} SELECT city, round(median(price_eur), 6) AS median, quantile_disc(price_eur, 0.25) AS low, quantile_disc(price_eur, 0.75) AS high FROM market GROUP BY city")
def city_quartiles(spark, sf):
    """Interpolated median and nearest-rank quartiles (A2, A3)."""
    out = G.quartiles(S.market(spark, sf).select("city", "price_eur"), ["city"], "price_eur", 1000.0)
    return out.withColumn("median", F.round("median", 6))


@query("active_by_type", f"{AUCTIONS} SELECT property_type, count(*) AS n FROM auctions WHERE NOT is_expired GROUP BY 1")
def active_by_type(spark, sf):
    return G.active_by(S.auctions(spark, sf), "property_type")


@query("active_top_cities", f"{AUCTIONS} SELECT city, count(*) AS n FROM auctions WHERE NOT is_expired GROUP BY 1 ORDER BY n DESC, city NULLS FIRST LIMIT 10")
def active_top_cities(spark, sf):
    return G.active_by(S.auctions(spark, sf), "city", top=10)


@query("active_total", f"{AUCTIONS} SELECT count(*) FILTER (WHERE NOT is_expired) AS active, count(*) AS total FROM auctions")
def active_total(spark, sf):
    return S.auctions(spark, sf).agg(F.count_if(~F.col("is_expired")).alias("active"), F.count("*").alias("total"))


@query("distinct_cities", f"{AUCTIONS} SELECT DISTINCT city FROM auctions")
def distinct_cities(spark, sf):
    return G.distinct_cities(S.auctions(spark, sf))


@query("top_hoods", f"{AUCTIONS} SELECT * FROM (SELECT city, neighborhood, n, CAST(row_number() OVER (PARTITION BY city ORDER BY n DESC, neighborhood) AS INTEGER) AS place "
       "FROM (SELECT city, neighborhood, count(*) AS n FROM auctions WHERE NOT is_expired AND neighborhood IS NOT NULL GROUP BY ALL)) WHERE place <= 5")
def top_hoods(spark, sf):
    return G.top_hoods(S.auctions(spark, sf))


@query("district_coverage", f"{AUCTIONS} SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(neighborhood, '') <> '') AS known, "
       "count(*) FILTER (WHERE coalesce(neighborhood, '') <> '') * 100.0 / count(*)::DOUBLE AS pct FROM auctions WHERE NOT is_expired")
def district_coverage(spark, sf):
    return G.coverage(S.auctions(spark, sf).where(~F.col("is_expired")), F.coalesce("neighborhood", F.lit("")) != "")


COURTS = "SELECT o_orderpriority AS court, CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE o_totalprice END AS price_eur, o_orderkey AS id FROM orders"


def court_listings(spark, sf):
    return S.table(spark, sf, "orders").selectExpr(
        "o_orderpriority AS court", "CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE o_totalprice END AS price_eur", "o_orderkey AS id")


@query("court_stats", f"SELECT court, count(*) AS n, min(price_eur) FILTER (WHERE price_eur > 0) AS min_price, max(price_eur) FILTER (WHERE price_eur > 0) AS max_price, "
       f"round(avg(price_eur) FILTER (WHERE price_eur > 0), 2) AS avg_price FROM ({COURTS}) GROUP BY court")
def court_stats(spark, sf):
    return G.court_stats(court_listings(spark, sf))


@query("cheapest", f"SELECT id, court, price_eur FROM ({COURTS}) WHERE price_eur > 0 AND price_eur <= 50000 ORDER BY price_eur, id LIMIT 20")
def cheapest(spark, sf):
    return R.cheapest(court_listings(spark, sf), 50000).select("id", "court", "price_eur")


@query("run_log", "SELECT user_id AS run_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS pages, count(*) AS seen, "
       "sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS saved, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, "
       "sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS added FROM events GROUP BY 1")
def run_log(spark, sf):
    """Totals per run (A14); a user's events stand for the steps of one run."""
    def one(kind):
        return F.when(F.col("event_type") == kind, 1).otherwise(0)
    steps = S.table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), one("view").alias("pages"), F.lit(1).alias("seen"),
        one("purchase").alias("saved"), one("error").alias("errors"), one("signup").alias("added"))
    return G.run_log(steps)


@query("keep_latest", f"{MARKET}, m AS (SELECT * REPLACE (CASE WHEN rooms IS NULL THEN NULL ELSE floor(price_eur / 20000) * 20000 END AS price_eur, floor(size_sqm / 20) * 20 AS size_sqm) FROM market) "
       "SELECT city, size_sqm, price_eur, source, CAST(scraped_at AS VARCHAR) AS scraped_at, neighborhood, rooms FROM m WHERE price_eur IS NULL UNION ALL "
       "SELECT city, size_sqm, price_eur, source, CAST(scraped_at AS VARCHAR), neighborhood, rooms FROM (SELECT *, row_number() OVER (PARTITION BY city, size_sqm, price_eur, source "
       "ORDER BY scraped_at DESC, neighborhood NULLS FIRST, price_per_sqm NULLS FIRST, rooms NULLS FIRST) AS rn FROM m WHERE price_eur IS NOT NULL) WHERE rn = 1")
def keep_latest(spark, sf):
    """Insert-or-replace by (city, size, price, source)."""
    m = S.market(spark, sf).withColumns({  # coarse prices and sizes, so that keys repeat
        "price_eur": F.when(F.col("rooms").isNotNull(), F.floor(F.col("price_eur") / 20000) * 20000).cast("double"),
        "size_sqm": (F.floor(F.col("size_sqm") / 20) * 20).cast("double")})
    return R.keep_latest(m).select("city", "size_sqm", "price_eur", "source",
                                   F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"), "neighborhood", "rooms")


@query("cap_per_group", f"{MARKET} SELECT city, source, size_sqm, price_eur, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER "
       "(PARTITION BY city, source ORDER BY scraped_at, size_sqm, price_eur) AS rn FROM market) WHERE rn <= 60")
def cap_per_group(spark, sf):
    """First 60 rows per town and source."""
    order = [F.col(c).asc() for c in ("scraped_at", "size_sqm", "price_eur")]
    return R.top_per_group(S.market(spark, sf), ["city", "source"], order, 60, rank="place").select(
        "city", "source", "size_sqm", "price_eur", "place")


@query("dedupe_auctions", f"{AUCTIONS} SELECT id, price_eur FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(address, ''), round_even(price_eur, 0), "
       f"{C.py_round('size_sqm', 1)}, property_type, floor ORDER BY price_eur, id) AS rn FROM auctions) WHERE rn = 1")
def dedupe_auctions(spark, sf):
    return R.dedupe_auctions(S.auctions(spark, sf)).select("id", "price_eur")


@query("ingest_ranges", f"{MARKET} SELECT source, count(*) AS n, count(*) FILTER (WHERE size_sqm BETWEEN 15 AND 500 AND price_per_sqm BETWEEN 200 AND 15000) AS ok, "
       "count(*) FILTER (WHERE size_sqm BETWEEN 15 AND 500 AND price_eur BETWEEN 10000 AND 2000000) AS price_ok, count(*) FILTER (WHERE price_eur >= 15000) AS sale FROM market GROUP BY source")
def ingest_ranges(spark, sf):
    """Inclusive ingest ranges."""
    m = S.market(spark, sf)
    return m.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(filters.ingest_ok(m.size_sqm, m.price_per_sqm)).alias("ok"),
        F.count_if(filters.ingest_price_ok(m.price_eur, m.size_sqm)).alias("price_ok"),
        F.count_if(filters.above_sale_floor(m.price_eur)).alias("sale"))


@query("market_dump", f"{MARKET} SELECT city, size_sqm, price_eur, price_per_sqm, rooms, source FROM market")
def market_dump(spark, sf):
    """Store dump in published order, without the district."""
    return S.market(spark, sf).select("city", "size_sqm", "price_eur", "price_per_sqm", "rooms", "source").orderBy(
        "city", "price_per_sqm")


# ---------------------------------------------------------------- state between runs

SNAP = f"WITH {S.snapshot_sql()}"


@query("snapshot_diff", f"{SNAP}, live AS (SELECT id FROM known WHERE NOT is_expired) "
       "SELECT id, 'new' AS change FROM current_ids WHERE id NOT IN (SELECT id FROM live) UNION ALL SELECT id, 'gone' FROM live WHERE id NOT IN (SELECT id FROM current_ids)")
def snapshot_diff(spark, sf):
    """New and gone ids."""
    return I.snapshot_diff(S.known(spark, sf).where(~F.col("is_expired")), S.current_ids(spark, sf))


STAMPS = "CAST(scraped_at AS VARCHAR) AS scraped_at, CAST(first_seen_at AS VARCHAR) AS first_seen_at, CAST(last_updated_at AS VARCHAR) AS last_updated_at"
PASSED = "coalesce(try_strptime(CASE WHEN regexp_matches(auction_end, '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$') THEN auction_end END, '%d.%m.%Y') < " + C.NOW + ", false)"


def stamps(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("scraped_at", "first_seen_at", "last_updated_at")})


@query("incremental_merge", f"{SNAP}, live AS (SELECT id FROM known WHERE NOT is_expired), "
       "fresh AS (SELECT d.* FROM details d WHERE d.id IN (SELECT id FROM current_ids) AND d.id NOT IN (SELECT id FROM live) AND NOT d.is_expired), "
       f"merged AS (SELECT f.id, f.address, f.price_eur, f.auction_end, false AS is_expired, {C.NOW} AS scraped_at, coalesce(k.first_seen_at, {C.NOW}) AS first_seen_at, {C.NOW} AS last_updated_at "
       "FROM fresh f LEFT JOIN known k ON k.id = f.id UNION ALL SELECT k.id, k.address, k.price_eur, k.auction_end, "
       "k.is_expired OR k.id NOT IN (SELECT id FROM current_ids), k.scraped_at, k.first_seen_at, "
       f"CASE WHEN NOT k.is_expired AND k.id NOT IN (SELECT id FROM current_ids) THEN {C.NOW} ELSE k.last_updated_at END "
       "FROM known k WHERE k.id NOT IN (SELECT id FROM fresh)), "
       f"aged AS (SELECT * REPLACE (is_expired OR {PASSED} AS is_expired, CASE WHEN NOT is_expired AND {PASSED} THEN {C.NOW} ELSE last_updated_at END AS last_updated_at) FROM merged) "
       f"SELECT id, address, price_eur, auction_end, is_expired, {STAMPS} FROM aged")
def incremental_merge(spark, sf):
    """State after an incremental run."""
    return stamps(I.incremental_merge(S.known(spark, sf), S.current_ids(spark, sf), S.details(spark, sf), S.now()))


@query("full_refresh", f"{SNAP} SELECT id, price_eur, is_expired, CAST({C.NOW} AS VARCHAR) AS first_seen_at FROM details")
def full_refresh(spark, sf):
    """State after a full load."""
    out = I.full_refresh(S.details(spark, sf), S.now())
    return out.select("id", "price_eur", "is_expired", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen_at"))


@query("expire_by_date", f"{SNAP} SELECT id, is_expired OR {PASSED} AS is_expired, CAST(CASE WHEN NOT is_expired AND {PASSED} THEN {C.NOW} ELSE last_updated_at END AS VARCHAR) AS last_updated_at FROM known")
def expire_by_date(spark, sf):
    return stamps(I.expire_by_date(S.known(spark, sf), S.now())).select("id", "is_expired", "last_updated_at")


@query("retain", f"{MARKET} SELECT city, source, size_sqm, price_eur FROM market WHERE scraped_at >= {SQL_LATE} - INTERVAL 7 DAY")
def retain(spark, sf):
    """Seven-day retention (T4)."""
    return I.retain(S.market(spark, sf), late()).select("city", "source", "size_sqm", "price_eur")


@query("replace_source", f"{MARKET} SELECT city, source, size_sqm, price_eur FROM market WHERE source <> 'alo.bg' UNION ALL "
       f"SELECT city, source, size_sqm, price_eur * 2 FROM market WHERE source = 'alo.bg' AND rooms = 2")
def replace_source(spark, sf):
    """One source exchanged for a new extract."""
    m = S.market(spark, sf).select("city", "source", "size_sqm", "price_eur", "rooms")
    extract = m.where(F.col("rooms") == 2).withColumn("price_eur", F.col("price_eur") * 2)
    return I.replace_source(m.drop("rooms"), extract.drop("rooms"), L.PARAM_PORTAL)


@query("upsert_first_seen", f"{SNAP} SELECT coalesce(k.id, d.id) AS id, CASE WHEN d.id IS NOT NULL THEN d.price_eur ELSE k.price_eur END AS price_eur, "
       f"CAST(coalesce(k.first_seen_at, {C.NOW}) AS VARCHAR) AS first_seen, CAST(CASE WHEN d.id IS NOT NULL THEN {C.NOW} ELSE k.last_updated_at END AS VARCHAR) AS last_seen, "
       "CASE WHEN d.id IS NOT NULL THEN true ELSE NOT k.is_expired END AS is_active FROM known k FULL JOIN details d ON d.id = k.id")
def upsert_first_seen(spark, sf):
    """Upsert that keeps first_seen."""
    known = S.known(spark, sf).select("id", "price_eur", F.col("first_seen_at").alias("first_seen"),
                                      F.col("last_updated_at").alias("last_seen"), (~F.col("is_expired")).alias("is_active"))
    out = I.upsert_keep_first_seen(known, S.details(spark, sf).select("id", "price_eur"), S.now())
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c in L.MARKET_CITIES for s in L.DEAL_SOURCES) + ") AS g(city, source))"
LEDGER = "ledger AS (SELECT city, source, max(scraped_at) AS completed_at, count(*) AS n FROM market GROUP BY ALL)"


def ledger(spark, sf):
    """One row per town and source, completed at its newest advert."""
    return S.market(spark, sf).groupBy("city", "source").agg(
        F.max("scraped_at").alias("completed_at"), F.count("*").alias("n"))


@query("resume_pending", f"{MARKET}, {GRID}, {LEDGER} SELECT city, source FROM grid WHERE (city, source) NOT IN "
       "(SELECT (city, source) FROM ledger WHERE CAST(completed_at AS DATE) = DATE '2001-10-28')")
def resume_pending(spark, sf):
    """Pairs still to do today."""
    return I.pending_pairs(Q.expected_grid(spark), ledger(spark, sf), F.lit("2001-10-28").cast("date"))


@query("ledger_kept", f"{MARKET}, {LEDGER} SELECT city, source, n FROM ledger WHERE CAST(completed_at AS DATE) >= DATE '2001-10-28'")
def ledger_kept(spark, sf):
    return I.trim_ledger(ledger(spark, sf), late()).select("city", "source", "n")


@query("grid_completeness", f"{MARKET}, {GRID}, got AS (SELECT city, source, count(*) AS n FROM market GROUP BY ALL) "
       "SELECT g.city, g.source, coalesce(n, 0) AS n, coalesce(n, 0) >= 5 AS success, CASE WHEN coalesce(n, 0) >= 5 THEN '' "
       "ELSE 'Too few listings: ' || coalesce(n, 0) || ' < 5' END AS error FROM grid g LEFT JOIN got ON got.city = g.city AND got.source = g.source")
def grid_completeness(spark, sf):
    """Rows per expected town and source."""
    return Q.grid_completeness(Q.expected_grid(spark), S.market(spark, sf))


@query("run_verdict", f"{MARKET}, {GRID}, got AS (SELECT city, source, count(*) AS n, count(*) >= 5 AS success FROM market GROUP BY ALL), "
       "j AS (SELECT g.*, n, success FROM grid g LEFT JOIN got ON got.city = g.city AND got.source = g.source) "
       "SELECT CASE WHEN bool_or(success IS NULL) THEN 'incomplete' WHEN bool_or(NOT success) THEN 'failed' ELSE 'ok' END AS verdict, "
       "coalesce(CAST(sum(n) FILTER (WHERE success) AS BIGINT), 0) AS listings FROM j")
def run_verdict(spark, sf):
    """All-or-nothing verdict of a run."""
    got = S.market(spark, sf).groupBy("city", "source").agg(F.count("*").alias("n"))
    return Q.run_verdict(Q.expected_grid(spark), got.withColumn("success", F.col("n") >= 5))


SUPPLEMENTS = ", ".join(f"('{c}', '{h}', '{s}')" for c, rows in L.SEARCH_SUPPLEMENTS.items() for h, s in rows)


@query("uncovered_supplements", f"{MARKET} SELECT c.city, c.label, c.slug FROM (VALUES {SUPPLEMENTS}) AS c(city, label, slug) WHERE NOT EXISTS "
       "(SELECT 1 FROM market m WHERE m.source = 'olx.bg' AND m.city = c.city AND lower(m.neighborhood) = lower(c.label))")
def uncovered_supplements(spark, sf):
    """Search supplements that no discovered district covers."""
    return I.uncovered_supplements(S.market(spark, sf))


@query("new_orders", "SELECT o_orderkey AS id, o_totalprice AS price_eur FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def new_orders(spark, sf):
    """Listings not stored yet."""
    rows = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price_eur"))
    stored = S.table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    return I.unseen(rows, stored, "id")


COPY = (f"WITH {S.subscribers_sql()}, src AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'shared' || CAST(id % 30 AS VARCHAR) ELSE lower(trim(email)) END AS email FROM subscribers), "
        "dst AS (SELECT lower(trim(email)) AS email FROM subscribers WHERE id % 3 = 0), "
        "fresh AS (SELECT id, email FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS rn FROM src WHERE email NOT IN (SELECT email FROM dst)) WHERE rn = 1) ")


def migration(spark, sf):
    subs = S.subscribers(spark, sf)
    mail = F.lower(F.trim("email"))
    src = subs.select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("shared"), (F.col("id") % 30).cast("string"))).otherwise(mail).alias("email"))
    return I.copy_missing(src, subs.where("id % 3 = 0").select(mail.alias("email")))


@query("copy_missing", COPY + "SELECT id, email FROM fresh")
def copy_missing(spark, sf):
    """Rows a table copy inserts."""
    return migration(spark, sf)[0].select("id", "email")


@query("copy_counts", COPY + "SELECT (SELECT count(*) FROM fresh) AS migrated, (SELECT count(*) FROM src) - (SELECT count(*) FROM fresh) AS skipped")
def copy_counts(spark, sf):
    return migration(spark, sf)[1]


@query("unsynced_since", "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00'")
def unsynced_since(spark, sf):
    """Rows newer than the last sync."""
    return I.unsynced_since(S.table(spark, sf, "events"), F.lit("2024-01-25").cast("timestamp")).select("event_id", "user_id")


@query("items_today", "SELECT count(*) AS items, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00') AS today FROM events")
def items_today(spark, sf):
    return G.items_since(S.table(spark, sf, "events"), F.lit("2024-01-30").cast("timestamp"))


@query("newest_items", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 500)")
def newest_items(spark, sf):
    """Newest 500 items."""
    rows = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    return R.newest(rows, 500).select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("freshness", "SELECT CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS newest, CAST(max(ts) AS DATE) = DATE '2024-01-30' AS fresh FROM events")
def freshness(spark, sf):
    """Newest date is today."""
    return Q.freshness(S.table(spark, sf, "events"), "ts", F.lit("2024-01-30").cast("date")).withColumn(
        "newest", F.col("newest").cast("string"))


@query("export_counters", f"WITH {C.TABLES}, {C.EXPORTABLE} SELECT (SELECT count(*) FROM live) AS total, "
       f"(SELECT count(*) FROM live WHERE coalesce(trim(property_type), '') IN ('', {C.quoted(L.EXCLUDED_TYPES)})) AS excluded, "
       f"(SELECT count(*) FROM live WHERE coalesce(trim(property_type), '') NOT IN ('', {C.quoted(L.EXCLUDED_TYPES)}) AND coalesce(end_at < {C.NOW}, false)) AS expired, "
       f"count(*) FILTER (WHERE is_partial_ownership) AS partial, count(*) FILTER (WHERE {C.CATEGORY} = 'apartment') AS apartments, "
       f"count(*) FILTER (WHERE {C.CATEGORY} = 'house') AS houses, count(*) FILTER (WHERE {C.CATEGORY} = 'garage') AS garages, "
       f"count(*) FILTER (WHERE {C.CATEGORY} NOT IN ('apartment', 'house', 'garage')) AS other FROM kept")
def export_counters(spark, sf):
    """Counters of an export."""
    return E.export_counters(S.auctions(spark, sf), S.now())


@query("coverage_alarm", f"WITH {S.deals_sql()} SELECT count(*) AS total, count(*) FILTER (WHERE market_price <> 0) AS known, "
       "count(*) FILTER (WHERE market_price <> 0) * 100.0 / count(*)::DOUBLE AS pct, count(*) FILTER (WHERE market_price <> 0) * 100.0 / count(*) < 20 AS alarm FROM deals")
def coverage_alarm(spark, sf):
    """Market coverage and its alarm (A10, D3)."""
    return Q.coverage_alarm(S.deals(spark, sf))


@query("invariants", f"WITH {S.deals_sql()} SELECT count(*) FILTER (WHERE discount <> 0 AND comparables_count < 3) AS discount_without_comparables, "
       "CAST(0 AS BIGINT) AS discount_on_partial, count(*) FILTER (WHERE discount > 70) AS discount_above_70 FROM deals")
def invariants(spark, sf):
    """Rows that break an output rule."""
    return Q.invariants(S.deals(spark, sf))


@query("parser_success", f"{MARKET} SELECT 100.0 * count(city) / count(*)::DOUBLE AS city_pct, 100.0 * count(neighborhood) / count(*)::DOUBLE AS neighborhood_pct, "
       "100.0 * count(rooms) / count(*)::DOUBLE AS rooms_pct, count(neighborhood) >= 0.9 * count(*) AND count(rooms) >= 0.9 * count(*) AS ok FROM market")
def parser_success(spark, sf):
    """Share of rows with each key field."""
    return Q.parser_success(S.market(spark, sf), ["city", "neighborhood", "rooms"])
