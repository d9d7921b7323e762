"""Queries of the older, top-k scoring method."""

from __future__ import annotations

from pyspark.sql import functions as F

from compframe import lookups as L
from compframe.catalog import checks as C
from compframe.catalog import standin as S
from compframe.catalog.registry import query
from compframe.config import AppraisalConfig
from compframe.operators import nearest as N
from compframe.plans import appraise as A
from compframe.session import new_path
from compframe.sources.writers import write_report

LABEL = ("CASE property_type WHEN 'Едностаен апартамент' THEN '1-стаен' WHEN 'Двустаен апартамент' THEN '2-стаен' "
         "WHEN 'Тристаен апартамент' THEN '3-стаен' WHEN 'Многостаен апартамент' THEN '4+-стаен' END")
SUBJ = ["id", "price_eur", "upper(replace(city, 'гр. ', '')) AS city", "neighborhood", f"{LABEL} AS property_type",
        "CASE WHEN id % 9 = 0 THEN NULL ELSE size_sqm END AS size_sqm"]
MKT = ["city", "neighborhood", "CASE rooms WHEN 1 THEN '1-стаен' WHEN 2 THEN '2-стаен' WHEN 3 THEN '3-стаен' WHEN 4 THEN '4+-стаен' WHEN 5 THEN '4+-стаен' END AS property_type",
       "CASE WHEN rooms IS NULL AND neighborhood IS NOT NULL THEN NULL ELSE size_sqm END AS size_sqm", "price_eur",
       "source || '/' || CAST(floor(price_eur) AS BIGINT) AS url"]


def subjects(spark, sf):
    return S.auctions(spark, sf).selectExpr(*SUBJ)


def market(spark, sf):
    return S.market(spark, sf).selectExpr(*MKT)


def simple(x):
    return f"lower(trim(regexp_replace({x}, '(?i)^(кв\\.|жк\\.|ж\\.к\\.|квартал|жилищен комплекс)\\s*', '')))"


TIE = "price_eur NULLS FIRST, m_size NULLS FIRST, m_hood NULLS FIRST, m_type NULLS FIRST, url NULLS FIRST"


def best_ctes(k: int, pct: float) -> str:
    return (
        f"WITH {C.TABLES}, subj AS (SELECT *, {simple('neighborhood')} AS hk FROM (SELECT {', '.join(SUBJ)} FROM auctions)), "
        f"mkt AS (SELECT *, {simple('neighborhood')} AS hk FROM (SELECT {', '.join(MKT)} FROM market)), "
        "near AS (SELECT s.id, s.price_eur AS ask, m.price_eur, m.size_sqm AS m_size, m.neighborhood AS m_hood, m.property_type AS m_type, m.url, "
        "s.hk IS NOT DISTINCT FROM m.hk AS same_hood, abs(m.size_sqm - s.size_sqm) AS gap FROM subj s JOIN mkt m ON lower(m.city) = lower(s.city) "
        "AND (s.property_type IS NULL OR m.property_type IS NULL OR s.property_type = m.property_type) "
        f"AND (s.size_sqm IS NULL OR m.size_sqm IS NULL OR abs(m.size_sqm - s.size_sqm) / s.size_sqm <= {pct / 100}::DOUBLE)), "
        f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY same_hood DESC, gap NULLS LAST, {TIE}) AS rn FROM near) WHERE rn <= {k})"
    )


@query("comparables_topk", f"{best_ctes(10, 20)} SELECT id, CAST(rn AS INTEGER) AS rank, same_hood, price_eur, m_size AS size_sqm FROM best")
def comparables_topk(spark, sf):
    """Ten nearest comparables."""
    cfg = AppraisalConfig(size_tolerance_pct=20.0, max_results=10)
    subj = subjects(spark, sf)
    best = N.top_comparables(subj, market(spark, sf), cfg)
    return N._keyed(subj).select("id", *N.PROBE).join(best, N.PROBE).select("id", "rank", "same_hood", "price_eur", "size_sqm")


MED = "quantile_cont(price_eur, 0.5)"
SCORED = (
    f"{best_ctes(15, 25)}, st AS (SELECT id, any_value(ask) AS ask, count(*) AS n, count(*) FILTER (WHERE same_hood) AS same, median(price_eur) AS med, "
    "quantile_disc(price_eur, 0.25) AS lo, quantile_disc(price_eur, 0.75) AS hi, avg(price_eur) AS mean, "
    "array_to_string(list_slice(list(CAST(floor(price_eur) AS BIGINT) ORDER BY rn), 1, 5), ',') AS first FROM best GROUP BY id), "
    "sc AS (SELECT *, (med - ask) / med * 100 AS disc, (lo - ask) / lo * 100 AS dlow FROM st WHERE n >= 3), "
    "scored AS (SELECT s.id, s.price_eur, s.city, CASE WHEN disc > 35 THEN 5 WHEN disc > 25 THEN 4 WHEN disc > 15 THEN 3 WHEN disc > 5 THEN 2 WHEN disc > -5 THEN 1 "
    "WHEN disc IS NOT NULL THEN 0 END AS score, CASE WHEN coalesce(st.n, 0) < 3 THEN 'low' WHEN st.n >= 10 AND st.same >= 3 THEN 'high' WHEN st.n >= 5 THEN 'medium' ELSE 'low' END AS confidence, "
    "CAST(floor(sc.med + 0.5) AS BIGINT) AS market_median, CAST(floor(sc.lo + 0.5) AS BIGINT) AS market_low, CAST(floor(sc.hi + 0.5) AS BIGINT) AS market_high, "
    "CAST(floor(sc.mean + 0.5) AS BIGINT) AS market_mean, floor(disc * 10 + 0.5) / 10 AS discount_pct, floor(dlow * 10 + 0.5) / 10 AS discount_vs_low_pct, "
    "coalesce(st.n, 0) AS comparables_count, sc.same AS neighborhood_matches, sc.first AS comparables "
    "FROM subj s LEFT JOIN st ON st.id = s.id LEFT JOIN sc ON sc.id = s.id)"
)


def scored(spark, sf):
    return N.appraise(subjects(spark, sf), market(spark, sf))


@query("deal_score", f"{SCORED} SELECT id, score, CASE score " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in L.VERDICTS.items())
       + " END AS verdict, confidence, market_median, market_low, market_high, market_mean, discount_pct, discount_vs_low_pct, comparables_count, "
       "neighborhood_matches, comparables FROM scored")
def deal_score(spark, sf):
    """Scores of all subjects."""
    out = scored(spark, sf)
    first = F.transform("comparables", lambda c: F.floor(c["price"]).cast("string"))
    return out.select("id", "score", "verdict", "confidence", "market_median", "market_low", "market_high", "market_mean",
                      "discount_pct", "discount_vs_low_pct", "comparables_count", "neighborhood_matches",
                      F.array_join(first, ",").alias("comparables"))


@query("score_distribution", f"{SCORED} SELECT b.score, count(s.id) AS n FROM (VALUES (5), (4), (3), (2), (1), (0), (NULL)) AS b(score) "
       "LEFT JOIN scored s ON s.score IS NOT DISTINCT FROM b.score GROUP BY b.score")
def score_distribution(spark, sf):
    """Rows per score."""
    return A.score_distribution(scored(spark, sf))


@query("top_scored", f"{SCORED} SELECT id, score, discount_pct FROM scored WHERE coalesce(score, 0) >= 3 ORDER BY score DESC, discount_pct DESC, id LIMIT 20")
def top_scored(spark, sf):
    """Twenty best deals."""
    return A.top_deals(scored(spark, sf)).select("id", "score", "discount_pct")


# Descriptions are rendered from the row, so that the fields read back can be compared with it.
DESCR_ROOMS = ["Едностаен", "Двустаен", "Тристаен", "Четиристаен", "Многостаен"]
CONSTR = ["панел", "тухла", "ЕПК"]
DESCRIBED = [
    "CAST(p_partkey AS BIGINT) AS id", "p_retailprice * (p_partkey % 700) AS price_eur",
    f"'гр. ' || ({S.town('p_partkey', 'p_partkey')}) AS city", "CAST(NULL AS VARCHAR(10)) AS address",
    "CAST(NULL AS VARCHAR(10)) AS property_type", "CAST(NULL AS DOUBLE) AS size_sqm",
    f"CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ({S.pick(f'p_partkey % {len(S.HOODS)}', S.HOODS)}) END AS neighborhood",
    f"CASE WHEN p_partkey % 8 = 0 THEN 'Парцел, земя ' || CAST(p_size * 10 AS VARCHAR(9)) || ' кв. м.' "
    f"WHEN p_partkey % 8 = 1 THEN 'Гараж в сграда ' || CAST(p_size AS VARCHAR(9)) || ' m2' "
    f"ELSE ({S.pick('p_partkey % 5', DESCR_ROOMS)}) || ' апартамент, ' || CAST(p_size + 30 AS VARCHAR(9)) || ',5 кв.м., ' || "
    f"CAST(p_partkey % 9 + 1 AS VARCHAR(9)) || '-ти етаж, ' || ({S.pick('p_partkey % 3', CONSTR)}) || "
    "CASE WHEN p_partkey % 4 = 2 THEN ', кв. Лозенец' ELSE '' END END AS description",
]
ROOMS_SQL = "CASE WHEN p_partkey % 8 > 1 THEN p_partkey % 5 + 1 END"


@query("enrich_description", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 8 WHEN 0 THEN 'land' WHEN 1 THEN 'parking' ELSE 'apartment' END AS property_type, "
       f"CAST({ROOMS_SQL} AS INTEGER) AS rooms, CASE p_partkey % 8 WHEN 0 THEN p_size * 10.0::DOUBLE WHEN 1 THEN p_size::DOUBLE ELSE p_size + 30.5::DOUBLE END AS size_sqm, "
       f"CAST(CASE WHEN p_partkey % 8 > 1 THEN p_partkey % 9 + 1 END AS INTEGER) AS floor, CASE WHEN p_partkey % 8 > 1 THEN ({S.pick('p_partkey % 3', CONSTR)}) END AS construction, "
       "CASE WHEN p_partkey % 8 > 1 AND p_partkey % 4 = 2 THEN 'лозенец' END AS neighborhood FROM part")
def enrich_description(spark, sf):
    """Fields of a description, read back from rendered text."""
    rows = S.table(spark, sf, "part").selectExpr(*DESCRIBED)
    return rows.select("id", A.enrich_description(F.col("description")).alias("d")).select("id", "d.*")


ENRICHED = (
    f"WITH raw AS (SELECT *, {ROOMS_SQL} AS r FROM part), listed AS (SELECT {', '.join(DESCRIBED)}, r FROM raw), "
    "win AS (SELECT id, price_eur, trim(replace(city, 'гр. ', '')) AS city, CASE WHEN r IS NOT NULL AND id % 4 = 2 THEN 'лозенец' ELSE neighborhood END AS neighborhood, "
    "CASE WHEN r IS NOT NULL THEN r || '-стаен' WHEN id % 8 = 0 THEN 'land' ELSE 'parking' END AS property_type FROM listed WHERE price_eur > 5000 AND price_eur < 500000), "
    "resid AS (SELECT * FROM win WHERE property_type <> 'land')"
)


@query("residential_window", f"{ENRICHED} SELECT id, city, neighborhood, property_type FROM resid WHERE city IN ('София', 'Пловдив', 'Варна', 'Бургас')")
def residential_window(spark, sf):
    """Price window, target towns, residential types."""
    rows = S.table(spark, sf, "part").selectExpr(*DESCRIBED)
    cities = ["София", "Пловдив", "Варна", "Бургас"]
    kept = A.enriched(rows.where(A.filters.candidate_window(cities, inclusive=False))).where(A.filters.residential())
    return kept.select("id", "city", "neighborhood", "property_type")


@query("deal_report")
def deal_report(spark, sf):
    """The report head of a whole run over described listings."""
    rows = S.table(spark, sf, "part").selectExpr(*DESCRIBED)
    return A.report(A.analyze_deals(rows, market(spark, sf)))


@query("report_document", f"{SCORED} SELECT (SELECT count(*) FROM scored) AS listings, (SELECT count(*) FROM scored WHERE coalesce(score, 0) >= 3) AS deals_found, "
       "CAST(row_number() OVER (ORDER BY score DESC, discount_pct DESC, id) - 1 AS INTEGER) AS place, id, city, price_eur, score, discount_pct, comparables_count "
       "FROM scored WHERE coalesce(score, 0) >= 3 QUALIFY place < 20")
def report_document(spark, sf):
    """The report head as written, read back as JSON: counts, and the top deals in their order."""
    path = f"{new_path(spark, 'report')}"
    write_report(scored(spark, sf), path)
    deal = "struct<id:bigint,city:string,price_eur:double,score:int,discount_pct:double,comparables_count:bigint>"
    read = spark.read.text(f"{path}/report", wholetext=True).select(
        F.from_json("value", f"listings bigint, deals_found bigint, top_deals array<{deal}>", {"mode": "FAILFAST"}).alias("r"))
    return read.select("r.listings", "r.deals_found", F.posexplode("r.top_deals").alias("place", "d")).select("listings", "deals_found", "place", "d.*")
