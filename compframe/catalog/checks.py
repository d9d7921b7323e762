"""SQL fragments for the check side, spelled out by brute force."""

from __future__ import annotations

from compframe import lookups as L
from compframe.catalog import standin as S

NOW = f"TIMESTAMP '{S.NOW}'"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def strip_sql(x: str) -> str:
    out = f"trim(lower({x}))"
    for p in L.HOOD_STRIP_PATTERNS:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return f"trim(replace(replace({out}, '\"', ''), '''', ''))"


def norm_case(t: str) -> str:
    arms = " ".join(f"WHEN {t} IN ({quoted(names)}) OR starts_with({t}, '{name}') THEN '{name}'"
                    for name, names in L.HOOD_ALIASES.items())
    return f"CASE {arms} ELSE nullif({t}, '') END"


def norm_cte(name: str, source: str) -> str:
    """CTE (h, norm) over distinct district names of ``source`` (a query with column h)."""
    return (f"{name} AS (SELECT h, {norm_case('t')} AS norm FROM "
            f"(SELECT h, {strip_sql('h')} AS t FROM (SELECT DISTINCT h FROM ({source}) WHERE h IS NOT NULL)))")


def similarity_case(a: str, b: str) -> str:
    alias = " OR ".join(
        f"(({a} = '{n}' OR {a} IN ({quoted(v)})) AND ({b} = '{n}' OR {b} IN ({quoted(v)})))"
        for n, v in L.HOOD_ALIASES.items())
    cluster = " OR ".join(f"({a} IN ({quoted(m)}) AND {b} IN ({quoted(m)}))" for m in L.HOOD_CLUSTERS.values())
    prefix = (f"coalesce(list_aggregate(list_transform(range(1, CAST(least(length({a}), length({b})) AS BIGINT) + 1), "
              f"lambda i: CASE WHEN {a}[1:i] = {b}[1:i] THEN 1 ELSE 0 END), 'sum'), 0)")
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE "
            f"WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.8::DOUBLE WHEN {alias} THEN 0.9::DOUBLE "
            f"WHEN {cluster} THEN 0.75::DOUBLE "
            f"WHEN least(length({a}), length({b})) >= 3 AND {prefix} >= 3 "
            f"THEN 0.5::DOUBLE * ({prefix}::DOUBLE / least(length({a}), length({b}))::DOUBLE) ELSE 0.0::DOUBLE END")


def address_hood_cte(name: str, source: str) -> str:
    """CTE (a, hood) for distinct address texts: markers, then streets."""
    pats = [p.replace("(?!м)(?!м²)", "").replace("([а-яА-Я\\s\\d-]+)", "([а-лн-яА-ЯЁ\\s\\d-][а-яА-Я\\s\\d-]*)")
            if "(?!м)" in p else p for p in L.ADDRESS_HOOD_PATTERNS]
    raw = ", ".join(f"{strip_sql(f'trim(regexp_extract(lower(a), {chr(39)}{p}{chr(39)}, 1))')} AS t{i}"
                    for i, p in enumerate(pats))
    norms = ", ".join(f"{norm_case(f't{i}')} AS n{i}" for i in range(len(pats)))
    street = " ".join(
        f"WHEN contains(lower(a), '{s}') AND contains(lower(a), '{t}') THEN '{h}'" for s, h, t in L.STREET_HOODS)
    first = " ".join(f"WHEN length(n{i}) > 2 THEN n{i}" for i in range(len(pats)))
    return (f"{name} AS (SELECT a, CASE {first} ELSE CASE {street} END END AS hood FROM "
            f"(SELECT a, {norms} FROM (SELECT a, {raw} FROM (SELECT DISTINCT a FROM ({source}) WHERE a IS NOT NULL))))")


def date_sql(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}$') THEN try_strptime({x}, '%d.%m.%Y') "
            f"ELSE try_strptime({x}, '%Y-%m-%d') END")


def py_round(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


BAND_LO = "CASE " + " ".join(f"WHEN contains(lower(property_type), '{w}') THEN {lo}" for w, lo, _ in L.ROOM_BANDS) + " END"
BAND_HI = "CASE " + " ".join(f"WHEN contains(lower(property_type), '{w}') THEN {hi}" for w, _, hi in L.ROOM_BANDS) + " END"
CATEGORY = "CASE property_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.TYPE_CATEGORIES.items()) + " ELSE 'other' END"

EXPORTABLE = (
    f"live AS (SELECT * REPLACE (trim(replace(replace(city, 'гр. ', ''), 'с. ', '')) AS city), "
    f"{date_sql('auction_end')} AS end_at FROM auctions WHERE NOT is_expired AND size_sqm > 0 AND price_eur > 0), "
    f"kept AS (SELECT * FROM live WHERE coalesce(trim(property_type), '') NOT IN ('', {quoted(L.EXCLUDED_TYPES)}) "
    f"AND NOT coalesce(end_at < {NOW}, false)), "
    "uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(address, ''), round_even(price_eur, 0), "
    f"{py_round('size_sqm', 1)}, property_type, floor ORDER BY price_eur, id) AS rn FROM kept) WHERE rn = 1)"
)


def valuation_ctes(source: str) -> str:
    """CTEs that run the six passes by joining every subject with the market.

    ``source`` is a relation with id, city (clean), neighborhood, address, size_sqm,
    property_type. The result ``valued`` has one row per valued id.
    """
    med = "list_sort(list(price_per_sqm))[CAST(floor(count(*) / 2) AS BIGINT) + 1]"
    return (
        address_hood_cte("addr", f"SELECT city || ', ' || address AS a FROM {source}") + ", "
        f"subj AS (SELECT s.id, s.city, s.size_sqm AS sz, {BAND_LO} AS blo, {BAND_HI} AS bhi, "
        f"coalesce(nullif(s.neighborhood, ''), addr.hood) AS auction_hood FROM {source} s "
        "LEFT JOIN addr ON addr.a = s.city || ', ' || s.address), "
        "ok AS (SELECT city, neighborhood, size_sqm, price_per_sqm FROM market "
        "WHERE price_per_sqm > 200 AND price_per_sqm < 5000), "
        + norm_cte("norms", "SELECT neighborhood AS h FROM ok UNION ALL SELECT auction_hood FROM subj") + ", "
        f"pairs AS (SELECT a.h AS sh, b.h AS mh FROM norms a, norms b WHERE {similarity_case('a.norm', 'b.norm')} >= 0.7), "
        "near AS (SELECT s.id, s.sz, s.blo, s.bhi, m.size_sqm, m.price_per_sqm, "
        "p.sh IS NOT NULL AS same FROM subj s JOIN ok m ON m.city = s.city "
        "LEFT JOIN pairs p ON p.sh = s.auction_hood AND p.mh = m.neighborhood), "
        "tried AS ("
        "SELECT id, 1 AS pass, price_per_sqm FROM near WHERE same AND size_sqm BETWEEN greatest(sz - 10, blo) AND least(sz + 10, bhi) AND blo IS NOT NULL "
        "UNION ALL SELECT id, 2, price_per_sqm FROM near WHERE same AND size_sqm BETWEEN sz - 10 AND sz + 10 "
        "UNION ALL SELECT id, 3, price_per_sqm FROM near WHERE same AND size_sqm BETWEEN blo AND bhi "
        "UNION ALL SELECT id, 4, price_per_sqm FROM near WHERE same "
        "UNION ALL SELECT id, 5, price_per_sqm FROM near WHERE size_sqm BETWEEN greatest(sz - 10, blo) AND least(sz + 10, bhi) AND blo IS NOT NULL "
        "UNION ALL SELECT id, 6, price_per_sqm FROM near WHERE size_sqm BETWEEN sz - 10 AND sz + 10), "
        f"stat AS (SELECT id, pass, count(*) AS n, {med} AS med, min(price_per_sqm) AS lo, max(price_per_sqm) AS hi FROM tried GROUP BY id, pass), "
        "best AS (SELECT id, min(pass) AS pass FROM stat WHERE n >= 3 GROUP BY id), "
        "valued AS (SELECT b.id, b.pass AS match_pass, s.n AS comparables_count, s.med AS market_median, "
        "r.lo AS range_min, r.hi AS range_max, CASE WHEN b.pass <= 4 THEN 'hood' ELSE 'city_size' END AS comparables_level, "
        "CASE WHEN b.pass <= 4 THEN j.auction_hood END AS matched_hood "
        "FROM best b JOIN stat s ON s.id = b.id AND s.pass = b.pass LEFT JOIN stat r ON r.id = b.id AND r.pass = 6 "
        "JOIN subj j ON j.id = b.id)"
    )


TABLES = f"{S.auctions_sql()}, {S.market_sql()}"
FLATS = (f"flats AS (SELECT * FROM uniq WHERE trim(property_type) IN ({quoted(L.COMPARABLE_TYPES)}) "
         "AND NOT is_partial_ownership)")


def title_sql(x: str) -> str:
    """Capitalised words of a name; words are split at blanks and hyphens."""
    word = "upper(w[1]) || lower(w[2:])"
    part = f"array_to_string(list_transform(list_filter(string_split_regex(p, '\\s+'), lambda w: w <> ''), lambda w: {word}), ' ')"
    return f"array_to_string(list_transform(string_split(trim({x}), '-'), lambda p: {part}), '-')"


DEALS = (
    f"{TABLES}, {EXPORTABLE}, {FLATS}, {valuation_ctes('flats')}, "
    "base AS (SELECT u.*, v.market_median AS med, v.comparables_count AS n, v.comparables_level, v.range_min, v.range_max, "
    "v.matched_hood, round_even(v.market_median, 0) AS avg_ FROM uniq u LEFT JOIN valued v ON v.id = u.id), "
    f"based AS (SELECT *, {py_round('(med - price_eur / size_sqm) / med * 100', 1)} AS d0 FROM base), "
    "scored AS (SELECT *, CASE WHEN d0 >= 0 AND NOT is_partial_ownership THEN d0 END AS disc FROM based), "
    "deals AS (SELECT CAST(id AS VARCHAR) AS id, city, "
    f"nullif({title_sql('neighborhood')}, '') AS neighborhood, coalesce(address, '') AS address, "
    "CAST(round_even(price_eur, 0) AS BIGINT) AS price, CAST(round_even(price_eur, 0) AS BIGINT) AS effective_price, "
    f"{py_round('size_sqm', 1)} AS sqm, CAST(round_even(price_eur / size_sqm, 0) AS BIGINT) AS price_per_sqm, "
    "CAST(avg_ AS BIGINT) AS market_avg, CAST(round_even(avg_ * size_sqm, 0) AS BIGINT) AS market_price, "
    "CAST(round_even(avg_ * size_sqm - price_eur, 0) AS BIGINT) AS savings_eur, "
    "CAST(coalesce(n, 0) AS INTEGER) AS comparables_count, comparables_level, "
    "CAST(round_even(range_min, 0) AS BIGINT) AS market_min_sqm, CAST(round_even(range_max, 0) AS BIGINT) AS market_max_sqm, "
    f"disc AS discount, {CATEGORY} AS property_type, floor, property_type AS property_type_bg, "
    "CAST(NULL AS VARCHAR) AS auction_start, auction_end, "
    f"'{L.AUCTION_URL}' || CAST(id AS VARCHAR) AS url, {title_sql('matched_hood')} AS matched_neighborhood, "
    f"CASE WHEN is_partial_ownership THEN '{L.PARTIAL_LABEL}' END AS partial_ownership, "
    "CASE WHEN is_partial_ownership THEN 0 WHEN disc >= 40 THEN 5 WHEN disc >= 30 THEN 4 WHEN disc >= 20 THEN 3 "
    "WHEN disc >= 10 THEN 2 WHEN disc <> 0 THEN 1 ELSE 0 END AS score, price_eur FROM scored)"
)
