"""The star-schema tables read as auctions, market listings and so on.

Every mapping is a list of SQL expressions that Spark and ANSI engines read alike, so the
check queries are built from the same text. All rows of a table take part. A third of the
rows falls on one town, as in the real market.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from compframe.functions.price import price_per_sqm
from compframe.session import spread

CITIES = ["София", "Пловдив", "Варна", "Бургас", "Русе", "Стара Загора", "Плевен", "Добрич",
          "Сливен", "Шумен", "Перник", "Хасково", "Пазарджик", "Благоевград", "Враца",
          "Габрово", "Видин", "Монтана", "Ловеч", "Разград", "Силистра", "Смолян",
          "Търговище", "Ямбол", "Кюстендил"]
HOODS = ["ж.к. Люлин 9", "Люлин 7", "ж.к. Младост 1", "Младост", "кв. Лозенец", "Център",
         "кв. Изток", "Оборище", "район Витоша", "Бояна", "Драгалевци", "кв. Красно село",
         "Красна поляна", "Хиподрума", "Овча купел", "Банишора", "Надежда", "Подуяне",
         "Слатина", "Гео Милев", "Редута", "Цветен квартал", "Левски", "Базар Левски",
         "жк Тракия", "Студентски град", "Дружба 2", "Мусагеница"]
PROMO_TYPES = ["Къща", "Гараж", "Парцел", "Магазин", "Ателие, Таван"]
NOW = "2024-03-15 10:00:00"


def pick(index: str, values: list[str]) -> str:
    """Expression for the value at a position, counted from 0."""
    return f"split_part('{'|'.join(values)}', '|', CAST({index} AS INT) + 1)"


def town(third: str, other: str) -> str:
    """A third of the rows in the first town, the rest spread over the others."""
    return f"CASE WHEN {third} % 3 = 0 THEN '{CITIES[0]}' ELSE ({pick(f'({other}) % {len(CITIES) - 1}', CITIES[1:])}) END"


K = "p_partkey"
HOOD_OF_PART = pick(f"({K} * 5 + p_size) % {len(HOODS)}", HOODS)
DAY = f"lpad(CAST(({K} * 3 + p_size) % 28 + 1 AS VARCHAR(4)), 2, '0')"
MONTH = "lpad(CAST(p_size % 6 + 1 AS VARCHAR(4)), 2, '0')"

AUCTIONS = [
    f"CAST({K} AS BIGINT) AS id",
    f"'гр. ' || ({town(K, K)}) AS city",
    f"CASE WHEN {K} % 5 = 0 THEN NULL ELSE ({HOOD_OF_PART}) END AS neighborhood",
    f"CASE WHEN {K} % 20 = 0 THEN 'ж.к. \"' || ({HOOD_OF_PART}) || '\", бл. 12' "
    f"WHEN {K} % 10 = 0 THEN 'ул. Роза 7' WHEN {K} % 25 = 5 THEN NULL "
    f"ELSE 'ул. Шипка ' || CAST({K} % 50 + 1 AS VARCHAR(4)) END AS address",
    f"p_retailprice * (p_size + ({K} % 4) * 15) * (CAST({K} % 7 * 4 + 5 AS DOUBLE) / 10) AS price_eur",
    f"CAST(p_size + ({K} % 4) * 15 + CASE WHEN {K} % 97 = 0 THEN 500 ELSE 0 END AS DOUBLE) "
    f"+ CAST(CASE WHEN {K} % 6 = 0 THEN 1 ELSE 0 END AS DOUBLE) / 2 AS size_raw",
    f"CASE WHEN {K} % 8 = 0 THEN NULL ELSE {K} % 9 END AS floor",
    "CASE p_type WHEN 'ECONOMY' THEN 'Едностаен апартамент' WHEN 'SMALL' THEN 'Двустаен апартамент' "
    "WHEN 'MEDIUM' THEN 'Тристаен апартамент' WHEN 'LARGE' THEN 'Многостаен апартамент' "
    f"WHEN 'STANDARD' THEN 'Апартамент' ELSE ({pick(f'{K} % 6', PROMO_TYPES)}) END AS property_type",
    f"{K} % 13 = 0 AS is_partial_ownership",
    f"{K} % 17 = 0 AS is_expired",
    f"CASE WHEN {K} % 19 = 0 THEN NULL WHEN {K} % 2 = 0 THEN {DAY} || '.' || {MONTH} || '.2024' "
    f"ELSE '2024-' || {MONTH} || '-' || {DAY} END AS auction_end",
]

MARKET = [
    f"{town('l_orderkey', 'l_suppkey')} AS city",
    f"CASE WHEN l_linenumber = 7 THEN NULL ELSE ({pick(f'(l_partkey * 5 + l_suppkey) % {len(HOODS)}', HOODS)}) END AS neighborhood",
    "l_quantity + (l_linenumber - 1) * 12 AS size_raw",
    "l_extendedprice AS price_raw",
    "l_quantity AS quantity_raw",
    "CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS rooms",
    "CASE l_returnflag WHEN 'A' THEN 'imot.bg' WHEN 'N' THEN 'olx.bg' ELSE 'alo.bg' END AS source",
    "l_shipdate AS scraped_at",
]


def auctions_sql() -> str:
    """Check-side text of the auctions table, relisted copies included."""
    base = f"SELECT {', '.join(AUCTIONS)} FROM part"
    return (
        "auctions_one AS (SELECT id, city, neighborhood, address, price_eur, CAST(size_raw AS DOUBLE) AS size_sqm, "
        f"CAST(floor AS INTEGER) AS floor, property_type, is_partial_ownership, is_expired, auction_end FROM ({base})), "
        "auctions AS (SELECT * FROM auctions_one UNION ALL "
        "SELECT id + 1000000000 AS id, city, neighborhood, address, price_eur, size_sqm, floor, property_type, "
        "is_partial_ownership, is_expired, auction_end FROM auctions_one WHERE id % 15 = 1)"
    )


def market_sql() -> str:
    return (
        "market AS (SELECT city, neighborhood, size_sqm, price_eur, "
        "CAST(printf('%.2f', price_raw / quantity_raw) AS DOUBLE) AS price_per_sqm, rooms, source, scraped_at FROM ("
        "SELECT *, CAST(size_raw AS DOUBLE) AS size_sqm, price_raw / quantity_raw * CAST(size_raw AS DOUBLE) AS price_eur FROM ("
        f"SELECT {', '.join(MARKET)} FROM lineitem)))"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return zoned(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def zoned(df: DataFrame) -> DataFrame:
    """Wall-clock times as timestamps of the session's zone."""
    plain = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spread(table(spark, sf_dir, "part")).selectExpr(*AUCTIONS).select(
        "id", "city", "neighborhood", "address", "price_eur", F.col("size_raw").cast("double").alias("size_sqm"),
        F.col("floor").cast("int").alias("floor"), "property_type", "is_partial_ownership", "is_expired",
        "auction_end")
    # every fifteenth auction is listed twice, under a second id
    again = F.when(F.col("id") % 15 == 1, F.array(F.lit(0), F.lit(1000000000))).otherwise(F.array(F.lit(0)))
    return one.withColumn("id", F.explode(F.transform(again, lambda x: x + F.col("id"))))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size_raw").cast("double")
    rows = table(spark, sf_dir, "lineitem").selectExpr(*MARKET)
    priced = rows.select("city", "neighborhood", size.alias("size_sqm"),
                         (F.col("price_raw") / F.col("quantity_raw") * size).alias("price_eur"),
                         price_per_sqm("price_raw", "quantity_raw").alias("price_per_sqm"),
                         "rooms", "source", "scraped_at")
    return priced


def now():
    return F.lit(NOW).cast("timestamp")


# ---------------------------------------------------------------- deals and subscribers

O = "o_orderkey"
DEALS = [
    f"CAST({O} AS VARCHAR(20)) AS id",
    f"{town(O, 'o_custkey')} AS city",
    f"{pick(f'({O} + o_custkey) % {len(HOODS)}', HOODS)} AS neighborhood",
    "CAST(floor(o_totalprice / 2) AS BIGINT) AS price",
    "CAST(floor(o_totalprice / 2) AS BIGINT) AS effective_price",
    "CAST(20 + o_custkey % 130 AS DOUBLE) AS sqm",
    f"CAST(CASE WHEN {O} % 4 = 0 THEN 0 ELSE 3 + {O} % 12 END AS INT) AS comparables_count",
    f"CASE WHEN {O} % 4 = 0 THEN NULL ELSE CAST(floor(o_totalprice * (0.4 + ({O} * 7 % 100) * 0.01)) AS BIGINT) END AS market_price",
    f"CASE WHEN {O} % 23 = 0 THEN NULL ELSE lpad(CAST(({O} * 5 + o_custkey) % 28 + 1 AS VARCHAR(4)), 2, '0') || '.' || "
    f"lpad(CAST({O} % 4 + 2 AS VARCHAR(4)), 2, '0') || '.2024' END AS auction_end",
]
DEALS_OUTER = [
    "*", "market_price - price AS savings_eur",
    "CASE WHEN market_price >= price AND market_price > 0 THEN floor((market_price - price) * 1000.0 / market_price) / 10.0 END AS discount",
]
C_ = "c_custkey"
SUBSCRIBERS = [
    f"CAST({C_} AS BIGINT) AS id",
    "'  ' || replace(c_name, '#', '.') || '@Example.com ' AS email",
    f"CASE WHEN {C_} % 4 = 0 THEN CASE WHEN {C_} % 8 = 0 THEN '[]' ELSE NULL END WHEN {C_} % 4 = 1 "
    f"THEN '[\"' || ({pick(f'c_nationkey % {len(CITIES)}', CITIES)}) || '\"]' "
    f"ELSE '[\"' || ({pick(f'c_nationkey % {len(CITIES)}', CITIES)}) || '\",\"' || ({pick(f'({C_} + 3) % {len(CITIES)}', CITIES)}) || '\",\"Атлантида\"]' END AS cities_json",
    f"CASE WHEN {C_} % 9 = 0 THEN 'abc' WHEN {C_} % 9 = 1 THEN NULL ELSE CAST({C_} % 90 - 5 AS VARCHAR(8)) END AS threshold_text",
    f"CAST(CASE WHEN {C_} % 6 = 0 THEN 0 WHEN {C_} % 6 = 1 THEN NULL ELSE {C_} % 45 + 10 END AS INT) AS min_discount",
    f"{C_} % 7 <> 0 AS verified",
    f"CASE WHEN {C_} % 3 = 0 THEN '[\"' || CAST({C_} * 3 % 1400 AS VARCHAR(8)) || '\",\"' || CAST({C_} * 11 % 1400 AS VARCHAR(8)) || '\"]' "
    f"WHEN {C_} % 3 = 1 THEN '' ELSE NULL END AS last_deal_ids_json",
]


def deals_sql() -> str:
    inner = f"SELECT {', '.join(DEALS)} FROM orders"
    return f"deals AS (SELECT {', '.join(DEALS_OUTER)} FROM ({inner}))"


def subscribers_sql() -> str:
    return f"subscribers AS (SELECT {', '.join(SUBSCRIBERS)} FROM customer)"


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(*DEALS).selectExpr(*DEALS_OUTER)
    return rows.withColumn("discount", F.col("discount").cast("double")).withColumn(
        "price_eur", F.col("price").cast("double")).withColumn("partial_ownership", F.lit(None).cast("string"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*SUBSCRIBERS)


# ---------------------------------------------------------------- snapshots

OLD_STAMP = "TIMESTAMP '2024-02-01 00:00:00'"
KNOWN_WHERE = f"{K} % 10 <> 3"
CURRENT_WHERE = f"{K} % 7 <> 0"
SNAP_FIELDS = [
    f"CAST({K} AS BIGINT) AS id", "p_name AS address", "p_retailprice AS price_eur",
    f"CASE WHEN {K} % 19 = 0 THEN NULL WHEN {K} % 9 = 0 THEN '2024-01-05' ELSE {DAY} || '.' || {MONTH} || '.2024' END AS auction_end",
]


def snapshot_sql() -> str:
    known = f"SELECT {', '.join(SNAP_FIELDS)}, {K} % 4 = 0 AS is_expired FROM part WHERE {KNOWN_WHERE}"
    fresh = (f"SELECT {', '.join(SNAP_FIELDS)} FROM part WHERE {CURRENT_WHERE}")
    return (
        f"known AS (SELECT *, {OLD_STAMP} AS scraped_at, {OLD_STAMP} AS first_seen_at, {OLD_STAMP} AS last_updated_at FROM ({known})), "
        f"current_ids AS (SELECT CAST({K} AS BIGINT) AS id FROM part WHERE {CURRENT_WHERE}), "
        f"details AS (SELECT id, address, price_eur + 1000.0 AS price_eur, auction_end, id % 12 = 0 AS is_expired FROM ({fresh}) WHERE id % 31 <> 0)"
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.expr(OLD_STAMP)
    return (table(spark, sf_dir, "part").where(KNOWN_WHERE).selectExpr(*SNAP_FIELDS, f"{K} % 4 = 0 AS is_expired")
            .withColumns({"scraped_at": old, "first_seen_at": old, "last_updated_at": old}))


def current_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(CURRENT_WHERE).selectExpr(f"CAST({K} AS BIGINT) AS id")


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "part").where(CURRENT_WHERE).selectExpr(*SNAP_FIELDS).where("id % 31 <> 0")
            .selectExpr("id", "address", "price_eur + 1000.0 AS price_eur", "auction_end", "id % 12 = 0 AS is_expired"))
