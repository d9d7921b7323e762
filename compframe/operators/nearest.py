"""Top-k comparables of the older method, without pairing subjects and market rows.

A market row can only be among the k best of some subject if it is among the k first of
its own (town, type, district, size) cell, because rows of one cell differ in nothing but
the tie-break. For rows of *other* districts the first 2k of a (town, type, size) cell
suffice once every district is limited to k: at most k of those 2k can belong to the
subject's own district. Subjects are reduced to distinct probes and meet only these short
lists, so no hot town, type or district is ever paired with itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from compframe.config import AppraisalConfig
from compframe.functions import price as P
from compframe.functions import text as T
from compframe.functions.core import round_half_up
from compframe.operators.aggregates import nearest_rank
from compframe.operators.ranking import top_per_group

ANY = "*"
UNKNOWN = "?"
PROBE = ["city_key", "type_key", "hood_key", "size_key"]
TIE = ["price_eur", "size_sqm", "neighborhood", "property_type", "url"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Join keys; unknown type, district and size get a key of their own (size 0)."""
    size = F.col("size_sqm")
    return rows.withColumns({
        "city_key": F.lower("city"),
        "type_key": F.coalesce("property_type", F.lit(UNKNOWN)),
        "hood_key": F.coalesce(T.simple_hood("neighborhood"), F.lit(UNKNOWN)),
        "size_key": F.when(size > 0, size).otherwise(0.0),
    })


def _size_bucket(c: Column, pct: float) -> Column:
    """Sizes within the tolerance differ by at most one bucket; unknown sizes stand apart."""
    width = -math.log(1 - pct / 100)
    return F.when(c > 0, F.floor(F.log(c) / F.lit(width))).otherwise(F.lit(-1 << 20))


def shortlists(market: DataFrame, cfg: AppraisalConfig) -> tuple[DataFrame, DataFrame]:
    """(own, other): per cell the rows that can matter to a subject of the same, or of another, district."""
    k = cfg.max_results
    tie = [F.col(c).asc_nulls_first() for c in TIE]
    best = top_per_group(_keyed(market), PROBE, tie, k)
    # a subject without a type sees all types, one without a size sees all sizes
    wide = (
        best.withColumn("type_key", F.explode(F.array("type_key", F.lit(ANY))))
        .withColumn("span", F.explode(F.array(F.lit("sized"), F.lit(ANY))))
        .withColumn("cell_size", F.when(F.col("span") == ANY, -1.0).otherwise(F.col("size_key")))
    )
    own = top_per_group(wide, ["city_key", "type_key", "hood_key", "cell_size"], tie, k)
    other = top_per_group(own, ["city_key", "type_key", "cell_size"], tie, 2 * k)
    return own, other


def top_comparables(subjects: DataFrame, market: DataFrame, cfg: AppraisalConfig = AppraisalConfig()) -> DataFrame:
    """Best comparables of every distinct probe: same town, type equal if both are known,
    size within tolerance if both are known; same district first, then nearest size.

    ``subjects`` and ``market`` need city, neighborhood, property_type, size_sqm; ``market``
    also price_eur and url. Ties are broken by price, size, district, type and url.
    """
    tol = cfg.size_tolerance_pct
    own, other = shortlists(market, cfg)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.when(F.col("span") == ANY, F.lit(-1 << 21))
                             .otherwise(_size_bucket(F.col("size_key"), tol)))

    probes = _keyed(subjects).select(*PROBE).distinct()
    sized = F.col("size_key") > 0
    b = _size_bucket(F.col("size_key"), tol)
    spread = probes.withColumns({
        "t": F.explode(F.when(F.col("type_key") == UNKNOWN, F.array(F.lit(ANY)))
                       .otherwise(F.array("type_key", F.lit(UNKNOWN)))),
    }).withColumn("bucket", F.explode(
        F.when(sized, F.array(b - 1, b, b + 1, F.lit(-1 << 20).cast("bigint")))
        .otherwise(F.array(F.lit(-1 << 21).cast("bigint")))))
    ask = spread.select(*[F.col(c).alias(f"s_{c}") for c in PROBE], F.col("t").alias("type_key"),
                        F.col("city_key"), "bucket")
    same = (bucketed(own).join(ask.withColumn("hood_key", F.col("s_hood_key")),
                               ["city_key", "type_key", "hood_key", "bucket"])
            .withColumn("same_hood", F.lit(True)))
    rest = (bucketed(other).join(ask, ["city_key", "type_key", "bucket"])
            .where(F.col("hood_key") != F.col("s_hood_key")).withColumn("same_hood", F.lit(False)))
    gap = F.abs(F.col("size_key") - F.col("s_size_key"))
    both = (F.col("size_key") > 0) & (F.col("s_size_key") > 0)
    near = same.unionByName(rest).where(~both | (gap / F.col("s_size_key") <= tol / 100))
    order = [F.col("same_hood").desc(), F.when(both, gap).asc_nulls_last()] + [F.col(c).asc_nulls_first() for c in TIE]
    mine = [f"s_{c}" for c in PROBE]
    rank = F.row_number().over(Window.partitionBy(*mine).orderBy(*order))
    return near.withColumn("rank", rank).where(F.col("rank") <= cfg.max_results).select(
        *[F.col(f"s_{c}").alias(c) for c in PROBE], "rank", "same_hood", *TIE)


def appraise(subjects: DataFrame, market: DataFrame, cfg: AppraisalConfig = AppraisalConfig()) -> DataFrame:
    """Subjects with median, quartiles, discount, score, verdict and confidence."""
    best = top_comparables(subjects, market, cfg)
    stats = best.groupBy(*PROBE).agg(
        F.count("*").alias("comparables_count"), F.count_if("same_hood").alias("neighborhood_matches"),
        F.median("price_eur").alias("median"), nearest_rank("price_eur", 25).alias("low"),
        nearest_rank("price_eur", 75).alias("high"), F.avg("price_eur").alias("mean"),
        F.slice(F.array_sort(F.collect_list(F.struct("rank", "price_eur", "size_sqm", "neighborhood", "url"))), 1, 5)
        .alias("first"))
    joined = _keyed(subjects).join(stats, PROBE, "left")
    n = F.coalesce("comparables_count", F.lit(0))
    scored = n >= cfg.min_comparables
    price = F.col("price_eur")
    disc = F.when(scored, (F.col("median") - price) / F.col("median") * 100)
    low = F.when(scored, (F.col("low") - price) / F.col("low") * 100)
    score = P.deal_score(disc, n, cfg.min_comparables)

    def tenth(c: Column) -> Column:
        return round_half_up(c * 10) / 10

    return joined.select(
        *subjects.columns, score.alias("score"), P.verdict(score).alias("verdict"),
        P.confidence(n, F.coalesce("neighborhood_matches", F.lit(0)), cfg.min_comparables).alias("confidence"),
        *[F.when(scored, round_half_up(F.col(c))).alias(f"market_{c}") for c in ("median", "low", "high", "mean")],
        tenth(disc).alias("discount_pct"), tenth(low).alias("discount_vs_low_pct"),
        n.alias("comparables_count"), F.when(scored, F.col("neighborhood_matches")).alias("neighborhood_matches"),
        F.when(scored, F.transform("first", lambda x: F.struct(
            x["price_eur"].alias("price"), x["size_sqm"].alias("size"), x["neighborhood"].alias("neighborhood"),
            x["url"].alias("url")))).alias("comparables"))
