"""Comparables ladder: fuzzy district match, range match, exact upper median.

Nothing here joins subjects with market rows. Both sides are first reduced to what the
result depends on:

* subjects become distinct *keys* (town, district, size, band) and every pass of the
  ladder becomes a *window* over the market: a town, a district or the whole town, and a
  size interval;
* market rows become counted *cells* (town, district, size, price).

Windows are counted, and their medians and price ranges found, by running sums over the sizes of
a town or district (``running``): the cost grows with cells and windows, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe.config import ValuationConfig
from compframe.functions import price as P
from compframe.functions import text as T
from compframe import lookups as L
from compframe.operators.filters import sane_comparable
from compframe.operators.running import END, first_cut, values_at
from compframe.session import staged, staged_together

WHOLE_TOWN = ""              # district key of a town-wide window
WINDOW = ["city", "hood", "lo", "hi"]
KEY = ["city", "hood", "size", "band_lo", "band_hi"]


# ---------------------------------------------------------------- district pairs

def _hood_keys(norm: Column, outer: str, inner: str) -> Column:
    """Join keys that two names share if they are equal, aliases, of one cluster, or one contains the other.

    A name is a key under ``inner`` and each of its pieces one under ``outer``; the other side has them the other way round.
    """
    aliases = F.transform(F.filter(T.alias_table(), lambda e: (e["name"] == norm) | F.array_contains(e["names"], norm)),
                          lambda e: F.concat(F.lit("a"), e["name"]))
    clusters = F.transform(F.filter(T.cluster_table(), lambda m: F.array_contains(m, norm)), lambda m: F.concat(F.lit("c"), F.get(m, F.lit(0))))
    n = F.length(norm)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda size: F.transform(
        F.sequence(F.lit(1), n - size + 1), lambda at: F.concat(F.lit(outer), F.substr(norm, at, size)))))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit(inner), norm)), aliases, clusters, pieces))


def similar_hoods(left: DataFrame, right: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of normalised district names of the same town with similarity >= threshold.

    ``left`` and ``right`` hold distinct (city, hood) rows, already normalised. Names that
    are neither equal, contained, aliased nor clustered stay at 0.5 or less, so those four
    kinds are a complete set of candidates for any threshold above 0.5.
    """
    if threshold <= 0.5:
        raise ValueError("candidates are complete only for thresholds above 0.5")
    return similar_names(left.select("city", F.col("hood").alias("l_hood")), right.select("city", F.col("hood").alias("r_hood")), threshold)


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The same for (city, l_hood) and (city, r_hood) rows; further columns of ``right`` are kept."""
    a = left.where("l_hood <> ''").select("city", "l_hood", F.explode(_hood_keys(F.col("l_hood"), "<", ">")).alias("k"))
    b = right.where("r_hood <> ''").select("*", F.explode(_hood_keys(F.col("r_hood"), ">", "<")).alias("k"))
    pairs = a.join(b, ["city", "k"]).drop("k").distinct()
    scored = pairs.withColumn("similarity", T.normalized_similarity(F.col("l_hood"), F.col("r_hood")))
    return scored.where(F.col("similarity") >= threshold)


# ---------------------------------------------------------------- market cells

def sane_market(market: DataFrame, cfg: ValuationConfig) -> DataFrame:
    """The four market columns the ladder needs, comparison range applied."""
    return market.where(sane_comparable(F.col("price_per_sqm"), cfg)).select(
        "city", F.col("neighborhood").alias("hood"), F.col("size_sqm").alias("size"), F.col("price_per_sqm").alias("pps"))


def market_cells(market: DataFrame) -> DataFrame:
    """Equal rows counted; what is sorted and spread over scopes are cells."""
    return market.groupBy("city", "hood", "size", "pps").agg(F.count("*").alias("n"))


def in_scopes(cells: DataFrame, towns_only: bool = False) -> DataFrame:
    """Cells in the scopes that windows look at: their town and, if they name one, their district."""
    named = F.when(F.col("hood") != WHOLE_TOWN, F.col("hood"))
    scopes = F.array(F.lit(WHOLE_TOWN)) if towns_only else F.array_compact(F.array(F.lit(WHOLE_TOWN), named))
    return cells.where(F.col("city").isNotNull()).select("city", F.explode(scopes).alias("m_hood"), F.col("size").alias("position"), F.col("pps").alias("value"), "n")


# ---------------------------------------------------------------- windows

def _pass_windows(cfg: ValuationConfig) -> Column:
    """The passes open to a key, as an array of (pass, district, lo, hi)."""
    size, lo, hi = F.col("size"), F.col("band_lo"), F.col("band_hi")
    tol = F.lit(cfg.size_tolerance)
    near_lo, near_hi = size - tol, size + tol
    tight_lo, tight_hi = F.greatest(near_lo, lo), F.least(near_hi, hi)
    banded, named = lo >= 0, F.col("hood") != WHOLE_TOWN

    def window(when: Column, no: int, hood: Column, a: Column, b: Column) -> Column:
        return F.when(when & (a <= b), F.struct(
            F.lit(no).alias("pass"), hood.alias("hood"), a.alias("lo"), b.alias("hi")))

    hood, town = F.col("hood"), F.lit(WHOLE_TOWN)
    return F.array_compact(F.array(
        window(named & banded, 1, hood, tight_lo, tight_hi),
        window(named, 2, hood, near_lo, near_hi),
        window(named & banded, 3, hood, lo, hi),
        window(named, 4, hood, F.lit(float("-inf")), F.lit(float("inf"))),
        window(banded, 5, town, tight_lo, tight_hi),
        window(F.lit(True), 6, town, near_lo, near_hi),
    ))


def spread(windows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Windows with the market districts they cover, one row each; an open end takes in every row."""
    town = windows.where(F.col("hood") == WHOLE_TOWN).withColumn("m_hood", F.lit(WHOLE_TOWN))
    hood = windows.where(F.col("hood") != WHOLE_TOWN).join(pairs, ["city", "hood"])
    open_end = F.when(F.col("hi") == F.lit(float("inf")), F.lit(END)).otherwise(F.col("hi"))
    return town.unionByName(hood).withColumn("hi", open_end).drop("hood")


def _classes(cfg: ValuationConfig) -> int:
    """Price steps up to the end of the comparison range."""
    return int(cfg.pps_high // cfg.pps_bucket) + 1


def _targets(spread_windows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Spread windows with the class and rank of what is wanted of them; ``ranks``: wid, tid, digit, rank."""
    return spread_windows.withColumnRenamed("tid", "wid").join(ranks, "wid").drop("wid")


# ---------------------------------------------------------------- the ladder

def subject_key(subjects: DataFrame) -> DataFrame:
    """Subjects with the columns that decide their valuation."""
    band = P.room_band("property_type")
    return subjects.withColumns({
        "hood": F.coalesce(T.normalize_hood("auction_hood"), F.lit(WHOLE_TOWN)),
        "size": F.col("size_sqm"),
        "band_lo": F.coalesce(band["lo"], F.lit(-1.0)),
        "band_hi": F.coalesce(band["hi"], F.lit(-1.0)),
    })


def normal_names(rows: DataFrame, raw: str, out: str) -> DataFrame:
    """Distinct rows with the normalised name ``out`` of a district column, blank ones left out.

    Names are made distinct first and normalised behind a generator: a plain projection would let the
    optimizer merge both distinct steps and normalise every row.
    """
    return rows.distinct().withColumn(out, F.explode(F.array(T.normalize_hood(raw)))).where(F.col(out) != "")


def market_pairs(keys: DataFrame, hoods: DataFrame, cfg: ValuationConfig) -> DataFrame:
    """(city, subject district, market district as stored) for all similar districts; ``hoods`` are the stored ones."""
    a = keys.where(F.col("hood") != WHOLE_TOWN).select("city", F.col("hood").alias("l_hood")).distinct()
    b = hoods.where(F.col("hood") != WHOLE_TOWN).select("city", F.col("hood").alias("m_hood"))
    return similar_names(a, normal_names(b, "m_hood", "r_hood"), cfg.similarity).select("city", F.col("l_hood").alias("hood"), "m_hood")


def value_subjects(subjects: DataFrame, market: DataFrame,
                   cfg: ValuationConfig = ValuationConfig()) -> DataFrame:
    """Subjects with their market valuation.

    ``subjects`` needs city (clean), auction_hood, size_sqm and property_type; ``market``
    needs city, neighborhood, size_sqm and price_per_sqm. Adds market_median,
    comparables_count, match_pass (1..6), comparables_level, matched_hood and the price
    range of the town at that size (range_min, range_max). Unmatched rows keep nulls.
    """
    # subjects are read twice, their texts once
    keyed, cells = staged_together(ladder_subjects=subject_key(subjects), ladder_cells=market_cells(sane_market(market, cfg)))
    keys = staged(keyed.select(*KEY).distinct().withColumn("kid", F.monotonically_increasing_id()), "ladder-keys")
    tried = keys.withColumn("w", F.explode(_pass_windows(cfg))).select("kid", "city", "w.*")
    pairs, windows = staged_together(
        ladder_hoods=market_pairs(keys, cells, cfg),
        ladder_windows=tried.select(*WINDOW).distinct().withColumn("wid", F.monotonically_increasing_id()))

    place, classes = ["city", "m_hood"], _classes(cfg)
    scoped = in_scopes(cells)
    looked = spread(windows.withColumnRenamed("wid", "tid"), pairs)
    ranks = staged(first_cut(scoped, looked, place, cfg.pps_bucket, classes).withColumnRenamed("tid", "wid"), "ladder-ranks")
    enough = F.col("n") >= cfg.min_comparables
    picked = staged(
        tried.join(windows, WINDOW).join(ranks.select("wid", "n"), "wid").groupBy("kid")
        .agg(F.min(F.when(enough, F.struct("pass", "wid", "n"))).alias("pick"), F.max(F.when(F.col("pass") == 6, F.col("wid"))).alias("town_wid"))
        .where(F.col("pick").isNotNull()).select("kid", "pick.*", "town_wid"), "ladder-picked")

    used = picked.select("wid", F.lit(0).alias("kind")).unionByName(picked.select(F.col("town_wid").alias("wid"), F.lit(1).alias("kind"))).distinct()
    wanted = F.when(F.col("kind") == 0, F.array(F.struct(F.lit(0).alias("what"), "digit", "rank"))).otherwise(F.array(
        F.struct(F.lit(1).alias("what"), F.col("low").alias("digit"), F.lit(0).cast("bigint").alias("rank")),
        F.struct(F.lit(2).alias("what"), F.col("high").alias("digit"), F.col("high_rank").alias("rank"))))
    asked = ranks.join(used, "wid").select("wid", F.explode(wanted).alias("w")).select(
        "wid", (F.col("wid") * 3 + F.col("w.what")).alias("tid"), "w.digit", "w.rank")
    targets = staged(_targets(looked, asked), "ladder-targets")
    found = values_at(scoped, targets, place, cfg.pps_bucket, classes)
    wid, what = F.expr("tid DIV 3"), F.col("tid") % 3
    values = staged(found.groupBy(wid.alias("wid")).agg(*[
        F.max(F.when(what == i, F.col("value"))).alias(c) for i, c in enumerate(("market_median", "range_min", "range_max"))]), "ladder-values")
    valued = (
        picked.join(values.select("wid", "market_median"), "wid")
        .join(values.select(F.col("wid").alias("town_wid"), "range_min", "range_max"), "town_wid", "left").join(keys, "kid")
        .select(*KEY, "market_median", F.col("n").alias("comparables_count"), F.col("pass").alias("match_pass"), "range_min", "range_max")
    )
    by_hood = F.col("match_pass") <= 4
    return (
        keyed.join(valued, KEY, "left")
        .withColumns({
            "comparables_level": F.when(by_hood, "hood").when(~by_hood, "city_size"),
            "matched_hood": F.when(by_hood, F.col("auction_hood")),
        })
        .drop("hood", "size", "band_lo", "band_hi")
    )


def city_size_median(subjects: DataFrame, market: DataFrame,
                     cfg: ValuationConfig = ValuationConfig()) -> DataFrame:
    """The last pass alone: town and size +-tolerance, as (city, size, n, median, range)."""
    keys = subjects.select("city", F.col("size_sqm").alias("size")).where("city IS NOT NULL AND size_sqm IS NOT NULL").distinct()
    cells, windows = staged_together(
        ladder_cells=market_cells(sane_market(market, cfg)),
        town_windows=keys.select("city", F.lit(WHOLE_TOWN).alias("m_hood"), "size", (F.col("size") - cfg.size_tolerance).alias("lo"),
                                 (F.col("size") + cfg.size_tolerance).alias("hi")).withColumn("tid", F.monotonically_increasing_id()))
    place, classes = ["city", "m_hood"], _classes(cfg)
    scoped = in_scopes(cells, towns_only=True)
    looked = windows.drop("size")
    ranks = staged(first_cut(scoped, looked, place, cfg.pps_bucket, classes).where(F.col("n") >= cfg.min_comparables), "town-ranks")
    asked = ranks.select(F.col("tid").alias("wid"), F.explode(F.array(
        F.struct(F.lit(0).alias("what"), "digit", "rank"), F.struct(F.lit(1).alias("what"), F.col("low").alias("digit"), F.lit(0).cast("bigint").alias("rank")),
        F.struct(F.lit(2).alias("what"), F.col("high").alias("digit"), F.col("high_rank").alias("rank")))).alias("w")).select(
        "wid", (F.col("wid") * 3 + F.col("w.what")).alias("tid"), "w.digit", "w.rank")
    found = values_at(scoped, staged(_targets(looked, asked), "town-targets"), place, cfg.pps_bucket, classes)
    what = F.col("tid") % 3
    values = found.groupBy(F.expr("tid DIV 3").alias("tid")).agg(*[
        F.max(F.when(what == i, F.col("value"))).alias(c) for i, c in enumerate(("median", "pps_min", "pps_max"))])
    return windows.join(ranks.select("tid", "n"), "tid").join(values, "tid").select("city", "size", "n", "median", "pps_min", "pps_max")
