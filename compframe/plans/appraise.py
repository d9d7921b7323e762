"""Older scoring job: window, enrich, keep residential, appraise, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from compframe.config import AppraisalConfig
from compframe.functions import text as T
from compframe.functions.core import once
from compframe.operators import filters
from compframe.operators.extract_posts import enrich_description
from compframe.operators.nearest import appraise
from compframe.session import spread, staged


def enriched(listings: DataFrame) -> DataFrame:
    """Listings with the fields their description gives, else their own."""
    text = F.coalesce(F.nullif("description", F.lit("")), F.nullif("address", F.lit("")), F.lit(""))
    d = once(listings, listings.columns, enrich_description(text).alias("d"))
    size = F.coalesce("d.size_sqm", "size_sqm")
    return d.withColumns({
        "city": F.coalesce(T.normal_city("city"), "city"),
        "neighborhood": F.coalesce("d.neighborhood", "neighborhood"),
        "property_type": F.when(F.col("d.rooms").isNotNull(), F.concat(F.col("d.rooms").cast("string"), F.lit("-стаен")))
        .otherwise(F.col("d.property_type")),
        "size_sqm": size, "rooms": F.col("d.rooms"), "construction": F.col("d.construction"),
    }).drop("d")


def analyze_deals(listings: DataFrame, market: DataFrame, cfg: AppraisalConfig = AppraisalConfig(),
                  cities: list[str] | None = None) -> DataFrame:
    """Every listing in the window with its score."""
    rows = listings.where(filters.candidate_window(cities, cfg, inclusive=False))
    # the appraisal reads its subjects twice, their descriptions are read once, on all cores
    return appraise(staged(enriched(spread(rows)).where(filters.residential()), "described"), market, cfg)


def top_deals(scored: DataFrame, cfg: AppraisalConfig = AppraisalConfig()) -> DataFrame:
    """Best scored deals; ties by discount, then id."""
    return scored.where(filters.reportable(F.col("score"), cfg.min_score)).orderBy(
        F.coalesce("score", F.lit(0)).desc(), F.coalesce("discount_pct", F.lit(0.0)).desc(), F.col("id").asc(),
    ).limit(cfg.report_limit)


def score_distribution(scored: DataFrame) -> DataFrame:
    """Rows per score, 5 to 0 and unscored, empty scores included."""
    spark = scored.sparkSession
    buckets = spark.createDataFrame([(5,), (4,), (3,), (2,), (1,), (0,), (None,)], "score int")
    counts = scored.groupBy("score").agg(F.count("*").alias("n")).withColumnRenamed("score", "s")
    return buckets.join(counts, F.expr("score <=> s"), "left").select("score", F.coalesce("n", F.lit(0)).alias("n"))


def report(scored: DataFrame, cfg: AppraisalConfig = AppraisalConfig()) -> DataFrame:
    """Head of the report as one JSON text: counts and the top deals (at most ``report_limit``).

    The list of all scores grows with the data; it is written beside the head as JSON lines.
    """
    shown = ["id", "city", "price_eur", "score", "discount_pct", "comparables_count"]
    scored = staged(scored.select(*shown), "scored")  # counted and ranked
    top = top_deals(scored, cfg)
    first = top.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("o1"), (-F.col("discount_pct")).alias("o2"), "id", "city", "price_eur", "score",
        "discount_pct", "comparables_count"))).alias("deals"))
    head = scored.agg(F.count("*").alias("listings"), F.count_if(filters.reportable(F.col("score"), cfg.min_score)).alias("deals_found"))
    deals = F.transform("deals", lambda d: d.dropFields("o1", "o2"))
    one = head.withColumn("k", F.lit(1)).join(first.withColumn("k", F.lit(1)), "k")
    return one.select(F.to_json(F.struct("listings", "deals_found", deals.alias("top_deals"))).alias("report"))


