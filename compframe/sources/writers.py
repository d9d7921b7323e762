"""Sinks. Large results are written as many part files, never through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe import lookups as L
from compframe.config import AppraisalConfig
from compframe.operators.incremental import copy_missing
from compframe.operators.ranking import publish_order
from compframe.plans.appraise import report
from compframe.session import staged


def write_deals(deals: DataFrame, path: str, now: Column) -> None:
    """Deals in published order as JSON lines, with a head that names date and sources.

    ``deals`` still carries price_eur, the last but one sort key.
    """
    deals = staged(deals, "deals")
    deals.orderBy(*publish_order()).drop("price_eur").write.mode("overwrite").json(f"{path}/deals", ignoreNullFields=False)
    head = deals.agg(F.count("*").alias("deals")).select(
        F.date_format(now, "dd.MM.yyyy").alias("generated_at"), F.array(*[F.lit(s) for s in L.DEAL_SOURCES]).alias("sources"), "deals")
    head.write.mode("overwrite").json(f"{path}/head")


def deals_document(deals: DataFrame, now: Column) -> DataFrame:
    """Lines of the envelope document in order; written as text, the part files joined in
    name order are one valid JSON document."""
    fields = [c for c in deals.columns if c != "price_eur"]
    deals = staged(deals.withColumn("_row", F.monotonically_increasing_id()), "document")  # numbers that stay, and one evaluation
    first = deals.orderBy(*publish_order(), "_row").limit(1).select(F.col("_row").alias("_first"))
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    rows = deals.join(F.broadcast(first), F.col("_row") == F.col("_first"), "left").select(
        F.lit(1).alias("part"), *deals.columns,
        F.when(F.col("_first").isNotNull(), body).otherwise(F.concat(F.lit(","), body)).alias("line"))
    sources = F.to_json(F.array(*[F.lit(s) for s in L.DEAL_SOURCES]))
    head = F.concat(F.lit('{"generated_at":"'), F.date_format(now, "dd.MM.yyyy"), F.lit('","sources":'), sources, F.lit(',"deals":['))
    one = deals.sparkSession.range(1)
    ends = one.select(F.lit(0).alias("part"), head.alias("line")).unionByName(one.select(F.lit(2).alias("part"), F.lit("]}").alias("line")))
    return rows.unionByName(ends, allowMissingColumns=True).orderBy("part", *publish_order(), "_row").select("line")


def write_deals_document(deals: DataFrame, path: str, now: Column) -> None:
    deals_document(deals, now).write.mode("overwrite").text(path)


def publish_if_ok(deals: DataFrame, verdict: DataFrame, path: str, now: Column) -> str:
    """Write the deals only after a run whose verdict is ok; whatever was published before stays otherwise."""
    said = verdict.first()["verdict"]
    if said == "ok":
        write_deals(deals, path, now)
    return said


def write_market_json(market: DataFrame, path: str) -> None:
    """Store dump by town and price per m2, without the district."""
    market.select("city", "size_sqm", "price_eur", "price_per_sqm", "rooms", "source", "scraped_at").orderBy(
        "city", "price_per_sqm").write.mode("overwrite").json(path, ignoreNullFields=False)


def write_report(scored: DataFrame, path: str, cfg: AppraisalConfig = AppraisalConfig()) -> None:
    """Report head with the top deals, and all scores beside it as JSON lines."""
    report(scored, cfg).write.mode("overwrite").text(f"{path}/report")
    scored.select("id", "city", F.col("price_eur").alias("price"), "score", F.col("discount_pct").alias("discount"),
                  F.col("comparables_count").alias("comparables")).orderBy(
        F.coalesce("score", F.lit(0)).desc(), F.coalesce("discount_pct", F.lit(0.0)).desc(), "id",
    ).write.mode("overwrite").json(f"{path}/scores")


def snapshot(market: DataFrame, path: str) -> None:
    """Market extract, one folder per town, replaced town by town.

    A large town is spread over several files by its sizes.
    """
    market.repartition("city", F.floor(F.col("size_sqm") / 10)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("city").parquet(path)


def write_source(extract: DataFrame, path: str) -> None:
    """Store partitions of the sources in the extract are replaced, others stay."""
    extract.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def append_missing(src: DataFrame, dst: DataFrame, path: str, key: str = "email") -> DataFrame:
    """Append the rows ``dst`` (stored at ``path``) does not hold; returns migrated and skipped."""
    fresh, counts = copy_missing(src, dst, key)
    done = counts.first()
    fresh.write.mode("append").parquet(path)
    return src.sparkSession.createDataFrame([done])
