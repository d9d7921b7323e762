"""Subscriber alerts: who gets which deals, and what is remembered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from compframe.config import ALERT_LIMIT
from compframe.functions import text as T
from compframe.operators import ranking

ANY_CITY = "*"


def clean_subscribers(requests: DataFrame) -> DataFrame:
    """Subscription requests as accepted: e-mail, listed towns, threshold. Bad e-mails drop out."""
    return requests.select(
        "id", T.clean_email("email").alias("email"),
        T.known_cities(T.json_list("cities_json")).alias("cities"),
        T.clamp_discount("threshold_text").alias("min_discount"),
    ).where(F.col("email").isNotNull())


def verified(subscribers: DataFrame) -> DataFrame:
    """Verified subscribers with decoded lists; no threshold means 20."""
    return subscribers.where("verified").select(
        "id", T.json_list("cities_json").alias("cities"),
        F.coalesce(F.nullif("min_discount", F.lit(0)), F.lit(20)).alias("min_discount"),
        T.json_list("last_deal_ids_json").alias("sent"))


def match_alerts(deals: DataFrame, subscribers: DataFrame, limit: int = ALERT_LIMIT) -> DataFrame:
    """First ``limit`` unsent deals of every verified subscriber, in published order.

    Published order falls with the discount, so the deals that pass a threshold are a prefix of it. Deals are numbered
    once in every town and in all; sent ids become numbers, and from them follows by counting which numbers are a
    subscriber's first unsent ones. These are looked up, ``limit`` a town: nobody meets a list, and no list is cut for all
    by the longest history.
    """
    subs = verified(subscribers)
    known = deals.where(F.col("discount") > 0).withColumn("want", F.explode(F.array(F.col("city"), F.lit(ANY_CITY)))).select(
        "want", F.col("id").alias("deal_id"), "id", "discount", "price", "price_eur")
    lists = ranking.numbered(known, ["want"], ranking.publish_order(), "nth").drop("id")

    wants = F.when(F.size("cities") > 0, F.array_distinct("cities")).otherwise(F.array(F.lit(ANY_CITY)))
    asks = subs.withColumn("want", F.explode(wants))
    sent = asks.select("id", "want", F.explode(F.array_distinct("sent")).alias("deal_id")).join(lists.select("want", "deal_id", "nth"), ["want", "deal_id"])
    # the i-th sent number puts off the end of the first unsent ones if fewer than ``limit`` unsent stand before it
    i = F.row_number().over(Window.partitionBy("id", "want").orderBy("nth"))
    gone = sent.withColumn("unsent", F.col("nth") - i).groupBy("id", "want").agg(
        F.count_if(F.col("unsent") < limit).alias("skipped"), F.collect_set("nth").alias("gone"))
    numbers = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.lit(limit) + F.coalesce("skipped", F.lit(0).cast("bigint"))),
                             F.coalesce("gone", F.array().cast("array<bigint>")))
    hits = (asks.select("id", "want", "min_discount").join(gone, ["id", "want"], "left").select("id", "want", "min_discount", F.explode(numbers).alias("nth"))
            .join(lists, ["want", "nth"]).where(F.col("discount") >= F.col("min_discount")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(
        F.col("discount").desc(), F.col("price").asc(), F.col("price_eur").asc(),
        F.col("deal_id").cast("bigint").asc()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select(
        F.col("id").alias("subscriber_id"), "deal_id", "rank", "discount")


def mark_sent(subscribers: DataFrame, matches: DataFrame, mode: str = "overwrite") -> DataFrame:
    """Subscribers with their new list of sent ids.

    The published rule overwrites the list with this run's ids; ``history`` appends.
    """
    run = matches.groupBy(F.col("subscriber_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "deal_id"))),
                    lambda x: x["deal_id"]).alias("now_sent"))
    before = T.json_list("last_deal_ids_json")
    after = F.col("now_sent") if mode == "overwrite" else F.array_union(before, F.col("now_sent"))
    return subscribers.join(run, "id", "left").select(
        "id", F.to_json(F.coalesce(after, before)).alias("last_deal_ids_json"),
        F.col("now_sent").isNotNull().alias("sent_now"))
