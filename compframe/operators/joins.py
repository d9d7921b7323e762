"""Rule matching with null meaning any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from compframe.operators.running import END, first_cut, values_at
from compframe.session import staged

ANY = "*"
PAIRS = 500                  # pairs a row up to which a plain join costs less than the passes
STEP, STEPS = 5000.0, 100    # classes of the first cut of prices; the last one is open
SHAPE = ["city_key", "min_price", "max_price", "keywords"]


def _shapes(rules: DataFrame) -> DataFrame:
    return rules.where("active").withColumns({
        "city_key": F.coalesce("city", F.lit(ANY)),
        "min_price": F.coalesce("min_price", F.lit(float("-inf"))),
        "max_price": F.coalesce("max_price", F.lit(float("inf"))),
        "keywords": F.transform(F.array_sort(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>")))), F.lower),
    })


def match_rules(rules: DataFrame, deals: DataFrame) -> DataFrame:
    """(city_key, min_price, max_price, keywords, deal columns) for each distinct rule and matching deal.

    Users with the same rule share its rows. A rule for one town meets that town's deals
    only; a rule for any town meets every deal, which is what it asks for.
    """
    shapes = _shapes(rules).select(*SHAPE).distinct()
    keyed = deals.withColumn("city_key", F.explode(F.array("city", F.lit(ANY))))
    return shapes.join(keyed, "city_key").where(_fits())


def _fits() -> Column:
    low = F.lower(F.coalesce("text", F.lit("")))
    return F.col("price").between(F.col("min_price"), F.col("max_price")) & F.forall("keywords", lambda k: F.contains(low, k))


def _few(kinds: DataFrame, cells: DataFrame) -> bool:
    """Whether rules and cells of the same town, or of any, make at most ``PAIRS`` pairs for each of them."""
    k = kinds.groupBy("city_key").agg(F.count("*").alias("k"))
    c = cells.groupBy(F.coalesce("city", F.lit("")).alias("city_key")).agg(F.count("*").alias("c"))
    c = c.unionByName(c.agg(F.lit(ANY).alias("city_key"), F.sum("c").alias("c")))
    pairs, rows = k.join(c, "city_key", "left").agg(F.sum(F.col("k") * F.coalesce("c", F.lit(0))), F.sum(F.col("k") + F.coalesce("c", F.lit(0)))).first()
    return (pairs or 0) <= PAIRS * (rows or 0)


def _texts_of_sets(sets: DataFrame, cells: DataFrame) -> DataFrame:
    """(kw, text): which texts hold all keywords of which set.

    A set is looked up by its longest keyword: pieces of that length of the distinct texts are equi-join keys, and only
    what shares one is tested for the other keywords.
    """
    longest = F.array_max(F.transform("keywords", lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
    asked = sets.withColumn("probe", longest["k"])
    lengths = asked.agg(F.collect_set(F.length("probe")).alias("lengths"))  # one row
    texts = cells.select("text").where("text IS NOT NULL").distinct().withColumn("low", F.lower("text"))
    low = F.col("low")
    pieces = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length(low)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substr(low, i, n)))))
    found = texts.join(F.broadcast(lengths), F.lit(True)).select("text", "low", F.explode(pieces).alias("probe")).join(asked, "probe")
    return found.where(F.forall("keywords", lambda k: F.contains(F.col("low"), k))).select("kw", "text").distinct()


def rule_summary(rules: DataFrame, deals: DataFrame) -> DataFrame:
    """Number of matching deals and the cheapest one per user.

    Deals are counted by town, price and text first. A rule is a price interval over a place: its town or any, and its
    set of keywords, whose deals are found by an index of keywords. Intervals are counted, and their lowest price found, by
    running sums, so a rule for any town does not meet the deals. Only where a count says that all meetings together are
    few for the size of the tables are rules and cells joined outright.
    """
    shapes = _shapes(rules).withColumn("kw", F.array_join("keywords", "\x1f"))
    kinds = staged(shapes.select("city_key", "kw", "keywords", "min_price", "max_price").distinct().withColumn(
        "tid", F.monotonically_increasing_id()), "rule-shapes")
    cells = staged(deals.where(F.col("price").isNotNull()).groupBy("city", F.col("price").cast("double").alias("price"), "text").agg(
        F.count("*").alias("n")), "rule-cells")
    if _few(kinds, cells):
        keyed = cells.withColumn("city_key", F.explode(F.array("city", F.lit(ANY))))
        hits = kinds.join(keyed, "city_key").where(_fits()).groupBy("tid").agg(F.sum("n").alias("deals"), F.min("price").alias("cheapest"))
        return shapes.join(kinds.drop("keywords").join(hits, "tid"), ["city_key", "kw", "min_price", "max_price"]).select("user_id", "deals", "cheapest")
    sets = kinds.where(F.size("keywords") > 0).select("kw", "keywords").distinct()
    held = cells.join(_texts_of_sets(sets, cells), "text").select("city", "price", "n", "kw").unionByName(
        cells.select("city", "price", "n", F.lit("").alias("kw")))
    place = ["city_key", "kw"]
    rows = held.withColumn("city_key", F.explode(F.array("city", F.lit(ANY)))).where("city_key IS NOT NULL").groupBy(
        *place, "price").agg(F.sum("n").alias("n")).select(*place, F.col("price").alias("position"), F.col("price").alias("value"), "n")
    open_end = F.when(F.col("max_price") == F.lit(float("inf")), F.lit(END)).otherwise(F.col("max_price"))
    windows = kinds.select("tid", *place, F.col("min_price").alias("lo"), open_end.alias("hi"))
    cut = staged(first_cut(rows, windows, place, STEP, STEPS), "rule-counts")
    targets = staged(windows.join(cut.select("tid", F.col("low").alias("digit"), F.lit(0).cast("bigint").alias("rank")), "tid"), "rule-targets")
    hits = cut.select("tid", F.col("n").alias("deals")).join(
        values_at(rows, targets, place, STEP, STEPS).withColumnRenamed("value", "cheapest"), "tid").join(
        kinds.drop("keywords"), "tid")
    return shapes.join(hits, ["city_key", "kw", "min_price", "max_price"]).select("user_id", "deals", "cheapest")
