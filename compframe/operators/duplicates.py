"""Likely copies of one property across agencies.

Listings that agree in every scored field are one *profile*. Profiles, not listings, are
compared, so a crowd of copies costs one row. A pair needs 0.65 points, which only four
combinations of close fields can reach:

    district + type + area     district + type + price
    district + area + price    type + area + price

Each is an equi-join on three keys: similar texts come from a table of similar distinct
texts, close numbers from logarithmic buckets with their neighbours. No other pair can
score enough, so nothing is lost and no block of one field alone is ever paired.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from compframe.config import DuplicateConfig
from compframe.functions import price as P
from compframe.session import staged, staged_together, unstage

PROFILE = ["district", "property_type", "area_sqm", "price_eur", "floor_text"]
# Points of alike fields; of close ones the nearer and the farther bound's.
WEIGHTS = {"d": 0.30, "t": 0.20, "s": (0.25, 0.15), "p": (0.20, 0.10), "f": 0.05}
#: So many floor texts are compared all with all before any pair of profiles is known (speed only).
FEW_TEXTS = 500


def quick_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Upper bounds of the likeness of many pairs at once, from their numbers of characters of each of 64 classes."""
    counts, size = [], []
    for side in (a, b):
        points = np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, side), np.int64, len(side))
        of = np.repeat(np.arange(len(side)), n)
        counts.append(np.bincount(of * 64 + points % 64, minlength=len(side) * 64).reshape(-1, 64))
        size.append(n)
    return 2 * np.minimum(*counts).sum(axis=1) / np.maximum(sum(size), 1)


def _ratio(x: str, y: str) -> float:
    return SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts, 0 if either is empty. The order of the arguments matters."""
    return pd.Series([_ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def ratio_above(threshold: float) -> Callable[[Column, Column], Column]:
    """Likeness of two texts where it is above the threshold, else 0; blocks of one text are matched only for pairs that a
    bound on the whole batch leaves."""
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.fillna("").tolist(), b.fillna("").tolist()
        out = np.zeros(len(x))
        for i in np.flatnonzero(quick_ratios(x, y) > threshold).tolist():
            out[i] = _ratio(x[i], y[i])
        return pd.Series(np.where(out > threshold, out, 0.0))
    return run


def similar_texts(values: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ratio) for ordered pairs of distinct texts with ratio above the threshold.

    ``values`` is one column ``v`` of distinct texts. The blocks that a ratio r matches are a common subsequence, so of
    total length T at most (1 - r) T letters are deleted or inserted, and a deletion destroys two pieces of two letters,
    an insertion one. Hence two texts share so many pieces that some of the rarest of each must be among them: a text is
    indexed by its pieces, rarest first, as many as there may be others less those that must be shared. A common piece
    makes pairs only of texts that have little else. Lengths differ by less than half; both are join keys before the
    exact ratio is computed.
    """
    if threshold < 0.8:
        raise ValueError("two-letter pieces are complete only from 0.8 up")
    n = F.length("v")
    letters = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(F.col("v"), i, F.lit(2)))
    # a piece that comes again is one of its own, numbered
    pieces = F.transform(F.array_distinct("all"), lambda g: F.struct(g.alias("g"), F.size(F.filter("all", lambda x: x == g)).alias("times")))
    each = values.where(n >= 2).select("v", n.alias("n"), letters.alias("all")).select("v", "n", F.explode(pieces).alias("p")).select(
        "v", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("p.times")), lambda k: F.concat(F.col("p.g"), k.cast("string")))).alias("g"))
    each = staged(each, "text-pieces")
    rarity = each.groupBy("g").agg(F.count("*").alias("texts"))
    # with a partner of m letters: T = n + m, fewer than (1 - r) T / 2 + (n - m) / 2 deletions and (1 - r) T / 2 + (m - n) / 2 insertions;
    # the most pieces are lost to the longest partner there can be or to the shortest one, as the sum is linear in m
    def lost(m: Column) -> Column:
        most = F.lit(1 - threshold) * (F.col("n") + m) / 2
        return 2 * (most + (F.col("n") - m) / 2) + most + (m - F.col("n")) / 2

    far = F.col("n") * threshold / (2 - threshold), F.col("n") * (2 - threshold) / threshold
    keep = F.least(F.col("n") - 1, F.floor(F.greatest(lost(far[0]), lost(far[1]))).cast("int") + 1)
    order = Window.partitionBy("v").orderBy("texts", "g")
    index = each.join(rarity, "g").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).select("v", "n", "g")
    a = index.select(F.col("v").alias("a"), F.col("n").alias("na"), "g")
    b = index.select(F.col("v").alias("b"), F.col("n").alias("nb"), "g")
    total = F.col("na") + F.col("nb")
    fits = 2.0 * F.least("na", "nb") / total > threshold
    pairs = a.join(b, "g").where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()
    scored = pairs.select("a", "b", ratio_above(threshold)("a", "b").alias("ratio")).where(F.col("ratio") > threshold)
    same = values.where(F.col("v") != "").select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("ratio"))
    return scored.unionByName(same)


def profiles(listings: DataFrame) -> DataFrame:
    """Distinct profiles with the lowest and highest listing id, the agencies of those, and
    the lowest and highest id of any other agency."""
    per_agency = listings.groupBy(*PROFILE, "agency").agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    group = Window.partitionBy(*PROFILE)
    ranked = per_agency.withColumns({"up": F.row_number().over(group.orderBy("lo")),
                                     "down": F.row_number().over(group.orderBy(F.col("hi").desc()))})
    up, down = F.col("up"), F.col("down")
    return ranked.groupBy(*PROFILE).agg(
        F.sum("n").alias("listings"), F.min("lo").alias("first_id"), F.max("hi").alias("last_id"),
        F.max(F.when(up == 1, F.col("agency"))).alias("first_agency"),
        F.max(F.when(down == 1, F.col("agency"))).alias("last_agency"),
        F.max(F.when(up == 2, F.col("lo"))).alias("other_first_id"),
        F.max(F.when(down == 2, F.col("hi"))).alias("other_last_id"))


def _paired(a: Column, b: Column) -> Column:
    """True where some listing of ``a`` has a lower id than one of ``b`` in another agency."""
    return F.when(a["first_agency"] != b["last_agency"], a["first_id"] < b["last_id"]).otherwise(
        F.coalesce(a["first_id"] < b["other_last_id"], F.lit(False))
        | F.coalesce(a["other_first_id"] < b["last_id"], F.lit(False)))


def _bucket(c: Column, rel: float) -> Column:
    """Numbers within ``rel`` of the larger one are at most one bucket apart."""
    return F.floor(F.log(c) / F.lit(-math.log(1 - rel) * (1 + 1e-9)))


def _around(c: Column) -> Column:
    return F.explode(F.array(c - 1, c, c + 1))


def _close_texts(rows: DataFrame, field: str, threshold: float) -> DataFrame:
    values = rows.where(F.col(field).isNotNull()).select(F.col(field).alias("v")).distinct()
    return similar_texts(values, threshold)


def _points(d: Column, t: Column, area: Column, price: Column, floor: Column, cfg: DuplicateConfig) -> Column:
    """Confidence from what is alike. Points are added in a fixed order, because 0.30+0.15+0.20 must stay below 0.65."""
    def points(*steps: tuple[Column, float]) -> Column:
        out = F
        for cond, value in steps:
            out = out.when(cond, F.lit(value))
        return out.otherwise(F.lit(0.0))

    w = WEIGHTS
    return F.least(F.lit(1.0), points((d, w["d"])) + points((t, w["t"]))
                   + points((area <= cfg.area_near, w["s"][0]), (area <= cfg.area_far, w["s"][1]))
                   + points((price <= cfg.price_near, w["p"][0]), (price <= cfg.price_far, w["p"][1]))
                   + points((floor, w["f"])))


def _keyed(rows: DataFrame, cfg: DuplicateConfig) -> DataFrame:
    """Profiles with the keys of the blocks: district, type, and buckets of area and price."""
    return rows.select("*", F.col("district").alias("d"), F.col("property_type").alias("t"),
                       F.when(F.col("area_sqm") > 0, _bucket(F.col("area_sqm"), cfg.area_far)).alias("s"),
                       F.when(F.col("price_eur") > 0, _bucket(F.col("price_eur"), cfg.price_far)).alias("p"))


def possible_pairs(rows: DataFrame, districts: DataFrame, kinds: DataFrame, cfg: DuplicateConfig) -> DataFrame:
    """(pid_a, pid_b, a, b, d_ratio, t_ratio, area, price) of every ordered pair that reaches the threshold if its floors are alike.

    Each pair comes from one block only: district, type and area, else district, type and price, else the block of its one
    alike text. So the blocks are joined with both sides' fields at hand, and no pair is moved to be made distinct or
    to meet its fields.
    """
    keyed = _keyed(rows, cfg)
    x = F.struct(*[c for c in rows.columns if c != "pid"])
    one = keyed.select(F.col("pid").alias("pid_a"), x.alias("a"), "d", "t", "s", "p", F.col("s").alias("s_a"))
    other = keyed.select(F.col("pid").alias("pid_b"), x.alias("b"), "d", "t", "s", "p", F.col("s").alias("s_b"))
    ratio = {"d": districts.select(F.col("a").alias("d"), F.col("b").alias("d2"), F.col("ratio").alias("d_ratio")),
             "t": kinds.select(F.col("a").alias("t"), F.col("b").alias("t2"), F.col("ratio").alias("t_ratio"))}
    none = F.lit(None).cast("double")

    def scored(pairs: DataFrame) -> DataFrame:
        out = pairs.where(_paired(F.col("a"), F.col("b"))).withColumns({
            "area": P.relative_delta(F.col("a.area_sqm"), F.col("b.area_sqm")),
            "price": P.relative_delta(F.col("a.price_eur"), F.col("b.price_eur"))})
        alike = F.col("d_ratio") > cfg.district_ratio, F.col("t_ratio") > cfg.type_ratio
        return out.where(_points(*alike, F.col("area"), F.col("price"), F.lit(True), cfg) >= cfg.min_confidence).select(
            "pid_a", "pid_b", "a", "b", "d_ratio", "t_ratio", "area", "price")

    def block(fields: str) -> DataFrame:
        left = one.where(" AND ".join(f"{f} IS NOT NULL" for f in fields))
        for f in fields:
            if f in "dt":
                left = left.join(ratio[f], f).drop(f).withColumnRenamed(f"{f}2", f)
            else:
                left = left.withColumn(f, _around(F.col(f)))
        for f in "dt":
            if f not in fields:
                left = left.withColumn(f"{f}_ratio", none)
        left = left.select("pid_a", "a", "s_a", "d_ratio", "t_ratio", *fields)
        return left.join(other.select("pid_b", "b", "s_b", *fields), list(fields)).where(F.col("pid_a") != F.col("pid_b"))

    def unlike(pairs: DataFrame, texts: DataFrame, field: str) -> DataFrame:
        known = texts.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        return pairs.join(known, (F.col(f"a.{field}") == F.col("_a")) & (F.col(f"b.{field}") == F.col("_b")), "left_anti")

    near = F.coalesce(F.abs(F.col("s_a") - F.col("s_b")) <= 1, F.lit(False))
    self_ratio = {f"{f}_ratio": F.when(F.col(f"a.{c}") != "", F.lit(1.0)) for f, c in (("d", "district"), ("t", "property_type"))}
    same = rows.where("other_first_id IS NOT NULL").select(F.col("pid").alias("pid_a"), F.col("pid").alias("pid_b"), x.alias("a"), x.alias("b"))
    parts = [scored(block("dts")), scored(block("dtp").where(~near)), unlike(scored(block("dsp")), kinds, "property_type"),
             unlike(scored(block("tsp")), districts, "district"), scored(same.withColumns(self_ratio))]
    return _all_of(parts)


def floor_likeness(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fa, fb, f_ratio) of ordered pairs of floor texts: of all where there are few texts, else of those in ``pairs`` (fa, fb)."""
    texts = rows.where("floor_text != ''").select(F.col("floor_text").alias("fa")).distinct()
    few = texts.limit(FEW_TEXTS + 1).count() <= FEW_TEXTS
    met = texts.crossJoin(texts.withColumnRenamed("fa", "fb")) if few else pairs.where("fa != '' AND fb != ''").distinct()
    return staged(met.withColumn("f_ratio", text_ratio("fa", "fb")), "floor-likeness")


def score_pairs(pairs: DataFrame, floors: DataFrame, cfg: DuplicateConfig) -> DataFrame:
    """Confidence of ``possible_pairs``."""
    d, t, f = (F.col(f"{x}_ratio") > limit for x, limit in (("d", cfg.district_ratio), ("t", cfg.type_ratio), ("f", cfg.floor_ratio)))
    area, price = F.col("area"), F.col("price")
    joined = pairs.withColumns({"fa": F.col("a.floor_text"), "fb": F.col("b.floor_text")}).join(floors, ["fa", "fb"], "left")
    reasons = F.concat_ws(
        ", ",
        F.when(d, F.format_string("district:%.2f", "d_ratio")),
        F.when(t, F.format_string("type:%.2f", "t_ratio")),
        F.when(area <= cfg.area_far, F.format_string("area_delta:%.3f", area)),
        F.when(price <= cfg.price_far, F.format_string("price_delta:%.3f", price)),
        F.when(f, F.format_string("floor:%.2f", "f_ratio")))
    return joined.withColumns({"confidence": _points(d, t, area, price, f, cfg), "reasons": reasons}).where(
        F.col("confidence") >= cfg.min_confidence)


def _compared(listings: DataFrame, cfg: DuplicateConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered profiles, and the ordered pairs of alike districts and types."""
    rows = staged(profiles(listings).withColumn("pid", F.monotonically_increasing_id()), "profiles")
    return rows, *staged_together(similar_districts=_close_texts(rows, "district", cfg.district_ratio),
                                  similar_types=_close_texts(rows, "property_type", cfg.type_ratio))


def _matches(rows: DataFrame, pairs: DataFrame, cfg: DuplicateConfig) -> DataFrame:
    floors = floor_likeness(rows, pairs.select(F.col("a.floor_text").alias("fa"), F.col("b.floor_text").alias("fb")))
    return score_pairs(pairs, floors, cfg).select("pid_a", "pid_b", "a", "b", "confidence", "reasons")


def duplicate_profiles(listings: DataFrame, cfg: DuplicateConfig = DuplicateConfig()) -> DataFrame:
    """Matching profile pairs (a, b): some listing of a has a lower id than one of b, in another agency.

    ``listings`` needs id, agency and the profile fields. One row stands for all its pairs of
    listings, however many; ``expand_pairs`` spells them out. A profile is paired with itself
    where it can match. The order counts because the text likeness depends on it.
    """
    rows, districts, kinds = _compared(listings, cfg)
    return _matches(rows, possible_pairs(rows, districts, kinds, cfg), cfg)


def _same_profile(left: str, right: str) -> Column:
    cond = F.lit(True)
    for f in PROFILE:
        cond = cond & F.col(f"{left}{f}").eqNullSafe(F.col(f"{right}{f}"))
    return cond


def expand_pairs(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """Listing pairs of different agencies, lower id first.

    The output is as large as the answer: a crowd of n copies gives n*n/2 rows. Use the
    profile pairs or the clusters where that is too much.
    """
    flat = matches.select(*[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "ab" for f in PROFILE], "confidence", "reasons")

    def side(name: str) -> DataFrame:
        return listings.select(F.col("id").alias(f"listing_id_{name}"), F.col("agency").alias(f"agency_{name}"),
                               *[F.col(f).alias(f"l{name}_{f}") for f in PROFILE])

    both = flat.join(side("a"), _same_profile("a_", "la_")).join(side("b"), _same_profile("b_", "lb_"))
    return both.where("agency_a != agency_b AND listing_id_a < listing_id_b").select(
        "listing_id_a", "listing_id_b", "confidence", "reasons")


def connected(edges: DataFrame) -> DataFrame:
    """(node, cluster) for every linked node; the cluster is the lowest node id it reaches.

    Alternates between linking higher neighbours to the lowest id around (large star) and
    re-linking lower neighbours (small star), which needs few rounds even on long chains.
    Every round is written to the shared folder and the one before is removed. A node with a
    third of all edges is only a key of a min aggregation, never one collected group.
    The links of a round stand still when their number and the sum of their hashes do.
    """
    links = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = staged(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u != v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = staged(
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        unstage(links, large)
        links, before, mark = small, mark, _mark(small)
        if mark == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def least_rules(cfg: DuplicateConfig) -> list[dict[str, float | bool]]:
    """What must be alike for a match, nothing more: texts by d, t, f, and how far area s and price p may be apart."""
    levels = {"d": [True], "t": [True], "s": [cfg.area_near, cfg.area_far], "p": [cfg.price_near, cfg.price_far], "f": [True]}
    found: list[dict[str, float | bool]] = []
    for chosen in itertools.product(*[[None, *reversed(v)] for v in levels.values()]):
        rule = {f: v for f, v in zip(levels, chosen, strict=True) if v is not None}
        got = 0.0
        for f, v in zip(levels, chosen, strict=True):
            w = WEIGHTS[f]
            got += 0.0 if v is None else w if isinstance(w, float) else w[levels[f].index(v)]
        if got >= cfg.min_confidence:
            found.append(rule)

    def covers(r: dict, q: dict) -> bool:
        return r != q and all(f in q and (v is True or q[f] <= v) for f, v in r.items())

    return [q for q in found if not any(covers(r, q) for r in found)]


def _mutual(texts: DataFrame) -> DataFrame:
    """Pairs (v, lo, hi): a text and each pair of texts, alike in both orders, that it is one of."""
    back = texts.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return texts.join(back, ["a", "b"], "left_semi").select(F.col("a").alias("v"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def _one_way(texts: DataFrame) -> DataFrame:
    back = texts.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return texts.join(back, ["a", "b"], "left_anti").select("a", "b")


def _apart(left: Column, right: Column, rel: float) -> Column:
    return F.coalesce(P.relative_delta(left, right) <= rel, F.lit(False))


def _cell(c: Column, rel: float) -> Column:
    """Cells so narrow that all of one are within ``rel``, and so wide that numbers within ``rel`` are two cells apart at most."""
    return F.floor(F.log(c) / F.lit(-math.log(1 - rel) * (1 - 1e-9)))


def _neighbours(rows: DataFrame, keys: list[str], value: str, rel: float) -> DataFrame:
    """Links of each row to the nearest rows of another colour below and above it, if they are within ``rel``.

    They connect all that links of every close pair connect: let k < i be close and of different colours, and j the nearest
    below i of another colour than i. If k and j differ in colour, or a row between them differs from both, the links
    follow from shorter spans; else the row after j is the nearest other one above both. Every close pair stands in one of
    the runs of three cells in which a row is put.
    """
    cells = rows.where(F.col(value) > 0).withColumn("_c", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(0)), lambda i: _cell(F.col(value), rel) + i)))
    group = Window.partitionBy(*keys, "_c")
    here = F.struct(F.col("pid").alias("pid"), F.col(value).alias("x"))
    out = None
    for order in ([F.col(value).asc(), F.col("pid").asc()], [F.col(value).desc(), F.col("pid").desc()]):
        w = group.orderBy(*order)
        turned = F.col("colour") != F.lag("colour").over(w)
        each = cells.withColumn("_before", F.when(turned, F.lag(here).over(w))).withColumn(
            "_near", F.last("_before", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        links = each.where(_apart(F.col(value), F.col("_near.x"), rel)).select(F.col("pid").alias("u"), F.col("_near.pid").alias("v"))
        out = links if out is None else out.unionByName(links)
    return out


def _crowds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links within groups in which all rows of different colours match: to the first row, from its own colour to the first other."""
    named = F.struct("pid", "colour")
    first = rows.groupBy(*keys).agg(F.min(named).alias("_first"))
    other = rows.join(first, keys).where(F.col("colour") != F.col("_first.colour")).groupBy(*keys).agg(
        F.first("_first").alias("_first"), F.min("pid").alias("_other"))
    return rows.join(other, keys).select(
        F.col("pid").alias("u"), F.when(F.col("colour") == F.col("_first.colour"), F.col("_other")).otherwise(F.col("_first.pid")).alias("v"))


def _across(rows: DataFrame, keys: list[str], rule: dict[str, float | bool]) -> DataFrame:
    """Links of close rows of different cells that are not in one component yet (``comp``).

    Neighbourhoods that are of one component are passed over before any pair is made.
    """
    x, y = F.col("area_sqm"), F.col("price_eur")
    celled = rows.withColumns({"_s": _cell(x, rule["s"]), "_p": _cell(y, rule["p"])})
    around = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.struct((F.floor(i / 5) - 2).alias("s"), (i % 5 - 2).alias("p")))

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("_o", F.explode(around)).withColumns({"_s": F.col("_s") + F.col("_o.s"), "_p": F.col("_p") + F.col("_o.p")}).drop("_o")

    at = [*keys, "_s", "_p"]
    cells = celled.groupBy(*at).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = spread(cells).groupBy(*at).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select(*at)
    middle = celled.join(mixed, at, "left_semi")  # each pair is met from both of its ends
    left = spread(middle).select(*at, *[F.col(c).alias(f"_{c}") for c in ("pid", "colour", "comp", "area_sqm", "price_eur")])
    return left.join(celled, at).where(
        (F.col("comp") != F.col("_comp")) & (F.col("colour") != F.col("_colour"))
        & _apart(x, F.col("_area_sqm"), rule["s"]) & _apart(y, F.col("_price_eur"), rule["p"])).select(F.col("_comp").alias("u"), F.col("comp").alias("v")).distinct()


def _one_way_matches(rows: DataFrame, districts: DataFrame, kinds: DataFrame, floors: DataFrame, cfg: DuplicateConfig) -> DataFrame:
    """Links of matches that rest on texts which are alike in one order only."""
    pairs = possible_pairs(rows, districts, kinds, cfg)
    matches = score_pairs(pairs, floors, cfg)
    odd = None
    for texts, field in ((districts, "district"), (kinds, "property_type"), (floors.where(F.col("f_ratio") > cfg.floor_ratio).select(F.col("fa").alias("a"), F.col("fb").alias("b")), "floor_text")):
        part = matches.join(_one_way(texts).select(F.col("a").alias("_a"), F.col("b").alias("_b")),
                            (F.col(f"a.{field}") == F.col("_a")) & (F.col(f"b.{field}") == F.col("_b")), "left_semi").select(
            F.col("pid_a").alias("u"), F.col("pid_b").alias("v"))
        odd = part if odd is None else odd.unionByName(part)
    return odd


def _component(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``comp``, the lowest pid that each reaches."""
    named = connected(links).select(F.col("node").alias("pid"), F.col("cluster").alias("_reached"))
    return rows.drop("comp").join(named, "pid", "left").withColumn("comp", F.coalesce("_reached", "pid")).drop("_reached")


def duplicate_clusters(listings: DataFrame, cfg: DuplicateConfig = DuplicateConfig()) -> DataFrame:
    """(id, cluster): listings joined by chains of matches; the cluster is its lowest id.

    Matches are not listed. If a profile matches any other, it matches itself, so its listings of several agencies are one
    component, and one of another agency is there for every other profile: a profile's colour is its agency, or its own
    where there are several, and profiles of different colours match if their fields do. Each of ``least_rules`` links
    as few as connect the same: nearest neighbours for one number, cells and then the borders of unlike components for two.
    """
    rows, districts, kinds = _compared(listings, cfg)
    rows = staged(rows.withColumn("colour", F.when(F.col("other_first_id").isNull(), F.concat(F.lit("a"), "first_agency")).otherwise(
        F.concat(F.lit("p"), F.col("pid").cast("string")))), "coloured")
    bucket = F.when(F.col("price_eur") > 0, _bucket(F.col("price_eur"), cfg.price_far))
    seen = rows.where("floor_text != ''").select("district", bucket.alias("p"), "floor_text").distinct()
    met = (seen.select(F.col("district").alias("a"), _around(F.col("p")).alias("p"), F.col("floor_text").alias("fa")).join(districts, "a")
           .join(seen.select(F.col("district").alias("b"), "p", F.col("floor_text").alias("fb")), ["b", "p"]).select("fa", "fb"))
    floors = floor_likeness(rows, met)
    alike = floors.where(F.col("f_ratio") > cfg.floor_ratio).select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    texts = {"d": ("district", districts), "t": ("property_type", kinds), "f": ("floor_text", alike)}
    mutual = {f: _mutual(t) for f, (_, t) in texts.items()}

    def grouped(rows: DataFrame, rule: dict) -> tuple[DataFrame, list[str]]:
        """Rows by the pairs of alike texts that they belong to."""
        keys = []
        for f in texts:
            if f in rule:
                m = mutual[f].select(F.col("v").alias("_v"), F.col("lo").alias(f"{f}_lo"), F.col("hi").alias(f"{f}_hi"))
                rows = rows.join(m, F.col(texts[f][0]) == F.col("_v")).drop("_v")
                keys += [f"{f}_lo", f"{f}_hi"]
        return rows.select(*keys, "pid", "colour", "area_sqm", "price_eur", *(["comp"] if "comp" in rows.columns else [])), keys

    value = {"s": "area_sqm", "p": "price_eur"}
    links, planes = [], []
    for rule in least_rules(cfg):
        numbers = [f for f in "sp" if f in rule]
        own, keys = grouped(rows, rule)
        if len(numbers) == 1:
            links.append(_neighbours(own, keys, value[numbers[0]], rule[numbers[0]]))
        else:
            own = own.where(" AND ".join(f"{value[f]} > 0" for f in numbers)) if numbers else own
            cells = {f"_{f}": _cell(F.col(value[f]), rule[f]) for f in numbers}
            links.append(_crowds(own.withColumns(cells), [*keys, *cells]))
            planes += [rule] if numbers else []
    if any(not _one_way(t).isEmpty() for _, t in texts.values()):
        links.append(_one_way_matches(rows, districts, kinds, floors, cfg))
    marked = staged(_component(rows, _all_of(links)), "components")
    border = []
    for rule in planes:
        own, keys = grouped(marked, rule)
        border.append(_across(own.where("area_sqm > 0 AND price_eur > 0"), keys, rule))
    named = connected(_all_of(border)) if border else None
    final = marked if named is None else marked.join(named.select(F.col("node").alias("comp"), F.col("cluster").alias("_c")), "comp", "left").withColumn(
        "comp", F.coalesce("_c", "comp")).drop("_c")
    # a profile alone is one component only if it matches itself and has listings of several agencies
    d, t, f = (F.coalesce(F.col(c) != "", F.lit(False)) for c in ("district", "property_type", "floor_text"))
    itself = (F.col("other_first_id").isNotNull() & (_points(d, t, P.relative_delta(F.col("area_sqm"), F.col("area_sqm")),
              P.relative_delta(F.col("price_eur"), F.col("price_eur")), f, cfg) >= cfg.min_confidence))
    sizes = final.groupBy("comp").agg(F.min("first_id").alias("cluster"), F.count(F.lit(1)).alias("n"))
    keyed = final.join(sizes, "comp").where((F.col("n") > 1) | itself).select("cluster", *[F.col(c).alias(f"k_{c}") for c in PROFILE])
    owned = listings.withColumnsRenamed({c: f"o_{c}" for c in PROFILE})
    return owned.join(keyed, _same_profile("o_", "k_"), "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def _all_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
