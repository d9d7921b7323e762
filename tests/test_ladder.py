"""The ladder against six separate queries, row by row in plain Python."""

import random

from pyspark.sql import functions as F

from compframe import lookups as L
from compframe.catalog import standin as S
from compframe.operators import running
from compframe.plans import appraise, districts, export as E
from compframe.session import staged
from compframe.operators.aggregates import upper_median
from compframe.operators.comparables import similar_hoods, value_subjects
from compframe.functions import text as T

HOODS = ["ж.к. Люлин 9", "Люлин", "Лозенец", "Център", "Бояна", "Левски", "Базар Левски", "Х1", None, ""]
TYPES = ["Едностаен апартамент", "Двустаен апартамент", "Апартамент", "Многостаен апартамент"]


def make(seed, subjects, market):
    rnd = random.Random(seed)
    town = lambda: rnd.choice(["A", "A", "B", "C"])
    subj = [(i, town(), rnd.choice(HOODS), rnd.choice([20.0, 35.5, 60.0, 61.0, 95.0, 300.0]), rnd.choice(TYPES)) for i in range(subjects)]
    rows = [(town(), rnd.choice(HOODS), float(rnd.randint(15, 120)), rnd.choice([100.0, 200.0, 201.0, 900.5, 1500.25, 1501.0, 2600.0, 4999.0, 5000.0, rnd.uniform(300, 4000)]))
            for _ in range(market)]
    return subj, rows


def band(kind):
    for word, lo, hi in L.ROOM_BANDS:
        if word in kind.lower():
            return lo, hi
    return None


def expected(subj, rows, similar):
    out = {}
    for i, city, hood, size, kind in subj:
        near = [(p, h, s) for c, h, s, p in rows if c == city and 200 < p < 5000]
        b, lo, hi = band(kind), size - 10, size + 10
        same = [(p, s) for p, h, s in near if hood and h and similar.get((hood, h), 0) >= 0.7]
        tight = (max(lo, b[0]), min(hi, b[1])) if b else None
        passes = [
            [p for p, s in same if b and tight[0] <= s <= tight[1]] if hood else [],
            [p for p, s in same if lo <= s <= hi], [p for p, s in same if b and b[0] <= s <= b[1]], [p for p, s in same],
            [p for p, h, s in near if b and tight[0] <= s <= tight[1]], [p for p, h, s in near if lo <= s <= hi],
        ]
        for no, prices in enumerate(passes, 1):
            if len(prices) >= 3:
                prices.sort()
                out[i] = (no, len(prices), prices[len(prices) // 2], min(passes[5], default=None), max(passes[5], default=None))
                break
        else:
            out[i] = (None, None, None, None, None)
    return out


def test_ladder_equals_six_queries(spark):
    subj, rows = make(3, 120, 260)
    names = [h for h in HOODS if h]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    similar = {(r.a, r.b): r.s for r in pairs.select("a", "b", T.hood_similarity("a", "b").alias("s")).collect()}
    s = spark.createDataFrame(subj, "id int, city string, auction_hood string, size_sqm double, property_type string")
    m = spark.createDataFrame(rows, "city string, neighborhood string, size_sqm double, price_per_sqm double")
    got = {r.id: (r.match_pass, r.comparables_count, r.market_median, r.range_min, r.range_max)
           for r in value_subjects(s, m).collect()}
    want = expected(subj, rows, similar)
    assert got == want
    assert {w[0] for w in want.values()} >= {1, 2, 5, 6}


def test_ladder_with_distinct_sizes_in_one_town(spark):
    rnd = random.Random(8)
    rows = [("A", rnd.choice(HOODS), rnd.uniform(15, 120), rnd.uniform(150, 5200)) for _ in range(900)]
    subj = [(i, "A", rnd.choice(HOODS), rnd.uniform(20, 110), rnd.choice(TYPES)) for i in range(60)]
    names = [h for h in HOODS if h]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    similar = {(r.a, r.b): r.s for r in pairs.select("a", "b", T.hood_similarity("a", "b").alias("s")).collect()}
    s = spark.createDataFrame(subj, "id int, city string, auction_hood string, size_sqm double, property_type string")
    m = spark.createDataFrame(rows, "city string, neighborhood string, size_sqm double, price_per_sqm double")
    got = {r.id: (r.match_pass, r.comparables_count, r.market_median, r.range_min, r.range_max) for r in value_subjects(s, m).collect()}
    assert got == expected(subj, rows, similar)


def test_similar_hoods_equal_all_pairs(spark):
    names = ["люлин", "лозенец", "център", "левски", "базар левски", "бояна", "витоша", "х", "изток", "източен", "люлин юг"]
    df = spark.createDataFrame([("A", n) for n in names], "city string, hood string")
    got = {(r.l_hood, r.r_hood) for r in similar_hoods(df, df).collect()}
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    want = {(r.a, r.b) for r in pairs.where(T.normalized_similarity(F.col("a"), F.col("b")) >= 0.7).collect()}
    assert got == want


def test_upper_median_with_one_hot_key(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{i % 17}", rnd.choice([rnd.uniform(0, 900), 50.0])) for i in range(3000)]
    got = {r.k: r.median for r in upper_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 10.0).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}


def windows_by_hand(cells, windows):
    """(n, median, lowest, highest) of every window, from whole lists."""
    out = {}
    for tid, places, lo, hi in windows:
        found = sorted(v for place, pos, v, n in cells for _ in range(n)
                       if place in places and ((lo == float("-inf") and hi != hi) or (pos is not None and lo <= pos <= hi)))
        if found:
            out[tid] = (len(found), found[len(found) // 2], found[0], found[-1])
    return out


def ranked(spark, cells, windows):
    from compframe.operators.running import first_cut, values_at
    c = spark.createDataFrame(cells, "place string, position double, value double, n long").repartition(5)
    w = spark.createDataFrame([(t, p, lo, hi) for t, places, lo, hi in windows for p in places], "tid long, place string, lo double, hi double")
    cut = first_cut(c, w, ["place"], 50.0, 101).persist()
    rows = {r.tid: r for r in cut.collect()}
    asked = [(3 * t + i, d, k, t) for t, r in rows.items() for i, (d, k) in enumerate(((r.digit, r["rank"]), (r.low, 0), (r.high, r.high_rank)))]
    targets = spark.createDataFrame(asked, "id long, digit int, rank long, tid long").join(w, "tid").drop("tid").withColumnRenamed("id", "tid")
    found = {r.tid: r.value for r in values_at(c, targets, ["place"], 50.0, 101).collect()}
    return {t: (r.n, *(found[3 * t + i] for i in range(3))) for t, r in rows.items()}


def running_case(seed, n, sizes, prices):
    rnd = random.Random(seed)
    cells = [(rnd.choice("aaab"), rnd.choice([None, *[sizes(rnd)] * 20]), prices(rnd), rnd.choice([1, 1, 1, 4])) for _ in range(n)]
    windows = []
    for t in range(80):
        x = sizes(rnd)
        windows.append((t, rnd.choice([["a"], ["b"], ["a", "b"], ["c"]]),
                        *rnd.choice([(x - 10, x + 10), (x, x), (x + 0.5, x + 30), (float("-inf"), float("nan"))])))
    return cells, windows


def test_running_sums_with_real_sizes_and_prices(spark, monkeypatch):
    """Every size and price its own: classes are cut again and again until few rows are left."""
    from compframe.operators import running
    monkeypatch.setattr(running, "PAIRS", 0)
    monkeypatch.setattr(running, "DEEPEST", 4)
    cells, windows = running_case(1, 4000, lambda r: r.uniform(10, 120), lambda r: r.uniform(0, 5050))
    assert ranked(spark, cells, windows) == windows_by_hand(cells, windows)


def test_running_sums_with_equal_sizes_and_prices(spark, monkeypatch):
    from compframe.operators import running
    monkeypatch.setattr(running, "PAIRS", 0)
    monkeypatch.setattr(running, "DEEPEST", 3)
    cells, windows = running_case(2, 3000, lambda r: float(r.choice([20, 30, 60])), lambda r: r.choice([50.0, 99.99, 100.0, 100.01, 4999.99, 7000.0]))
    assert ranked(spark, cells, windows) == windows_by_hand(cells, windows)


def test_one_town_of_distinct_sizes_costs_two_passes(spark):
    """100,000 distinct sizes and prices in one town: counted and selected against numpy."""
    import numpy as np
    from compframe.operators.running import first_cut, values_at
    r = np.random.default_rng(4)
    size, price = r.uniform(10, 150, 100_000), r.uniform(200, 5000, 100_000)
    lo = r.uniform(10, 130, 400)
    cells = spark.createDataFrame(list(zip(["t"] * len(size), size.tolist(), price.tolist(), [1] * len(size))), "place string, position double, value double, n long")
    w = spark.createDataFrame([(i, "t", float(x), float(x) + 20) for i, x in enumerate(lo)], "tid long, place string, lo double, hi double")
    cut = first_cut(cells, w, ["place"], 50.0, 101).select("tid", "n", "digit", "rank")
    got = {x.tid: x.value for x in values_at(cells, cut.drop("n").join(w, "tid"), ["place"], 50.0, 101).collect()}
    want = {i: float(np.sort(price[(size >= x) & (size <= x + 20)])[((size >= x) & (size <= x + 20)).sum() // 2]) for i, x in enumerate(lo)}
    assert got == want


def test_cells_of_one_class_and_position_are_sorted_as_one(spark, monkeypatch):
    """A pass sorts what differs in position or class, not every price."""
    seen, inner = spark.sparkContext.accumulator(0), running._look_up

    def counting(classes):
        run = inner(classes)

        def tallied(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b
            yield from run(each())
        return tallied

    monkeypatch.setattr(running, "_look_up", counting)
    rows = [("a", float(i % 10) if i % 11 else None, i * 0.37, 1 + i % 3) for i in range(4000)]
    spans = [(0, 2.0, 5.0), (1, float("-inf"), running.END), (2, 9.5, 9.9)]
    cells = spark.createDataFrame(rows, "town string, position double, value double, n bigint")
    windows = spark.createDataFrame([("a", *w) for w in spans], "town string, tid bigint, lo double, hi double")
    ranks = running.first_cut(cells, windows, ["town"], 100.0, 15)
    got = {r.tid: (r.n, r.digit) for r in ranks.collect()}
    assert seen.value <= 11 * 15 + 2 * len(spans)
    found = running.values_at(cells, windows.join(ranks.select("tid", "digit", "rank"), "tid"), ["town"], 100.0, 15)
    medians = {r.tid: r.value for r in found.collect()}
    for tid, lo, hi in spans[:2]:
        inside = sorted(v for _, p, v, n in rows if tid == 1 or (p is not None and lo <= p <= hi) for _ in range(n))
        median = inside[len(inside) // 2]
        assert got[tid] == (len(inside), int(median // 100)) and medians[tid] == median
    assert set(got) == {0, 1}


def test_deals_are_deduplicated_once(spark):
    """The valued kinds and the rest read one written result."""
    sf = "/root/testdata/sf0.001"
    deals = E.build_deals(S.auctions(spark, sf), S.market(spark, sf), S.now())
    assert "Window" not in deals._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_is_read_once_however_many_auctions_give_it(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(districts, "staged", lambda df, name: kept.append(staged(df, name)) or kept[-1])
    places = [("A", 'ж.к. "Люлин 9", бл. 1'), (None, 'ж.к. "Люлин 9", бл. 1'), ("A", "ул. Роза 7"), ("A", "ул"), ("A", None)]
    rows = [(i, *places[i % 5], None, "Двустаен апартамент", False) for i in range(50)]
    auctions = spark.createDataFrame(rows, "id bigint, city string, address string, neighborhood string, property_type string, is_expired boolean")
    empty = spark.createDataFrame([], "query string, " + ", ".join(f"{f} string" for f in L.GAZETTEER_FIELDS))
    got = {r.id: (r.city, r.address, r.neighborhood, r.method) for r in districts.fill_districts(auctions, empty).collect()}
    ways = [("люлин", "text"), ("люлин", "text"), (None, "none"), (None, "no_address"), (None, "no_address")]
    assert got == {i: (*places[i % 5], *ways[i % 5]) for i in range(50)}
    assert kept[0].count() == 3


def test_descriptions_are_read_once_for_the_report(spark, monkeypatch):
    """Subjects of the appraisal are written with what their descriptions give; scores are written before they are counted and ranked."""
    names = []
    monkeypatch.setattr(appraise, "staged", lambda df, name: names.append(name) or staged(df, name))
    rows = spark.createDataFrame([(1, 50000.0, "гр. София", None, None, None, None, "Двустаен апартамент, 60,5 кв.м.")],
                                 "id bigint, price_eur double, city string, address string, property_type string, size_sqm double, neighborhood string, description string")
    market = spark.createDataFrame([], "city string, neighborhood string, property_type string, size_sqm double, price_eur double, url string")
    assert '"listings":1,"deals_found":0' in appraise.report(appraise.analyze_deals(rows, market)).first()[0]
    assert names == ["described", "scored"]
