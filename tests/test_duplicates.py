"""Duplicate detection against all pairs."""

import random
from difflib import SequenceMatcher

from compframe.operators import duplicates as D

FIELDS = "id bigint, agency string, district string, property_type string, area_sqm double, price_eur double, floor_text string"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def score(a, b):
    if a[1] == b[1]:
        return 0.0
    s = 0.0
    s += 0.30 if ratio(a[2], b[2]) > 0.80 else 0
    s += 0.20 if ratio(a[3], b[3]) > 0.85 else 0
    for i, near, far, p, q in ((4, 0.05, 0.10, 0.25, 0.15), (5, 0.04, 0.08, 0.20, 0.10)):
        if a[i] and b[i]:
            d = abs(a[i] - b[i]) / max(a[i], b[i])
            s += p if d <= near else q if d <= far else 0
    return min(s + (0.05 if ratio(a[6], b[6]) > 0.75 else 0), 1.0)


def listings(n, seed, copies=0):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("abcd"), rnd.choice(["lozenets", "lozenetz", "boyana", "mladost-1", "mladost-2", "", None]),
             rnd.choice(["dvustaen", "dvustaen-x", "tristaen", None]), rnd.choice([None, 0.0, 60.0, 62.0, 65.0, 90.0, 66.5]),
             rnd.choice([None, 100000.0, 104000.0, 107000.0, 150000.0]), rnd.choice([None, "4-ти ет", "5-ти ет", "партер"]))
            for i in range(n)]
    # a crowd of copies with one profile
    return rows + [(n + i, "abcde"[i % 5], "lozenets", "dvustaen", 60.0, 100000.0, None) for i in range(copies)]


def brute(rows):
    return {(a[0], b[0]): score(a, b) for i, a in enumerate(rows) for b in rows[i + 1:] if score(a, b) >= 0.65}


def test_pairs_equal_all_pairs(spark):
    rows = listings(90, 7, copies=40)
    df = spark.createDataFrame(rows, FIELDS)
    got = {(r.listing_id_a, r.listing_id_b): r.confidence
           for r in D.expand_pairs(D.duplicate_profiles(df), df).collect()}
    assert got == brute(rows)


def test_clusters_equal_union_of_pairs(spark):
    for seed in (11, 12):
        rows = listings(60, seed, copies=10)
        parent = {r[0]: r[0] for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in brute(rows):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        got = {r.id: r.cluster for r in D.duplicate_clusters(spark.createDataFrame(rows, FIELDS)).collect()}
        assert got == {r[0]: find(r[0]) for r in rows}


def test_long_chain_is_one_cluster(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u bigint, v bigint")
    assert {r.cluster for r in D.connected(edges).collect()} == {0}


def test_similar_texts_lose_nothing(spark):
    rnd = random.Random(2)
    words = {"".join(rnd.choice("абв-1") for _ in range(rnd.randint(1, 9))) for _ in range(150)}
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = {(r.a, r.b) for r in D.similar_texts(df, 0.8).collect()}
    assert got == {(a, b) for a in words for b in words if ratio(a, b) > 0.8}


def test_the_one_sum_below_the_threshold(spark):
    rows = [(1, "a", "lozenets", "x", 100.0, 100000.0, None), (2, "b", "lozenets", "y", 91.0, 99000.0, None)]
    assert D.duplicate_profiles(spark.createDataFrame(rows, FIELDS)).count() == 0


def test_similar_texts_lose_no_pair(spark):
    """Against the ratio of all ordered pairs, with a piece that nearly all texts share."""
    rnd = random.Random(31)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(2, 26))) for _ in range(40)]
    texts = set(base) | {"", "a", "ab", "aaaa", "aaaaa", "aaaaaa"}
    for t in base:
        for _ in range(3):
            u = list(t)
            for _ in range(rnd.randrange(1, 4)):
                i = rnd.randrange(len(u) + 1)
                u[i:i + rnd.randrange(2)] = rnd.choice(["", "a", "x", "ab"])
            texts.add("".join(u))
    texts = sorted(texts) + [f"rayon {t}" for t in base]
    texts = sorted(set(texts))
    for threshold in (0.8, 0.85):
        got = {(r.a, r.b): r.ratio for r in D.similar_texts(spark.createDataFrame([(t,) for t in texts], "v string"), threshold).collect()}
        assert got == {(a, b): ratio(a, b) for a in texts for b in texts if ratio(a, b) > threshold}


def crowd(n):
    return [(i, "abc"[i % 3], "lozenets", "dvustaen", 60.0 + i % 40 / 100, 100000.0 + i, None) for i in range(n)]


def test_matches_are_neither_stored_nor_repeated(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(D, "staged", lambda df, name, own=D.staged: stored.append(name) or own(df, name))
    got = D.duplicate_profiles(spark.createDataFrame(crowd(60), FIELDS)).select("pid_a", "pid_b").collect()
    assert "profile-pairs" not in stored
    assert len(got) == len(set(got)) == sum(a[1] != b[1] for i, a in enumerate(crowd(60)) for b in crowd(60)[i + 1:])


def test_clusters_need_few_links(spark, monkeypatch):
    links = []
    monkeypatch.setattr(D, "connected", lambda df, own=D.connected: links.append(df.count()) or own(df))
    rows = crowd(400)
    assert {r.cluster for r in D.duplicate_clusters(spark.createDataFrame(rows, FIELDS)).collect()} == {0}
    assert sum(links) < 40 * len(rows)  # 53,000 pairs match


def test_components_meet_over_the_borders_of_cells(spark):
    """Two numbers decide, the types differ: against all pairs."""
    rnd = random.Random(8)
    for seed in range(2):
        rows = [(i, rnd.choice("ab"), "lozenets", f"type {i * 7919}-{i}", 50 * 1.03 ** rnd.randrange(30), 1e5 * 1.05 ** rnd.randrange(30), rnd.choice([None, "партер"]))
                for i in range(70)]
        parent = list(range(70))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in brute(rows):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        got = {r.id: r.cluster for r in D.duplicate_clusters(spark.createDataFrame(rows, FIELDS)).collect()}
        assert got == {i: find(i) for i in range(70)}
