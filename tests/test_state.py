"""Keyed state, bursts, top-k and streams against brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F


from compframe.catalog import standin as S
from compframe.catalog import streams
from compframe.config import AppraisalConfig
from compframe.operators import incremental as I
from compframe.operators import joins as J
from compframe.operators import nearest as N
from compframe.operators import ranking as R
from compframe.operators.bursts import burst_filter
from compframe.operators.ranking import keep_latest
from compframe.plans import alerts as A
from compframe.streaming import flows as X

T0 = dt.datetime(2024, 1, 1)


def test_merge_is_idempotent(spark, small):
    known, cur = S.known(spark, small), S.current_ids(spark, small)
    # a fetched page reports itself expired once its end date has passed
    det = I.expire_by_date(S.details(spark, small).withColumn("last_updated_at", S.now()), S.now()).drop("last_updated_at")
    once = I.incremental_merge(known, cur, det, S.now())
    twice = I.incremental_merge(once, cur, det, S.now())
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_relisted_id_keeps_first_seen(spark):
    schema = "id bigint, auction_end string, is_expired boolean, scraped_at timestamp, first_seen_at timestamp, last_updated_at timestamp"
    known = spark.createDataFrame([(1, None, True, T0, T0, T0), (2, None, False, T0, T0, T0), (3, None, True, T0, T0, T0)], schema)
    det = spark.createDataFrame([(1, "01.01.2030", False), (3, None, True), (4, None, True)], "id bigint, auction_end string, is_expired boolean")
    out = {r.id: r for r in I.incremental_merge(known, spark.createDataFrame([(1,), (3,), (4,)], "id bigint"), det, S.now()).collect()}
    assert set(out) == {1, 2, 3}
    assert not out[1].is_expired and out[1].first_seen_at == T0 and out[1].last_updated_at > T0
    assert out[2].is_expired and out[3].is_expired and out[3].last_updated_at == T0


def test_keep_latest_keeps_rows_without_price(spark):
    rows = [("A", "x", 50.0, None, None, None, "s", T0)] * 2 + [("A", h, 50.0, 9.0, 1.0, None, "s", T0 + dt.timedelta(days=d)) for h, d in (("o", 0), ("n", 1))]
    df = spark.createDataFrame(rows, "city string, neighborhood string, size_sqm double, price_eur double, price_per_sqm double, rooms int, source string, scraped_at timestamp")
    assert sorted(r.neighborhood for r in keep_latest(df).collect()) == ["n", "x", "x"]


def brute_burst(events, limit, window):
    out, seen = set(), {}
    for key, ts, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        recent = [t for t in seen.get(key, []) if (ts - t).total_seconds() < window]
        if len(recent) < limit:
            recent.append(ts)
            out.add(i)
        seen[key] = recent
    return out


def test_burst_golden(spark):
    rows = [("k", T0 + dt.timedelta(seconds=s), s) for s in (0, 10, 20, 30, 40, 50, 60)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id bigint")
    assert {r.id for r in burst_filter(df).collect()} == {0, 10, 20, 30, 40, 60}


def test_burst_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 5}", T0 + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 900), 300])), i) for i in range(700)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id bigint")
    assert {r.id for r in burst_filter(df, 5, 60).collect()} == brute_burst(rows, 5, 60)


def test_streams_equal_batch(spark, small):
    want = {tuple(r) for r in streams.burst_admitted(spark, small).collect()}
    assert {tuple(r) for r in streams.stream_burst(spark, small).collect()} == want


def test_upsert_stream_over_several_batches(spark, tmp_path):
    schema = "id bigint, ts timestamp, v string"
    for i in range(3):
        rows = [(k, T0 + dt.timedelta(days=i, hours=k), f"{k}-{i}") for k in range(i, 5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = str(tmp_path / "out")
    X.run_to_end(X.upsert_stream(src), str(tmp_path / "state"), each=X.to_changes(changes), mode="update")
    # a micro-batch gives out the keys it names, not the table
    assert [(r.batch, r["count"]) for r in spark.read.parquet(changes).groupBy("batch").count().orderBy("batch").collect()] == [(0, 5), (1, 4), (2, 3)]
    out = {r.id: r for r in X.current(spark, changes).collect()}
    assert len(out) == 5
    assert out[4].first_seen == T0 + dt.timedelta(hours=4) and out[4].last_seen == T0 + dt.timedelta(days=2, hours=4)
    assert {k: r.v for k, r in out.items()} == {0: "0-0", 1: "1-1", 2: "2-2", 3: "3-2", 4: "4-2"}
    # restarted: a late row moves first_seen only, equal times are settled by the fields
    late = [(0, T0 - dt.timedelta(days=9), "late"), (4, T0 + dt.timedelta(days=2, hours=4), "4-1"), (9, T0, "new")]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    X.run_to_end(X.upsert_stream(src), str(tmp_path / "state"), each=X.to_changes(changes), mode="update")
    out = {r.id: r for r in X.current(spark, changes).collect()}
    assert (out[0].v, out[0].first_seen, out[4].v, out[9].v, len(out)) == ("0-0", T0 - dt.timedelta(days=9), "4-1", "new", 6)


def test_snapshot_stream_equals_batch_merges(spark, tmp_path):
    """Four snapshots, with a restart: the same table as merging them one after the other."""
    schema = "id bigint, run timestamp, price double, is_expired boolean"
    day = [T0 + dt.timedelta(days=i) for i in range(5)]
    lists = [{1: 10.0, 2: 20.0, 3: 30.0, 9: None}, {1: 11.0, 2: 21.0, 4: 40.0}, {1: 12.0, 3: 33.0, 5: -1.0}, {1: 13.0, 4: 44.0, 9: 90.0}]
    known = spark.createDataFrame([], "id bigint, price double, auction_end string, is_expired boolean, scraped_at timestamp, first_seen_at timestamp, last_updated_at timestamp")
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = str(tmp_path / "out")
    for i, ids in enumerate(lists):
        rows = [(k, day[i], p, None if p is None else p < 0) for k, p in ids.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        details = spark.createDataFrame([(k, p, None, p < 0) for k, p in ids.items() if p is not None], "id bigint, price double, auction_end string, is_expired boolean")
        now = F.lit(day[i]).cast("timestamp")
        known = spark.createDataFrame(I.incremental_merge(known, spark.createDataFrame([(k,) for k in ids], "id bigint"), details, now).collect(), known.schema)
        if i in (1, 3):  # two snapshots a run, then again from the checkpoint
            X.run_to_end(X.snapshot_stream(src, ["price"]), str(tmp_path / "state"), each=X.to_changes(changes), mode="update")
    got = {r.id: (r.price, r.is_expired, r.first_seen_at, r.last_updated_at) for r in X.current(spark, changes).collect()}
    assert got == {r.id: (r.price, r.is_expired, r.first_seen_at, r.last_updated_at) for r in known.collect()}


def test_snapshot_stream_keeps_ids_in_buckets(spark, tmp_path):
    """State and calls are one a bucket, not one an id; large numbers, nulls and ids listed twice come through."""
    schema = "id bigint, run timestamp, n bigint, label string, at timestamp, is_expired boolean"
    day = [T0 + dt.timedelta(days=i) for i in range(3)]
    big, state, changes = (1 << 53) + 1, str(tmp_path / "state"), str(tmp_path / "out")
    lists = [[(i, day[0], big + i if i % 2 else None, f"a{i}", day[1], False) for i in range(300)] + [(None, day[0], 1, None, None, False)],
             [(i, day[1], big, "later", None, False) for i in range(100, 310)] + [(305, day[1], 0, "again", None, False)],
             [(i, day[2], big + 1, "back", None, False if i else None) for i in range(100)]]
    (tmp_path / "in").mkdir()
    for rows in lists:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        X.run_to_end(X.snapshot_stream(src, ["n", "label", "at"], buckets=4), state, each=X.to_changes(changes), mode="update")
    assert spark.read.format("statestore").load(state).count() <= 4
    got = {r.id: (r.n, r.label, r.at, r.is_expired, r.first_seen_at, r.last_updated_at) for r in X.current(spark, changes).collect()}
    want = {None: (1, None, None, True, day[0], day[1]), 0: (None, "a0", day[1], True, day[0], day[1])}
    want |= {i: (big + 1, "back", None, False, day[0], day[2]) for i in range(1, 100)}
    want |= {i: (big + i if i % 2 else None, f"a{i}", day[1], True, day[0], day[2]) for i in range(100, 300)}
    want |= {i: (big, "later", None, True, day[1], day[2]) for i in range(300, 310)}
    assert {k: v for k, v in got.items() if k != 305} == {k: v for k, v in want.items() if k != 305}
    assert got[305][1] in ("later", "again") and got[305][3:] == (True, day[1], day[2])


def test_retention_drops_days_and_rewrites_nothing(spark, tmp_path):
    store = X.DatedStore(spark, str(tmp_path / "rows"), "ts", 7)
    T = dt.datetime(2024, 3, 1, 12)
    batches = [[(i, T + dt.timedelta(days=i)) for i in range(5)], [(10, T + dt.timedelta(days=9)), (11, T + dt.timedelta(days=1)), (12, None)],
               [(20, T + dt.timedelta(days=2, hours=-1)), (21, T + dt.timedelta(days=2))]]
    files = set()
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "id bigint, ts timestamp")
        store.append(batch, n)
        now = {str(p.relative_to(tmp_path)) for p in (tmp_path / "rows").rglob("*.parquet")}
        if n == 1:
            assert all(f in files or "batch=1" in f for f in now) and not any("day=2024-03-01" in f for f in now)
        files = now
    store.append(spark.createDataFrame(batches[2], "id bigint, ts timestamp"), 2)  # the last batch again
    assert sorted(r.id for r in store.read().collect()) == [2, 3, 4, 10, 21]


def test_syncs_lose_and_repeat_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def add(lo, hi):
        spark.range(lo, hi).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def broken(batch, number):
        X.to_changes(out)(batch, number)
        if number == 1:
            raise InterruptedError

    add(0, 10)
    X.sync(src, str(tmp_path / "state"), X.to_changes(out))
    add(10, 30)
    add(30, 35)
    with pytest.raises(StreamingQueryException):
        X.sync(src, str(tmp_path / "state"), broken)
    add(35, 40)
    X.sync(src, str(tmp_path / "state"), X.to_changes(out))
    X.sync(src, str(tmp_path / "state"), X.to_changes(out))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_topk_equals_brute_force(spark):
    rnd = random.Random(9)
    hoods, types, sizes = ["кв. Изток", "Изток", "Бояна", None], ["1-стаен", "2-стаен", None], [None, 40.0, 45.0, 50.0, 52.0, 70.0]
    subj = [(i, rnd.choice(["София", "СОФИЯ", "Русе"]), rnd.choice(hoods), rnd.choice(types), rnd.choice(sizes), 50000.0) for i in range(40)]
    market = [(rnd.choice(["София", "София", "Русе"]), rnd.choice(hoods), rnd.choice(types), rnd.choice(sizes), float(rnd.randint(20, 90)) * 1000, f"u{j}") for j in range(400)]
    assert_topk(spark, subj, market)


@pytest.mark.parametrize("types", [["1-стаен"], ["1-стаен", None]])
def test_topk_in_one_hot_town_of_real_sizes(spark, types):
    """Every size its own, nearly all rows in one town and district, ranges that cut it anywhere."""
    rnd = random.Random(19)
    hoods = ["Изток"] * 12 + ["Бояна", "Люлин", "Банишора", None]
    subj = [(i, "София", rnd.choice(hoods), rnd.choice(types), rnd.uniform(20, 120), 50000.0) for i in range(150)]
    market = [(rnd.choice(["София"] * 30 + ["Русе"]), rnd.choice(hoods), rnd.choice(types), rnd.choice([rnd.uniform(20, 120), 60.0, None]),
               float(rnd.randint(20, 90)) * 1000, f"u{j}") for j in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert_topk(spark, subj, market)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def assert_topk(spark, subj, market):
    s = spark.createDataFrame(subj, "id int, city string, neighborhood string, property_type string, size_sqm double, price_eur double")
    m = spark.createDataFrame(market, "city string, neighborhood string, property_type string, size_sqm double, price_eur double, url string")
    cfg = AppraisalConfig(size_tolerance_pct=20.0, max_results=7)
    best = N.top_comparables(s, m, cfg)
    got = {}
    for r in N._keyed(s).select("id", *N.PROBE).join(best, N.PROBE).select("id", "rank", "url").collect():
        got.setdefault(r.id, {})[r.rank] = r.url

    def plain(h):
        return None if h is None else h.replace("кв. ", "").lower()

    for i, city, hood, kind, size, _ in subj:
        near = [x for x in market if x[0].lower() == city.lower() and (not kind or not x[2] or kind == x[2])
                and (not size or not x[3] or abs(x[3] - size) / size <= 0.2)]
        near.sort(key=lambda x: (plain(x[1]) != plain(hood), abs(x[3] - size) if size and x[3] else 1e9 if size else 0,
                                 x[4], x[3] or 0, x[1] or "", x[2] or "", x[5]))
        assert got.get(i, {}) == {n + 1: x[5] for n, x in enumerate(near[:7])}


def test_alert_ids_are_overwritten(spark):
    deals = spark.createDataFrame([(str(i), "София", 50.0 - i, 100, 100.0, None) for i in range(3)],
                                  "id string, city string, discount double, price bigint, price_eur double, partial_ownership string")
    subs = spark.createDataFrame([(1, "[]", 20, True, '["0","1"]')],
                                 "id bigint, cities_json string, min_discount int, verified boolean, last_deal_ids_json string")
    sent = A.match_alerts(deals, subs)
    assert [r.deal_id for r in sent.collect()] == ["2"]
    after = A.mark_sent(subs, sent).first()
    assert after.last_deal_ids_json == '["2"]'
    kept = A.mark_sent(subs, sent, "history").first()
    assert kept.last_deal_ids_json == '["0","1","2"]'


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_retain"])
def test_stream_queries_run(spark, small, name):
    assert getattr(streams, name)(spark, small).count() > 0


def test_unknown_order_is_refused():
    from compframe.operators.comparables import similar_hoods
    with pytest.raises(ValueError):
        similar_hoods(None, None, 0.4)




def test_numbers_in_groups_of_any_size(spark):
    rnd = random.Random(21)
    rows = [(i, rnd.choice(["hot"] * 8 + ["a", None]), rnd.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, k string, x double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.nth for r in R.numbered(df, ["k"], [F.col("x").desc(), F.col("id").asc()], "nth").collect()}
        flat = {r.id: r.nth for r in R.numbered(df, [], [F.col("x").asc()], "nth").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in ("hot", "a", None):
        assert [got[i] for i, g, x in sorted(rows, key=lambda r: (-r[2], r[0])) if g == k] == list(range(1, sum(r[1] == k for r in rows) + 1))
    assert [flat[i] for i, _, x in sorted(rows, key=lambda r: r[2])] == list(range(1, 901))


def test_deep_pages_are_those_of_the_whole_order(spark, monkeypatch):
    df = spark.range(1000).withColumn("x", F.xxhash64("id"))
    order = [F.col("x").desc()]
    want = [r.id for r in df.orderBy(*order).collect()]
    monkeypatch.setattr(R, "SHALLOW", 0)
    assert [r.id for r in R.page(df, order, 7, 12).collect()] == want[72:84]
    assert [r.id for r in R.page(df, order, 84, 12).collect()] == want[996:] and R.page(df, order, 85, 12).count() == 0


def test_alerts_with_long_histories(spark):
    rnd = random.Random(23)
    towns = ["София", "Русе", "Варна"]
    deals = [(str(i), rnd.choice(towns), round(rnd.uniform(-5, 60), 1), rnd.randint(1, 9) * 1000) for i in range(400)]
    subs = []
    for i in range(60):
        want = rnd.choice([[], ["София"], ["Русе", "Варна", "Русе"], ["Атлантида"]])
        sent = rnd.sample(range(400), rnd.choice([0, 3, 40, 300])) + [99999]
        subs.append((i, json.dumps(want, ensure_ascii=False), rnd.choice([0, 10, 30, None]), i % 7 != 0, json.dumps([str(x) for x in sent])))
    d = spark.createDataFrame(deals, "id string, city string, discount double, price bigint").withColumns(
        {"price_eur": F.col("price").cast("double"), "partial_ownership": F.lit(None).cast("string")})
    s = spark.createDataFrame(subs, "id bigint, cities_json string, min_discount int, verified boolean, last_deal_ids_json string")
    got = {}
    for r in A.match_alerts(d, s).collect():
        got.setdefault(r.subscriber_id, {})[r.rank] = r.deal_id
    order = sorted((x for x in deals if x[2] > 0), key=lambda x: (-x[2], x[3], int(x[0])))
    want = {}
    for i, cities, least, ok, sent in subs:
        mine = [x[0] for x in order if ok and (not json.loads(cities) or x[1] in json.loads(cities)) and x[2] >= (least or 20) and x[0] not in json.loads(sent)]
        if mine:
            want[i] = dict(enumerate(mine[:10], 1))
    assert got == want


@pytest.mark.parametrize("pairs", [0, 10**9])
def test_rules_equal_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(J, "PAIRS", pairs)
    rnd = random.Random(25)
    words = ["изток", "Люлин", "люлин 7", "море", "о", "няма такава"]
    deals = [(rnd.choice(["София", "Русе", None]), rnd.choice([None, 5000.0, 5000.01, 77000.5, 600000.0, 9e6]), rnd.choice([None, "", "кв. Изток", "Люлин 7 море", "Морето"]))
             for _ in range(300)]
    rules = [(i, rnd.choice([None, "София", "Русе", "Лом"]), rnd.choice([None, 5000.0, 70000.0]), rnd.choice([None, 5000.0, 600000.0, 1.0]),
              rnd.choice([None, [], rnd.sample(words, rnd.randint(1, 3))]), i % 9 != 0) for i in range(120)]
    d = spark.createDataFrame(deals, "city string, price double, text string").repartition(5)
    r = spark.createDataFrame(rules, "user_id bigint, city string, min_price double, max_price double, keywords array<string>, active boolean")
    got = {x.user_id: (x.deals, x.cheapest) for x in J.rule_summary(r, d).collect()}
    want = {}
    for user, city, lo, hi, words, active in rules:
        hits = [p for c, p, t in deals if active and p is not None and city in (None, c) and (lo is None or p >= lo) and (hi is None or p <= hi)
                and all(w.lower() in (t or "").lower() for w in words or [])]
        if hits:
            want[user] = (len(hits), min(hits))
    assert got == want
