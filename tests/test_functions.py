"""Golden rows for the column functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from compframe.functions import price as P
from compframe.functions import text as T
from compframe.functions import time as D
from compframe.functions.core import round_exact, round_half_up


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_extract_hood(spark):
    cases = {
        'гр. София, ж.к. "Люлин 9", бл. 123': "люлин",
        "София, кв. Лозенец, ул. Черни връх 15": "лозенец",
        "гр. Варна, район Приморски, ул. Морска": "приморски",
        "ж.к. Младост 1, бл. 45, вх. А": "младост",
        "гр. Пловдив, жк Тракия, бл. 200": "тракия",
        "гр. Варна, ул. Роза 5": "цветен квартал",
        "гр. Русе, ул. Роза 5": None,
        "Продава 2-СТАЕН в град София, Кръстова вада - 79 кв.м": "кръстова вада",
        "80 кв.м": None,
        "": None,
    }
    got = values(spark, [(k,) for k in cases], "a string", "a", T.extract_hood("a"))
    assert dict(got) == cases


def test_quarter_prefix_in_both_modes(spark):
    got = values(spark, [("квартал Изгрев",)], "a string", T.normalize_hood("a"), T.normalize_hood("a", False),
                 T.extract_hood("a"), T.extract_hood("a", False))
    assert got == [("артал изгрев", "изгрев", "артал изгрев", "изгрев")]


def test_alias_order(spark):
    got = values(spark, [("Слатина",), ("Красна поляна",), ("  ",), (None,)], "a string", T.normalize_hood("a"))
    assert got == [("подуяне",), ("красно село",), (None,), (None,)]


def test_similarity(spark):
    rows = [("Люлин 9", "Люлин 7", 1.0), ("ж.к. Младост", "Младост 1", 1.0), ("Лозенец", "Център", 0.75),
            ("кв. Тракия", "жк Тракия", 1.0), ("Левски", "Базар Левски", 0.8), ("абвгд", "абвж", 0.5 * 3 / 4),
            ("абвгд", "еж", 0.0), (None, "x", 0.0)]
    got = values(spark, rows, "a string, b string, want double", T.hood_similarity("a", "b"), "want")
    for have, want in got:
        assert have == pytest.approx(want)


def test_rounding_is_exact(spark):
    rnd = random.Random(1)
    xs = [rnd.uniform(-10, 5000) for _ in range(4000)] + [k / 200 for k in range(2000)] + [2.675, 12.35, 0.5, 1.5, 2.5]
    for digits in (0, 1, 2):
        got = values(spark, [(x,) for x in xs], "x double", "x", round_exact(F.col("x"), digits))
        assert all(y == round(x, digits) for x, y in got)


def test_round_half_up(spark):
    assert values(spark, [(2.5,), (-2.5,), (0.49,)], "x double", round_half_up(F.col("x"))) == [(3,), (-2,), (0,)]


def test_dates(spark):
    got = values(spark, [("1.2.2026",), ("2026-02-01",), ("31.02.2026",), (None,)], "d string", D.parse_date("d"))
    assert got == [(dt.date(2026, 2, 1),), (dt.date(2026, 2, 1),), (None,), (None,)]
    now = F.lit("2026-02-01 00:00:01").cast("timestamp")
    got = values(spark, [("01.02.2026",), ("02.02.2026",), ("?",)], "d string", D.is_expired("d", now))
    assert got == [(True,), (False,), (False,)]
    got = values(spark, [("09.02.2026",), ("10.03.2026 09:00",), ("x",), (None,)], "d string", D.iso_stamp("d"))
    assert got == [("2026-02-09",), ("2026-03-10T09:00:00",), ("x",), (None,)]


def test_days_and_time_left(spark):
    now = F.lit("2026-02-01 12:00:00").cast("timestamp")
    got = values(spark, [("04.02.2026",), ("02.02.2026",), ("01.01.2026",), (None,)], "d string",
                 D.days_until("d", now), D.time_left("d", now)["text"], D.time_left("d", now)["urgent"])
    assert got == [(3, "2д 12ч", True), (1, "12ч 0м", True), (-31, "Приключи", False), (None, "Неизвестна", False)]


def test_numbers(spark):
    got = values(spark, [("5 100.00",), ("707 703.15",), ("43 439.36",), ("1 234,5",), ("",)], "t string", T.leading_number("t"))
    assert got == [(5100.0,), (707703.15,), (43439.36,), (1234.5,), (None,)]
    got = values(spark, [("1 234,5 лв",), ("x",), ("1.2.3",)], "t string", T.clean_number("t"))
    assert got == [(1234.5,), (None,), (None,)]


def test_valuation_and_scores(spark):
    med, price, size = F.lit(1500.0), F.lit(60000.0), F.lit(60.0)
    d = P.discount_pct(price, size, med)
    assert values(spark, [(1,)], "x int", d, P.score5(d, F.lit(False))) == [(33.3, 4)]
    got = values(spark, [(0.0,), (None,), (9.9,), (10.0,), (40.0,)], "d double", P.score5(F.col("d"), F.lit(False)))
    assert [g[0] for g in got] == [0, 0, 1, 2, 5]
    assert values(spark, [(1,)], "x int", P.discount_pct(F.lit(99000.0), size, med)) == [(None,)]
    got = values(spark, [(35.0, 3), (35.1, 3), (-5.0, 3), (50.0, 2)], "d double, n int", P.deal_score(F.col("d"), F.col("n")))
    assert [g[0] for g in got] == [4, 5, 0, None]


def test_type_words(spark):
    got = values(spark, [("Апартамент",), ("Двустаен апартамент",), (None,)], "t string", P.type_category("t"),
                 F.coalesce(P.is_comparable_type("t"), F.lit(False)), P.room_band("t")["lo"])
    assert got == [("other", True, None), ("apartment", True, 40.0), ("other", False, None)]


def test_subscriber_cleaning(spark):
    got = values(spark, [("  A@B.bg ", '["София","Рим"]', "99"), ("bad", "", "x"), ("a@b.co", None, "5")],
                 "e string, c string, m string", T.clean_email("e"), T.known_cities(T.json_list("c")), T.clamp_discount("m"))
    assert got == [("a@b.bg", ["София"], 70), (None, [], 20), ("a@b.co", [], 10)]


def test_title_and_city(spark):
    got = values(spark, [("здравец-север",), ("гоце  делчев",)], "t string", T.title_hood("t"))
    assert got == [("Здравец-Север",), ("Гоце Делчев",)]
    got = values(spark, [("гр. София",), ("с. Баня",), ("sofiya",)], "t string", T.clean_city("t"), T.normal_city("t"))
    assert got == [("София", "София"), ("Баня", "с. Баня"), ("sofiya", "София")]
