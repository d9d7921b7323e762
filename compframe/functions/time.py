"""Dates. ``now`` is always a parameter, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from compframe.functions.core import as_col


def parse_date(c: Column | str) -> Column:
    """Date from D.M.YYYY or YYYY-M-D text, else null."""
    c = as_col(c)
    return F.coalesce(F.try_to_date(c, "d.M.yyyy"), F.try_to_date(c, "yyyy-M-d"))


def parse_local_date(c: Column | str) -> Column:
    """Date from D.M.YYYY text only."""
    return F.try_to_date(as_col(c), "d.M.yyyy")


def iso_stamp(c: Column | str) -> Column:
    """DD.MM.YYYY [HH:MM] to ISO text; other text unchanged."""
    c = as_col(c)
    full = F.regexp_extract(c, r"(?U)(\d{2})\.(\d{2})\.(\d{4})(?:\s+(\d{2}):(\d{2}))?", 0)
    day = F.concat_ws("-", F.substring(full, 7, 4), F.substring(full, 4, 2), F.substring(full, 1, 2))
    clock = F.right(full, F.lit(5))
    return (F.when(c.isNull() | (full == ""), c)
            .when(F.length(full) > 10, F.concat(day, F.lit("T"), clock, F.lit(":00")))
            .otherwise(day))


def is_expired(c: Column | str, now: Column) -> Column:
    """True once the end date's midnight has passed; unknown dates count as active."""
    return F.coalesce(parse_date(c).cast("timestamp") < now, F.lit(False))


def days_until(c: Column | str, now: Column) -> Column:
    """Whole days to the end date, rounded up."""
    seconds = F.unix_micros(parse_date(c).cast("timestamp")) - F.unix_micros(now)
    return F.ceil(seconds / F.lit(86400000000.0)).cast("int")


def is_new(days: Column) -> Column:
    return F.coalesce(days > 20, F.lit(False))


def is_urgent(days: Column) -> Column:
    return F.coalesce(days.between(0, 5), F.lit(False))


def is_ending(days: Column) -> Column:
    """At most a week left; dates already past are included."""
    return F.coalesce(days <= 7, F.lit(False))


def time_left(c: Column | str, now: Column) -> Column:
    """Remaining time as text, and whether less than three days are left."""
    left = (F.unix_micros(parse_date(c).cast("timestamp")) - F.unix_micros(now)) / F.lit(1000000)
    d = F.floor(left / 86400)
    h = F.floor((left - d * 86400) / 3600)
    m = F.floor((left - d * 86400 - h * 3600) / 60)
    text = (
        F.when(left.isNull(), "Неизвестна").when(left <= 0, "Приключи")
        .when(d > 0, F.concat(d.cast("string"), F.lit("д "), h.cast("string"), F.lit("ч")))
        .when(h > 0, F.concat(h.cast("string"), F.lit("ч "), m.cast("string"), F.lit("м")))
        .otherwise(F.concat(m.cast("string"), F.lit(" мин")))
    )
    urgent = F.coalesce((left > 0) & (d < 3), F.lit(False))
    return F.struct(text.alias("text"), urgent.alias("urgent"))
