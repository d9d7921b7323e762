"""Small building blocks shared by the other function modules."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Higher-order functions evaluate their argument a single time per row, so a long
    regex chain is not repeated in every branch that refers to it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(rows: DataFrame, keep: Iterable[str], *values: Column) -> DataFrame:
    """``keep`` and named ``values``, computed once a row however often later columns and filters refer to them.

    A later filter on a plain column is moved below it, with its expression copied into every use.
    """
    return rows.select(*keep, F.inline(F.array(F.struct(*values))))


def strip(c: Column) -> Column:
    """Trim any Unicode white space, no-break space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def group(c: Column, pattern: str, idx: int = 1, flags: str = "U") -> Column:
    """First match of a group, null where the pattern does not match."""
    return blank_to_null(F.regexp_extract(c, f"(?{flags}){pattern}", idx))


def _any(v: Column, words: Iterable[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(v, F.lit(w))
    return test


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True where one of a fixed list of words is contained."""
    return let(c, lambda v: _any(v, words))


def first_listed(c: Column, table: Iterable[tuple[Iterable[str], object]]) -> Column:
    """Value of the first entry with a contained word, in table order."""
    def chain(v: Column) -> Column:
        out = F
        for words, value in table:
            out = out.when(_any(v, words), F.lit(value))
        return out

    return let(c, chain)


def constant(value: object, schema: str) -> Column:
    """A nested constant as one expression, folded to a literal by the optimizer."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def string_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a fixed map, null when the key is absent."""
    return F.try_element_at(constant(table, "map<string,string>"), c)


def round_exact(c: Column, digits: int = 0) -> Column:
    """Round half to even on the exact binary value.

    Scaling first and rounding then is exact except next to a tie; only those rare
    values take the slower route through decimal text.
    """
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    y = c * F.lit(scale)
    near_tie = F.abs(F.abs(y - F.floor(y)) - F.lit(0.5)) < F.lit(1e-4)
    text = F.call_function("format_number", c, F.lit("0." + "0" * digits))
    return F.when(near_tie, text.cast("double")).otherwise(F.rint(y) / F.lit(scale))


def round_half_up(c: Column) -> Column:
    """Round half towards positive infinity, the rule of the older scoring method."""
    return F.floor(c + F.lit(0.5))
