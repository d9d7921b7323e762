"""Pieces of stored pages: anchors, text nodes, cards, elements. Whole pages, no cuts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from compframe.functions import text as T
from compframe.functions.core import let, strip

ANCHOR = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def no_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")


def all_matches(c: Column, pattern: str, idx: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(idx))


def anchors(html: Column) -> Column:
    """Array of (href, label) in page order."""
    return F.transform(
        F.arrays_zip(all_matches(html, ANCHOR, 1).alias("href"), all_matches(html, ANCHOR, 2).alias("label")),
        lambda a: F.struct(a["href"].alias("href"), T.inner_text(a["label"]).alias("label")))


def text_nodes(html: Column) -> Column:
    """Non-blank text pieces between tags, in page order."""
    pieces = F.transform(F.split(no_scripts(html), r"<[^>]+>"), lambda t: strip(T.unescape(t)))
    return F.filter(pieces, lambda t: t != "")


def flat_text(html: Column) -> Column:
    """Text with tags removed and nothing put in their place."""
    return T.unescape(F.regexp_replace(no_scripts(html), r"<[^>]+>", ""))


def _element(source: Column) -> Column:
    """The element that ``source`` begins with, by the depth of its own tag: (text, closed).

    The source is cut before every opening and closing tag of that name; a running sum over them finds the closing
    tag that brings the depth back to nothing.
    """
    tag = F.regexp_extract(source, r"^<([a-zA-Z]+)", 1)
    pieces = F.split(source, F.concat(F.lit("(?is)(?=</?"), tag, F.lit(r"\b)")))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(F.startswith(piece, F.lit("</")), -1).otherwise(1)
        at = acc["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] == 0) & (depth == 0), at).otherwise(acc["end"]).alias("end"))

    def cut(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
        return let(F.aggregate(p, start, step)["end"], lambda end: F.struct(
            F.when(end > 0, F.concat(F.array_join(F.slice(p, 1, F.greatest(end - 1, F.lit(0))), ""),
                                     F.regexp_extract(F.get(p, end - 1), r"^</[^>]*>?", 0))).alias("text"),
            (end > 0).alias("closed")))

    return let(pieces, cut)


def _balanced(html: Column, card: Column) -> Column:
    """Whether the page closes the card's tag as often as it opens it."""
    tag = F.regexp_extract(card, r"^<([a-zA-Z]+)", 1)
    return F.size(F.split(html, F.concat(F.lit("(?is)</"), tag, F.lit(r"\b")))) >= F.size(F.split(html, F.concat(F.lit("(?is)<"), tag, F.lit(r"\b"))))


def segments(html: Column, opening: str, whole_page: bool) -> Column:
    """Elements whose opening tag matches ``opening``, in page order, each with all that is inside it and nothing else.

    A card inside another one is an element of its own and part of the outer one. Where a page does not close its cards,
    a card ends at the next opening. Without any such tag the result is the whole page or nothing.
    """
    def cards(parts: Column) -> Column:
        def card(part: Column, i: Column) -> Column:
            def whole(own: Column) -> Column:
                # not closed before the next card: the element holds other cards
                outer = _element(F.array_join(F.slice(parts, i + 1, F.size(parts)), ""))["text"]
                return F.when(own["closed"], own["text"]).when(_balanced(html, part), F.coalesce(outer, part)).otherwise(part)

            return F.when(part.rlike(f"(?is)^(?:{opening})"), let(_element(part), whole))

        return F.array_compact(F.transform(parts, card))

    found = let(F.split(html, f"(?is)(?={opening})"), cards)
    return let(found, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(html))) if whole_page else found


def element_text(html: Column, pattern: str) -> Column:
    """Array of the texts of elements whose whole source matches ``pattern`` (group 1 is the content)."""
    return F.transform(all_matches(html, pattern, 1), T.inner_text)


def in_order_distinct(items: Column) -> Column:
    """Array without repeats, first occurrence kept."""
    return F.array_distinct(items)
