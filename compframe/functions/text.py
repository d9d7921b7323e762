"""Text functions: towns, districts, numbers, markup, identities."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from compframe import lookups as L
from compframe.functions.core import (
    as_col, blank_to_null, constant, group, let, lookup, strip,
)


def alias_table() -> Column:
    return constant([{"name": k, "names": v} for k, v in L.HOOD_ALIASES.items()],
                    "array<struct<name:string,names:array<string>>>")


def cluster_table() -> Column:
    return constant(list(L.HOOD_CLUSTERS.values()), "array<array<string>>")


def clean_city(c: Column | str) -> Column:
    """Town name without its settlement marker, wherever the marker stands."""
    out = as_col(c)
    for marker in ("гр. ", "с. "):
        out = F.replace(out, F.lit(marker), F.lit(""))
    return strip(out)


def normal_city(c: Column | str) -> Column:
    """Town name by a map of spellings; an unknown town is returned as it came."""
    c = as_col(c)
    bare = strip(F.regexp_replace(F.lower(c), r"(?U)^(гр\.|с\.|село|град)\s*", ""))
    return F.when(c != "", F.coalesce(lookup(bare, L.CITY_SPELLINGS), c))


def strip_hood(c: Column | str, compat: bool = True) -> Column:
    """District name in lower case without prefix, block, entrance and quotes."""
    patterns = list(L.HOOD_STRIP_PATTERNS)
    if not compat:
        patterns[0] = L.HOOD_STRIP_PREFIX_FIXED
    out = strip(F.lower(as_col(c)))
    for p in patterns:
        out = F.regexp_replace(out, f"(?U){p}", "")
    return strip(F.translate(out, "\"'", ""))


def hood_alias(c: Column) -> Column:
    """Canonical district of the first alias entry that equals or begins the text."""
    hit = F.filter(alias_table(),
                   lambda e: F.array_contains(e["names"], c) | F.startswith(c, e["name"]))
    return F.get(hit, F.lit(0))["name"]


def normalize_hood(c: Column | str, compat: bool = True) -> Column:
    """Comparable district name; null for blank input.

    ``compat`` keeps the published rule in which "квартал X" loses only its first two
    letters; with ``compat=False`` the whole word is removed.
    """
    return let(strip_hood(c, compat), lambda t: F.coalesce(hood_alias(t), blank_to_null(t)))


def simple_hood(c: Column | str) -> Column:
    """District name without prefix, lower case, no aliases."""
    bare = F.regexp_replace(as_col(c), r"(?iU)^(кв\.|жк\.|ж\.к\.|квартал|жилищен комплекс)\s*", "")
    return F.when(as_col(c) != "", F.lower(strip(bare)))


def title_hood(c: Column | str) -> Column:
    """Capitalise every word and hyphen part; single blanks between words."""
    parts = F.transform(
        F.split(strip(as_col(c)), "-"),
        lambda p: F.array_join(F.transform(
            F.filter(F.split(p, r"(?U)\s+"), lambda w: w != ""),
            lambda w: F.concat(F.upper(F.left(w, F.lit(1))),
                               F.lower(F.substr(w, F.lit(2))))), " "))
    return F.array_join(parts, "-")


def url_segment_hood(c: Column | str) -> Column:
    """District named by the URL segment after the town, null when there is none."""
    c = as_col(c)
    rest = F.regexp_extract(c, f"(?s){L.SLUG_CITY_PATTERN}(.*)", 2)
    slug = F.replace(F.regexp_extract(rest, f"(?U){L.SLUG_HOOD_PATTERN}", 1), F.lit("-"), F.lit(" "))
    return let(slug, lambda s: F.coalesce(
        lookup(s, L.SLUG_HOODS),
        F.when((F.length(s) > 3) & ~s.isin(*L.SLUG_CITIES), normalize_hood(s))))


def street_hood(c: Column | str) -> Column:
    """District of the first listed street that the text names together with its town."""
    table = constant([{"street": s, "hood": h, "town": t} for s, h, t in L.STREET_HOODS],
                     "array<struct<street:string,hood:string,town:string>>")
    hit = let(F.lower(as_col(c)), lambda a: F.get(F.filter(
        table, lambda e: F.contains(a, e["street"]) & F.contains(a, e["town"])), F.lit(0))["hood"])
    return normalize_hood(hit)


def extract_hood(c: Column | str, compat: bool = True) -> Column:
    """District in a free-text address, by marker, title form, URL slug, then street."""
    c = as_col(c)
    patterns = L.ADDRESS_HOOD_PATTERNS if compat else L.ADDRESS_HOOD_PATTERNS_FIXED
    marked = let(F.lower(c), lambda a: F.array(
        *[F.regexp_extract(a, f"(?U){p}", 1) for p in patterns]))
    titled = F.regexp_extract(c, f"(?U){L.TITLE_HOOD_PATTERN}", 1)
    named = F.transform(F.concat(marked, F.array(titled)), lambda x: normalize_hood(x, compat))
    first = F.get(F.filter(named, lambda x: F.length(x) > 2), F.lit(0))
    return F.coalesce(first, url_segment_hood(c), street_hood(c))


def hood_similarity(a: Column | str, b: Column | str) -> Column:
    """Likeness of two district names, 0.0 to 1.0."""
    pair = F.struct(normalize_hood(a).alias("l"), normalize_hood(b).alias("r"))
    return let(pair, lambda p: normalized_similarity(p["l"], p["r"]))


def normalized_similarity(l: Column, r: Column) -> Column:
    """The same for names that are already normalised."""
    def entry_has(e: Column, x: Column) -> Column:
        return (e["name"] == x) | F.array_contains(e["names"], x)

    shared_alias = F.exists(alias_table(), lambda e: entry_has(e, l) & entry_has(e, r))
    shared_cluster = F.exists(cluster_table(),
                              lambda m: F.array_contains(m, l) & F.array_contains(m, r))
    shorter = F.least(F.length(l), F.length(r))
    prefix = F.size(F.filter(F.sequence(F.lit(1), shorter),
                             lambda i: F.left(l, i) == F.left(r, i)))
    return (
        F.when(l.isNull() | r.isNull(), F.lit(0.0))
        .when(l == r, F.lit(1.0))
        .when(F.contains(l, r) | F.contains(r, l), F.lit(0.8))
        .when(shared_alias, F.lit(0.9))
        .when(shared_cluster, F.lit(0.75))
        .when((shorter >= 3) & (prefix >= 3), F.lit(0.5) * (prefix / shorter))
        .otherwise(F.lit(0.0))
    )


def clean_number(c: Column | str) -> Column:
    """Number from text: blanks dropped, comma as point, other characters ignored."""
    text = F.regexp_replace(F.translate(as_col(c), ",", "."), r"[^\d.]", "")
    return text.try_cast("double")


def leading_number(c: Column | str) -> Column:
    """First number of a text once blanks are gone; only the first comma is a point."""
    text = F.regexp_replace(as_col(c), r"(?U)\s", "")
    text = F.regexp_replace(text, r"^([^,]*),", "$1.")
    run = F.regexp_extract(text, r"([\d.]+)", 1)
    return F.regexp_extract(run, r"^(\d*\.?\d*)", 1).try_cast("double")


def thousands_number(c: Column | str) -> Column:
    """Number with commas as thousands marks."""
    return F.replace(as_col(c), F.lit(","), F.lit("")).try_cast("double")


# Named character references, from the table of Python's html module; frequent ones first, since a constant map is searched in order.
_COMMON = ["nbsp", "amp", "quot", "lt", "gt", "euro", "sup2", "ndash", "mdash", "bdquo", "ldquo", "rdquo", "laquo", "raquo", "deg", "hellip", "bull"]
ENTITIES = {name: html5[f"{name};"] for name in [*_COMMON, *sorted(n[:-1] for n in html5 if n.endswith(";") and n[:-1] not in _COMMON)]}


def unescape(c: Column | str) -> Column:
    """Character references decoded once, numeric and named ones in the same pass. Unknown ones stay; text without any is left alone."""
    table = constant(ENTITIES, "map<string,string>")

    def one(part: Column) -> Column:
        digits, hexed = F.regexp_extract(part, r"^#(\d{1,7});", 1), F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.coalesce(digits.try_cast("bigint"), F.conv(blank_to_null(hexed), 16, 10).try_cast("bigint"))
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        numeric = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        named = F.try_element_at(table, F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1))
        char = F.when(F.startswith(part, F.lit("#")), numeric).otherwise(named)
        return let(char, lambda x: F.coalesce(F.concat(x, F.regexp_replace(part, r"^[^;]*;", "")), F.concat(F.lit("&"), part)))

    def decoded(t: Column) -> Column:
        return let(F.split(t, "&"), lambda parts: F.concat(
            F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), "")))

    return let(as_col(c), lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def inner_text(c: Column | str) -> Column:
    """Text of a small fragment: tags removed without a blank, entities decoded."""
    return strip(unescape(F.regexp_replace(as_col(c), r"<[^>]+>", "")))


def visible_text(c: Column | str) -> Column:
    """Text a reader of the page sees."""
    out = F.regexp_replace(as_col(c), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return strip(F.regexp_replace(unescape(out), r"(?U)\s+", " "))


def signature(district: Column, kind: Column, area: Column, price: Column) -> Column:
    """Identity of a listing: district, type, whole area, whole price."""
    def word(c: Column) -> Column:
        return F.coalesce(blank_to_null(strip(c)), F.lit("na"))

    def whole(c: Column) -> Column:
        return F.rint(F.coalesce(c, F.lit(0.0))).cast("bigint").cast("string")

    return F.concat_ws("|", word(district), word(kind), whole(area), whole(price))


def post_id(link: Column, text: Column) -> Column:
    """Id in a post's link, else a hash of its whole text."""
    found = F.coalesce(group(link, r"(?:posts|permalink)/(\d+)"), group(link, r"story_fbid=(\d+)"))
    return F.coalesce(found, F.concat(F.lit("hash_"), F.sha2(text, 256)))


def geocode_query(address: Column | str, city: Column | str) -> Column:
    """Query text for an address lookup; null where the address is unusable."""
    a = as_col(address)
    usable = (
        (F.length(a) >= 4)
        & ~a.rlike(r"(?U)\d+\s*часа")
        & ~a.rlike(r"document\.createElement|cdn-cgi|challenge-platform")
        & a.rlike("[А-Яа-я]")
    )
    head = strip(F.regexp_replace(a, r"(?U)\s+", " "))
    town = strip(F.regexp_replace(as_col(city), r"(?U)^(гр\.|с\.)\s*", ""))
    return F.when(usable, F.concat_ws(", ", head, town, F.lit("България")))


def json_list(c: Column | str) -> Column:
    """JSON array text to a list; null, blank or malformed text to an empty list."""
    return F.coalesce(F.from_json(blank_to_null(as_col(c)), "array<string>"),
                      F.array().cast("array<string>"))


def list_json(c: Column | str) -> Column:
    return F.to_json(as_col(c))


def clean_email(c: Column | str) -> Column:
    """Lower-case e-mail address, null where it is not one."""
    e = F.lower(strip(as_col(c)))
    ok = e.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$") & (F.length(e) <= 254)
    return F.when(ok, e)


def known_cities(c: Column | str) -> Column:
    """The listed towns of a subscriber, others dropped, order kept."""
    return F.filter(F.coalesce(as_col(c), F.array().cast("array<string>")),
                    lambda x: x.isin(*L.SUBSCRIBER_CITIES))


def clamp_discount(c: Column | str) -> Column:
    """Threshold as a whole number in 10..70; 20 where it cannot be read."""
    n = as_col(c).try_cast("int")
    return F.when(n.isNull(), F.lit(20)).otherwise(F.greatest(F.lit(10), F.least(F.lit(70), n)))
