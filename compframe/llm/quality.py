"""Quality rules and a hashed n-gram likelihood ratio, all in DataFrame functions.

**Method.** Words and word pairs are hashed into ``BUCKETS`` buckets. Bucket counts of a trusted
target and of the whole raw corpus give two multinomials, the target's smoothed towards the raw one. A document's verdict is the mean
over its n-grams of log P(target) - log P(raw), held against a fixed threshold: text as the target
has it lies around zero whatever its length, junk far below. Natural logarithm.

**What is fitted on what.** The raw multinomial counts every n-gram of every document. The target
is a documented bounded sample of labelled rows: the ``TRUSTED`` good and not toxic ones whose
hashed ids are smallest. Without such labels the ratio is undefined and only the base rules decide.

**Scale.** One scan for the counts (combined before the shuffle into at most ``BUCKETS`` rows a task)
and one for the scores. The weights are one array of fixed size, ids of the sample one of at most
``TRUSTED``; nothing else is broadcast, no text is shuffled.

**Edge cases.** Null and empty texts have zeros and fail the base rules. One word has no pair and is
scored by itself. Null or unknown labels are ignored; a null id is in no sample. Equal rows each
get their row; no rows give an empty result. Extra columns are ignored, or kept by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_007
TRUSTED = 4_000
#: Added to each raw bucket; tokens by which the target leans on the raw corpus, so that a small sample accuses nobody.
SMOOTHING, LEANING = 1.0, 100_000
THRESHOLD = -0.08
#: Columns that are added to a table of the user's; no name that anyone chooses.
RULES, TABLE = "\x01rules", "\x01weights"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SEPARATORS = "\t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    blank = F.translate(F.coalesce(text, F.lit("")), SEPARATORS, " " * len(SEPARATORS))
    return F.array_remove(F.split(blank, " "), "")


def _from(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that stand twice or more in the text.

    Windows are sorted by a 32-bit hash with their place below it. Only neighbours with equal hashes
    are looked at again, by the words themselves, so a collision changes nothing.
    """
    n = F.size(words) - 2
    codes = F.transform(_from(n), lambda i: F.shiftleft(F.hash(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).cast("long"), 31) + i)

    def places(order: Column) -> Column:
        """Places of windows whose hash stands more than once."""
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.shiftright(F.get(order, i), 31) == F.shiftright(F.get(order, j), 31), F.lit(False))
        hit = F.filter(_from(F.size(order)), lambda i: same(i, i + 1) | (F.when(i > 0, same(i, i - 1)).otherwise(False)))
        return F.transform(hit, lambda i: F.get(order, i).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))

    def covered(at: Column) -> Column:
        windows = F.array_sort(F.transform(at, lambda p: F.struct(
            F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("w"), p.alias("p"))))

        def count(rows: Column) -> Column:
            def same(i: Column, j: Column) -> Column:
                return F.coalesce(F.get(rows, i)["w"] == F.get(rows, j)["w"], F.lit(False))
            hit = F.filter(_from(F.size(rows)), lambda i: same(i, i + 1) | (F.when(i > 0, same(i, i - 1)).otherwise(False)))
            own = F.transform(hit, lambda i: F.get(rows, i)["p"])
            return F.size(F.array_distinct(F.flatten(F.transform(own, lambda p: F.array(p, p + 1, p + 2)))))

        return let(windows, count)

    found = let(F.sort_array(codes), places)
    return let(found, lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(covered(at))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, " " + SEPARATORS, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def ngrams(words: Column) -> Column:
    """Bucket of every word and of every pair of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))
    two = F.transform(_from(F.size(words) - 1), lambda i: F.pmod(F.hash(F.get(words, i), F.lit(" "), F.get(words, i + 1)), F.lit(BUCKETS)))
    return F.concat(one, two)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED, id: str = "doc_id") -> DataFrame:
    """At most ``limit`` ids labelled good and not toxic, chosen by hash."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col(id).isNotNull())
    return good.select(F.col(id).cast("long").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(limit)


def bucket_counts(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, raw, target) over every n-gram of every document; the ids of the sample are broadcast, at most ``TRUSTED``."""
    own = docs.select(F.col(id).cast("long").alias("id"), words_of(F.col(text)).alias("w"))
    marked = own.join(F.broadcast(trusted), own["id"] == trusted["trusted_id"], "left")
    one = marked.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("g"),
                        F.col("trusted_id").isNotNull().cast("int").alias("t"))
    both = one.select("t", F.explode(F.array(
        F.pmod(F.hash("g.a"), F.lit(BUCKETS)),
        F.when(F.col("g.b").isNotNull(), F.pmod(F.hash(F.col("g.a"), F.lit(" "), F.col("g.b")), F.lit(BUCKETS))))).alias("bucket"))
    return both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))


def weights(counts: DataFrame) -> list[float] | None:
    """log P(target) - log P(raw) of every bucket; None where there is no target. Fixed size."""
    rows = counts.collect()
    raw, target = sum(r.raw for r in rows), sum(r.target for r in rows)
    if not target:
        return None
    at = {r.bucket: r for r in rows}

    def ratio(b: int) -> float:
        t, w = (at[b].target, at[b].raw) if b in at else (0, 0)
        share = (w + SMOOTHING) / (raw + SMOOTHING * BUCKETS)
        return math.log((t + LEANING * share) / (target + LEANING)) - math.log(share)

    return [ratio(b) for b in range(BUCKETS)]


def log_ratio(words: Column, table: Column) -> Column:
    """Mean weight of a document's n-grams; null without any."""
    total = F.aggregate(ngrams(words), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1))


def judged(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column (named by ``RULES``) of the base counts, ``base_failed``, ``score`` and ``kept``."""
    spark = docs.sparkSession
    table = weights(bucket_counts(docs, trusted_ids(labels), id, text))

    def rules(w: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.translate(F.coalesce(F.col(text), F.lit("")), " " + SEPARATORS, "")).cast("long")
        marks = (F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.translate(F.coalesce(F.col(text), F.lit("")), "#*$%&|<>", ""))).cast("long")
        score = F.lit(None).cast("double") if table is None else log_ratio(w, F.col(TABLE))
        return F.struct(n.alias("n_words"), chars.alias("word_chars"), marks.alias("n_symbols"), duplicate_lines(F.col(text)).alias("n_dup_lines"),
                        repeated_words(w).alias("n_repeat_words"), score.alias("score"))

    weight = spark.createDataFrame([(table,)], "weights array<double>").scalar()  # one value of fixed size

    def verdict(r: Column) -> Column:
        failed = (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > MAX_REPEATED * r["n_words"])
        fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
        return F.struct(*[r[c].alias(c) for c in fields], failed.alias("base_failed"),
                        (~failed & (F.coalesce(r["score"], F.lit(0.0)) >= threshold)).alias("kept"))

    # one expression that binds its parts, so that a filter on the verdict computes them once
    return docs.withColumn(TABLE, weight).withColumn(RULES, let(let(words_of(F.col(text)), rules), verdict)).drop(TABLE)


def verdicts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every document."""
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return judged(slim, labels).select("doc_id", *[f"{RULES}.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])


def keep(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept."""
    return judged(docs, labels, id, text).where(F.col(RULES)["kept"]).select(*docs.columns)
