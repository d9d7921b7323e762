"""Substring dedup: documents factored against an index of all earlier text.

A word goes if a window of ``WINDOW`` words that covers it stands earlier too (smaller id, or same
document and earlier start). As in relative Lempel-Ziv parsing a document is read from left to right
as factors, longest runs of words whose windows all stand in the reference, and literal words.
The reference is the whole corpus, held as an index of blocks:

1. **Index.** Every window is represented by its minimizer, the ``GRAM``-word block in it with the
   smallest hash. Equal windows have equal minimizers, so about one word in seven is indexed
   and nothing is missed. A block that only one text has cannot be part of a factor.
2. **Factors.** Only windows whose minimizer stands in several texts (or twice in one) are looked
   up, by 128-bit hashes. Consecutive windows that stand earlier grow into one factor; at the
   boundary of two factors the windows across it are looked up by themselves, so words that
   no single reference covers are still found.
3. **Cut.** The covered words of a document are removed.

**Hot groups.** Texts with the same words are one text, the smallest id's; the others go whole if they
have a window. Within a slice of documents an index block or window that repeats is settled on the
spot and sent on once, so a passage in a third of all documents is one row a slice. What
remains is sorted and read as a stream with one row of memory. Texts are shuffled once, by id,
for both the look-up and the cut.

**Edge cases.** Null and empty texts have no words and an empty rest. Fewer than ``WINDOW`` words: all
stay. A null id counts as larger than all others and comes back as null; so does the largest long, which stands for it. Rows that share an id
are ordered by a hash of their text; equal rows get equal results. No rows: an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.llm.common import BASE, BASE_2, binary, by_slice, inside, mix, window_hashes, words
from compframe.session import staged

WINDOW = 20
GRAM = 8
LAST = (1 << 63) - 1  # stands for a null id


def minimizers(h: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all blocks, of each window's minimizer, and which blocks are that of a window in ``ok``."""
    grams = window_hashes(h, GRAM)
    n, span = len(ok), WINDOW - GRAM + 1
    least = grams[:n].copy()
    for j in range(1, span):
        np.minimum(least, grams[j:j + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for j in range(span):
        chosen[j:j + n] |= ok & (grams[j:j + n] == least)
    return grams, least, chosen


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), _longs(values))


def index_blocks(docs: DataFrame) -> DataFrame:
    """(id, tag, n_words, sha, blocks, known) for (id, tag, text).

    ``blocks``: index blocks to be looked for in other slices; ``known``: those that this slice has several times.
    A text that the slice had already has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_slice(batch, 2)):
            w = words(b.column(2))
            rows, sizes = b.num_rows, np.diff(w.first)
            sha = [hashlib.sha256(b" ".join(t.as_py().split())).digest() for t in binary(b.column(2))]
            new, seen = np.ones(rows, bool), set()
            for i, s in enumerate(sha):
                new[i] = s not in seen
                seen.add(s)
            of = np.repeat(np.arange(rows), sizes)
            ok = inside(w.first, len(w.hash), WINDOW)
            ok &= new[of[:len(ok)]]
            blocks, known = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if ok.any():
                grams, _, chosen = minimizers(w.hash, ok)
                at = np.flatnonzero(chosen)
                key, doc = grams[at], of[at]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                first = np.concatenate(([True], key[1:] != key[:-1]))
                several = np.repeat(np.diff(np.append(np.flatnonzero(first), len(key))) > 1, np.diff(np.append(np.flatnonzero(first), len(key))))
                once = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
                blocks, known = _by_doc(key[first], doc[first]), _by_doc(key[several & once], doc[several & once])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes.astype(np.int64)), pa.array(sha, pa.binary()),
                                   _lists(blocks[0], np.bincount(blocks[1], minlength=rows)), _lists(known[0], np.bincount(known[1], minlength=rows))],
                                  ["id", "tag", "n_words", "sha", "blocks", "known"])

    return docs.mapInArrow(run, "id long, tag long, n_words long, sha binary, blocks array<long>, known array<long>")


def _by_doc(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(doc, kind="stable")
    return key[order], doc[order]


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, tag): those whose key has more than one tag."""
    last_key, last_tag, told = None, None, False  # the open run: its key, first tag, and whether that row is out
    for b in batches:
        key, tag = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        n = len(key)
        if not n:
            continue
        begin = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
        run = np.cumsum(begin)  # 0: the run that was open
        starts = np.flatnonzero(begin)
        first_tag = np.concatenate(([tag[0] if last_tag is None else last_tag], tag[starts]))[run]
        other = tag != first_tag
        out_key, out_tag = [key[other]], [tag[other]]
        with_other = np.unique(run[other])
        heads = with_other[with_other > 0]
        out_key.append(key[starts[heads - 1]])
        out_tag.append(tag[starts[heads - 1]])
        if not told and len(with_other) and with_other[0] == 0:
            out_key.append(np.array([last_key]))
            out_tag.append(np.array([last_tag]))
        now_told = bool(len(with_other) and with_other[-1] == run[-1]) or (run[-1] == 0 and told)
        if run[-1] > 0:
            last_tag = tag[starts[-1]]
        last_key, told = key[-1], now_told
        yield pa.record_batch([pa.array(np.concatenate(out_key), pa.int64()), pa.array(np.concatenate(out_tag), pa.int64())], ["key", "tag"])


def claims(rows: DataFrame) -> DataFrame:
    """(h1, h2, id, tag, place, n) for (id, tag, text, keys): a window per row with n = 0, to be compared with those of other slices.

    Rows with n > 0 are settled: n places from ``place`` on begin windows that stand earlier in this slice.
    ``place`` is the start of the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in by_slice(batch, 2)):
            w = words(b.column(2))
            ok = inside(w.first, len(w.hash), WINDOW)
            if not ok.any():
                continue
            of = np.repeat(np.arange(b.num_rows), np.diff(w.first))[:len(ok)]
            _, least, _ = minimizers(w.hash, ok)
            keys, n_keys = b.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc_len(b.column(3))
            ends = np.cumsum(n_keys)
            for i in range(b.num_rows):  # windows whose minimizer stands elsewhere too
                a, z = w.first[i], min(w.first[i + 1], len(ok))
                if z > a:
                    ok[a:z] &= np.isin(least[a:z], keys[ends[i] - n_keys[i]:ends[i]])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h1, h2 = (window_hashes(w.hash, WINDOW, base)[at] for base in (BASE, BASE_2))
            ids = b.column(0).to_numpy(zero_copy_only=False)[of[at]]
            tags = b.column(1).to_numpy(zero_copy_only=False)[of[at]]
            place = at - w.first[of[at]]
            order = np.lexsort((place, tags, ids, h2, h1))
            h1, h2, ids, tags, place = h1[order], h2[order], ids[order], tags[order], place[order]
            first = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = (ids != ids[lead]) | (tags != tags[lead]) | (place != place[lead])
            yield _rows(h1[first], h2[first], ids[first], tags[first], place[first], np.zeros(int(first.sum()), np.int64))
            yield _rows(*_runs(ids[later], tags[later], place[later]))

    return rows.mapInArrow(run, "h1 long, h2 long, id long, tag long, place long, n long")


def pc_len(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _rows(h1: np.ndarray, h2: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([_longs(h1), _longs(h2), *(pa.array(x, pa.int64()) for x in rest)], ["h1", "h2", "id", "tag", "place", "n"])


def _runs(ids: np.ndarray, tags: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive places of a document as one row."""
    order = np.lexsort((place, tags, ids))
    ids, tags, place = ids[order], tags[order], place[order]
    same = (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1]) & (place[1:] <= place[:-1] + 1)
    at = np.flatnonzero(np.concatenate(([True], ~same))) if len(ids) else np.zeros(0, np.int64)
    n = place[np.append(at[1:], len(ids)) - 1] - place[at] + 1 if len(at) else np.zeros(0, np.int64)
    ids, tags, place = ids[at], tags[at], place[at]
    return mix(ids.astype(np.int64).view(np.uint64)), mix((place + tags).view(np.uint64)), ids, tags, place, n


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h1, h2, id, tag, place): runs of places whose window has an earlier row. Settled rows pass."""
    last = None  # hashes and place of the first row of the open run
    for b in batches:
        h1, h2, *row, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        settled = n > 0
        out = [[*(x[settled] for x in row), n[settled]]]
        h1, h2, *row = (x[~settled] for x in (h1, h2, *row))
        if len(h1):
            begin = np.concatenate(([last is None or (h1[0], h2[0]) != last[:2]], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            starts = np.flatnonzero(begin)
            run = np.cumsum(begin)
            lead = [np.concatenate(([last[2 + i] if last else 0], x[starts]))[run] for i, x in enumerate(row)]
            later = np.any([x != y for x, y in zip(row, lead, strict=True)], axis=0)
            out.append(_runs(*(x[later] for x in row))[2:])
            last = (h1[-1], h2[-1], *(x[-1] for x in lead))
        yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["id", "tag", "start", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept) from (doc_id, text, factors)."""
    for b in (part for batch in batches for part in by_slice(batch, 1)):
        total, removed, kept = [], [], []
        for text, factors in zip(binary(b.column(1)), b.column(2), strict=True):
            tokens = text.as_py().split()
            gone = np.zeros(len(tokens) + 1, np.int64)
            if factors.is_valid:
                a, z = (factors.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                np.add.at(gone, a, 1)
                np.add.at(gone, np.minimum(z, len(tokens)), -1)
            stay = np.flatnonzero(np.cumsum(gone)[:len(tokens)] == 0)
            total.append(len(tokens))
            removed.append(len(tokens) - len(stay))
            kept.append(b" ".join([tokens[i] for i in stay.tolist()]).decode() if removed[-1] else b" ".join(tokens).decode())
        yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                              ["doc_id", "n_words", "n_removed", "kept"])


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, tag, text): id without nulls, and a hash of the text. Nothing else, so that both joins share one shuffle."""
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("id"),
                       F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text"))


def removals(own: DataFrame) -> DataFrame:
    """(id, tag, factors): what to remove from each of the ``keyed`` documents, as arrays of word ranges (start, end)."""
    blocks = staged(index_blocks(own), "blocks")
    firsts = blocks.groupBy("sha").agg(F.min(F.struct("id", "tag")).alias("first"))
    firsts = staged(firsts.select("sha", "first.id", "first.tag"), "texts")
    # a text is its hash here: copies in other slices bring the same rows
    code = F.xxhash64("sha").alias("tag")
    several = (blocks.select(F.explode("blocks").alias("key"), code).repartition("key").sortWithinPartitions("key", "tag")
               .mapInArrow(_several, "key long, tag long"))
    known = blocks.select(F.explode("known").alias("key"), code)
    keys = several.unionByName(known).groupBy("tag").agg(F.collect_set("key").alias("keys"))
    wanted = staged(firsts.select("id", F.col("tag").alias("t"), code).join(keys, "tag").select("id", F.col("t").alias("tag"), "keys"), "wanted")
    copies = (blocks.where(F.col("n_words") >= WINDOW).select("id", "tag", "sha", "n_words").distinct()
              .join(firsts.select("sha", F.col("id").alias("i"), F.col("tag").alias("t")), "sha")
              .where("id != i OR tag != t").select("id", "tag", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    found = (claims(own.join(wanted, ["id", "tag"]).select("id", "tag", "text", "keys"))
             .repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id", "tag", "place").mapInArrow(_earlier, "id long, tag long, start long, n long"))
    spans = found.select("id", "tag", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end")).unionByName(copies)
    return spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("factors"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: ``kept`` is what stays, words joined by one space."""
    own = keyed(docs, id, text)
    out = own.join(removals(own), ["id", "tag"], "left").select(F.nullif("id", F.lit(LAST)).alias("doc_id"), "text", "factors")
    return out.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")
