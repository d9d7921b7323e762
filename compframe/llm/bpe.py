"""BPE encoding and decoding with content-defined chunks that are encoded once.

**Chunks.** A rolling hash over the last ``WINDOW`` bytes cuts a text wherever its low bits
are zero, so equal passages give equal chunks wherever they stand. Chunks that many
documents share are encoded by one Spark job before the others start, and every task gets
them as a dictionary of bounded size (``SHARED`` chunks of at most ``LONGEST`` bytes, the most
frequent first; ties by hash). All other chunks are encoded where they stand, once in a run of
documents as long as the task's memo (``MEMO_BYTES``) holds them. Texts are never shuffled.

**Joins.** A chunk is encoded without its neighbours, so tokens next to a cut can be wrong. A
space after a visible ASCII character always starts a new pre-token, whatever is around it;
such a place is an anchor. At each cut the span from the last anchor before it to the first
anchor after it is encoded anew, and the span grows to further anchors until the tokens of
both sides end exactly at its ends. Chunks without an anchor are joined to the next one.

**Exactness.** Ids equal those of the vocabulary's own library on the whole text: merges go
by rank, and ``Vocabulary`` refuses a file whose merge order is not its id order. The added
special token is one token wherever its string stands.

**Edge cases.** Null and empty texts: no tokens, digests of the empty string. One very long
text: chunks are processed one after the other. Null ids and equal rows pass through. No rows:
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.llm.common import BASE, BYTE_CODE, binary, by_slice

WINDOW = 8
#: Average distance of cuts, a power of two; the shortest chunk; the longest chunk that the dictionary takes.
AVERAGE, SHORTEST, LONGEST = 1024, 256, 8192
SHARED = 4096
MEMO_BYTES = 16 << 20
#: Pre-token pattern of the byte-level family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ANCHOR = re.compile(rb"[\x21-\x7e](?= )")


def byte_of() -> dict[str, int]:
    """Byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: encoder, and bytes and decimal string of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in, model = byte_of(), spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(stand_in[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merged]
        if order != sorted(order) or len(ranks) != 256 + len(merged):
            raise ValueError(f"{path}: merges are not in the order of ids")
        self.bytes = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        top = max(self.bytes) + 1
        self.text = [str(i) for i in range(top)]
        self.length = [len(self.bytes.get(i, b"")) for i in range(top)]
        self.special = set(special)
        self.encoder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, part: bytes) -> list[int]:
        return self.encoder.encode(part.decode(), allowed_special=self.special, disallowed_special=())

    def decode(self, ids: list[int]) -> str:
        get = self.bytes.__getitem__
        return b"".join([get(i) for i in ids]).decode("utf-8", "replace")


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text. Every chunk but a lone one has an anchor; none splits a character."""
    n = len(text)
    if n <= SHORTEST:
        return [n] if n else []
    data = np.frombuffer(text, np.uint8)
    codes = (BYTE_CODE >> np.uint64(32)).astype(np.uint32)[data]
    m = n - WINDOW
    h = codes[:m].copy()
    base = np.uint32(int(BASE) & 0xFFFFFFFF)
    for j in range(1, WINDOW):
        h *= base
        h += codes[j:j + m]
    h ^= h >> np.uint32(15)
    found = np.flatnonzero(((h & np.uint32(AVERAGE - 1)) == 0) & ((data[WINDOW:] & 0xC0) != 0x80)) + WINDOW
    out, last = [], 0
    for at in found.tolist():
        if at - last >= SHORTEST and ANCHOR.search(text, last, at):
            out.append(at)
            last = at
    if last < n:
        if out and not ANCHOR.search(text, last, n):
            out.pop()
        out.append(n)
    return out


class Encoder:
    """Encodes whole texts from chunks, with a dictionary of shared ones and a bounded memo."""

    def __init__(self, vocabulary: Vocabulary, shared: dict[bytes, list[int]]):
        self.vocabulary, self.shared = vocabulary, shared
        self.memo: dict[bytes, list[int]] = {}
        self.held = 0

    def chunk(self, part: bytes) -> list[int]:
        ids = self.shared.get(part)
        if ids is None and (ids := self.memo.get(part)) is None:
            ids = self.vocabulary.encode(part)
            if self.held > MEMO_BYTES:
                self.memo.clear()
                self.held = 0
            self.memo[part] = ids
            self.held += 8 * len(part)
        return ids

    def encode(self, text: bytes) -> list[int]:
        ends = cuts(text)
        if len(ends) <= 1:
            return list(self.chunk(text)) if text else []
        length, out, start = self.vocabulary.length, [], 0
        for end in ends:
            ids = self.chunk(text[start:end])
            if start:
                ids = self._join(text, out, ids, start, end, length)
            out += ids
            start = end
        return out

    def _join(self, text: bytes, out: list[int], ids: list[int], cut: int, end: int, length: list[int]) -> list[int]:
        """Take wrong tokens off the end of ``out``; return those that follow, up to the end of the chunk after ``cut``."""
        a, left = cut, 0
        while True:  # the tokens before the span have to end at its start
            a = _anchor_before(text, a)
            while left < cut - a:
                left += length[out.pop()]
            if left == cut - a:
                break
        b, right, i = cut, 0, 0
        while True:  # and those after it have to begin at its end
            m = ANCHOR.search(text, b, end)
            b = m.end() if m else end
            while right < b - cut:
                right += length[ids[i]]
                i += 1
            if right == b - cut:
                break
        return self.vocabulary.encode(text[a:b]) + ids[i:]


def _anchor_before(text: bytes, before: int) -> int:
    """Last place under ``before`` where a space follows a visible ASCII character, or 0."""
    at = before
    while (at := text.rfind(b" ", 0, at)) > 0:
        if 0x21 <= text[at - 1] <= 0x7E:
            return at
    return 0


def _chunks(text: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(text):
        yield text[start:end]
        start = end


def shared_chunks(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = SHARED) -> dict[bytes, list[int]]:
    """The chunks that stand in most places, each encoded once; at most ``limit``, none longer than ``LONGEST``."""
    only = docs.select(F.col(text).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [xxhash.xxh64_intdigest(c) for t in binary(b.column(0)) for c in _chunks(t.as_py()) if len(c) <= LONGEST]
            yield pa.record_batch([pa.array(np.array(found, np.uint64).view(np.int64))], ["key"])

    top = (only.mapInArrow(keys, "key long").groupBy("key").count().where("count > 1")
           .orderBy(F.col("count").desc(), "key").limit(limit).collect())
    if not top:
        return {}
    wanted = {r.key & (1 << 64) - 1 for r in top}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            rows = []
            for t in binary(b.column(0)):
                for c in _chunks(t.as_py()):
                    if len(c) <= LONGEST and c not in seen and xxhash.xxh64_intdigest(c) in wanted:
                        seen.add(c)
                        rows.append(c)
            yield pa.record_batch([pa.array(rows, pa.binary())], ["chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary)
        for b in batches:
            chunks = b.column(0).to_pylist()
            yield pa.record_batch([pa.array(chunks, pa.binary()), pa.array([v.encode(c) for c in chunks], pa.list_(pa.int32()))], ["chunk", "ids"])

    rows = only.mapInArrow(first, "chunk binary").distinct().mapInArrow(encode, "chunk binary, ids array<int>").collect()
    return {bytes(r.chunk): list(r.ids) for r in rows}


def encode_documents(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", with_ids: bool = False,
                     shared: dict[bytes, list[int]] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    The first digest is of the decimal ids joined by commas, the second of what the ids decode to.
    """
    sent = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, vocabulary, text) if shared is None else shared)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(Vocabulary(vocabulary), sent.value)
        spelled, sha = coder.vocabulary.text, hashlib.sha256
        for b in (part for batch in batches for part in by_slice(batch, 1)):
            counts, of_ids, of_text, kept = [], [], [], []
            for t in binary(b.column(1)):
                ids = coder.encode(t.as_py())
                counts.append(len(ids))
                of_ids.append(sha(",".join([spelled[i] for i in ids]).encode()).hexdigest())
                of_text.append(sha(coder.vocabulary.decode(ids).encode()).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.record_batch(cols + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode_documents(rows: DataFrame, vocabulary: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; a null array gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary)
        for b in batches:
            texts = [None if x is None else v.decode(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
