"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has a bit set where over half of its shingle hashes have it. Two
fingerprints within ``TAU`` bits are linked; linked texts form components.

**Candidates.** The 64 bits are a ring of TAU + 1 segments. If all segments together differ
in at most TAU bits, then some segment begins a chain whose first l segments differ in less
l bits, for every l at once: its share l * TAU / (TAU + 1), rounded down (the pigeonring
principle). The first two links of the chain make the join key: the first segment is equal,
the second has at most one bit flipped, so one side carries the plain key and the other the
key with each possible flip. Longer chains and at last the full distance are tested inside
the join, so that a pair that fails is never a row.

**Scale.** Texts with the same fingerprint are one node before anything is joined. A row
that is joined holds two numbers, never a text. Links are kept between nodes only, and a
component is found by label contraction on them.

**Edge cases.** Null and empty texts, and texts without words, have fingerprint 0 and link
like any other. Fewer words than a shingle: the whole sequence is the only shingle. Equal
rows, ids or texts: each row is returned. A null id: the row gets its fingerprint and the
component of that fingerprint's group (null if no row of the group has an id). Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compframe.llm.common import binary
from compframe.operators.duplicates import connected
from compframe.session import staged

SHINGLE = 4
SEED = 42
TAU = 4
#: (lowest bit, width) of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:len(tokens) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at:at + BLOCK], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fingerprint(t.as_py()) for t in binary(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chains() -> list[dict]:
    """For each start of a chain: the key's bits, those of its first three and four segments, and the flips to try."""
    out = []
    for i in range(len(SEGMENTS)):
        ring = [SEGMENTS[(i + j) % len(SEGMENTS)] for j in range(len(SEGMENTS))]
        bits = [((1 << w) - 1) << at for at, w in ring]
        second, width = ring[1]
        out.append({"i": i, "key": bits[0] | bits[1], "three": bits[0] | bits[1] | bits[2],
                    "four": bits[0] | bits[1] | bits[2] | bits[3],
                    "flips": [0] + [1 << (second + b) for b in range(width)]})
    return out


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): ids of nodes (fp, node) whose fingerprints differ in 1 to TAU bits."""
    chains = _chains()
    plain = F.array(*[F.struct(F.lit(c["i"]).alias("chain"), F.lit(_signed(c["key"])).alias("mask")) for c in chains])
    flipped = F.array(*[F.struct(F.lit(c["i"]).alias("chain"), F.lit(_signed(c["key"])).alias("mask"), F.lit(_signed(f)).alias("flip"))
                        for c in chains for f in c["flips"]])
    index = nodes.select("fp", "node", F.explode(plain).alias("k")).select(
        "k.chain", F.col("fp").bitwiseAND(F.col("k.mask")).alias("part"), F.col("fp").alias("y"), F.col("node").alias("v"))
    probe = nodes.select("fp", "node", F.explode(flipped).alias("k")).select(
        "k.chain", F.col("fp").bitwiseXOR(F.col("k.flip")).bitwiseAND(F.col("k.mask")).alias("part"),
        F.col("fp").alias("x"), F.col("node").alias("u"))
    gap = F.col("x").bitwiseXOR(F.col("y"))

    def within(name: str) -> F.Column:
        return F.element_at(F.array(*[F.lit(_signed(c[name])) for c in chains]), F.col("p.chain") + 1)

    close = ((F.col("x") < F.col("y")) & (F.bit_count(gap.bitwiseAND(within("three"))) <= 2)
             & (F.bit_count(gap.bitwiseAND(within("four"))) <= 3) & (F.bit_count(gap) <= TAU))
    p, q = probe.alias("p"), index.alias("q")
    # the pair is one row here only after every test, since all of them are part of the join
    # and both sides are shuffled: Spark takes them for as small as the nodes and would send the exploded rows through the driver
    return p.hint("merge").join(q.hint("merge"), (F.col("p.chain") == F.col("q.chain")) & (F.col("p.part") == F.col("q.part"))
                                & close).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    The fingerprint is 16 lowercase hex digits; the component is the smallest id that links reach.
    """
    prints = staged(fingerprints(docs, id, text), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "fingerprint-nodes")
    groups = connected(links(nodes))
    labels = nodes.join(groups, "node", "left").select("fp", F.coalesce("cluster", "node").alias("component_id"))
    return prints.join(labels, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one text of each group of near-duplicates: the one with the smallest id.

    Rows without an id are kept: nothing tells which of a group they are. Of rows with equal ids
    and equal texts one stays.
    """
    lead = near_duplicates(docs, id, text).where("doc_id = component_id").select(F.col("doc_id").alias(id)).distinct()
    kept = docs.join(lead, id, "left_semi").dropDuplicates([id, text])
    return kept.unionByName(docs.where(F.col(id).isNull()))
