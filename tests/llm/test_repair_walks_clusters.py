"""Conversation repair, edit-embedding fingerprints and centroid clustering against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from compframe.llm import centroids, dialogue, editwalk

TURNS = "conv_id long, turn long, role string, text string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (c != d))
    return row[-1]


# --- conversations

def repaired_by_hand(turns):
    """Rows of the report, conversation by conversation in memory, with the exhaustive path search."""
    def text_of(v):
        return " " if v is None else str(v)
    by = {}
    for conv, turn, role, text in turns:
        rows = by.setdefault(conv, [])
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        rows += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
            seen.add((role, text))
        edits, cost = dialogue.brute(bytes(dialogue.symbol(r[1], f) for r, f in zip(rows, faults)))
        lines = "\n".join(f"{r}:{t}" for r, t in dialogue.repaired(iter([r[1:] for r in rows]), edits))
        known = [r[0] for r in rows if r[0] is not None]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count(1), faults.count(2), faults.count(3),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, edits,
                     hashlib.sha256(lines.encode()).hexdigest())
    return out


def assert_repaired(spark, turns, slices):
    df = spark.createDataFrame(turns, TURNS).repartition(slices).withColumns({c: F.lit("x") for c in ("key", "part", "at", "fault", "row", "digest", "cost")})
    got = dialogue.report(df).collect()
    want = repaired_by_hand(turns)
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_block_tables_equal_all_paths():
    r = random.Random(3)
    for n in range(12):
        for _ in range(60):
            s = bytes(r.choices(range(9), weights=[1, 4, 4, 1, 1, 2, 2, 1, 2])[0] for _ in range(n))
            assert dialogue.trace(s) == dialogue.brute(s)


def test_pieces_lead_to_the_same_edits():
    t, r = dialogue.tables(), random.Random(5)
    for _ in range(200):
        s = bytes(r.randrange(9) for _ in range(r.randrange(1, 30)))
        cuts = [0, *sorted(r.randrange(len(s) + 1) for _ in range(3)), len(s)]
        pieces = [s[a:b] for a, b in zip(cuts, cuts[1:])]
        found, v, behind = [dialogue.summary(p) for p in pieces], 0, []
        for front, _, _ in reversed(found):
            behind.append(v)
            v = int(front[v])
        q, edits = 0, ""
        for i, (p, (_, _, leads), w) in enumerate(zip(pieces, found, reversed(behind))):
            edits += dialogue.trace(p, w, q, i == len(pieces) - 1)[0]
            q = int(leads[w, q])
        assert edits == dialogue.trace(s)[0] and v < len(t.vectors)


def test_repair_of_a_mixed_table(spark):
    r = random.Random(7)
    words = ["Good.", "fine", "Why?", "  ", "", None, "No!\n", "été 日本."]
    turns = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(words)) for c in range(40) for t in range(r.randrange(9))]
    turns += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (50, None, "user", "A."), (50, None, "user", "A."), (51, None, None, None)]
    assert_repaired(spark, turns, 4)


def test_one_conversation_over_all_ranges(spark):
    """A hot conversation, with repeated, equal and unnumbered turns, in as many pieces as there are ranges."""
    r = random.Random(11)
    turns = [(7, r.choice([None, *range(900)]), r.choice(["user", "assistant"]), r.choice([f"Text {r.randrange(300)}.", f"cut {r.randrange(99)}", "same."]))
             for _ in range(2500)]
    turns += [(c, t, "user", "Short.") for c in (6, 8) for t in range(3)] + [(7, 5, "user", "same.")] * 400
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert_repaired(spark, turns, 5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_transcripts_go_in_chunks(spark, monkeypatch):
    turns = [(1, t, ("user", "assistant")[t % 2], f"{'word ' * 200}{t}.") for t in range(6000)]
    assert_repaired(spark, turns, 3)


def test_nothing_to_repair(spark):
    assert dialogue.report(spark.createDataFrame([], TURNS)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    row = dialogue.report(spark.createDataFrame([(3, gone, "user", "Hello.")], TURNS)).collect()
    assert [tuple(r) for r in row] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- fingerprints

def by_steps(text):
    """The fingerprint, one step at a time."""
    k, out = editwalk.scale_of(len(text)), ""
    if not text:
        return "00"
    for a in range(0, len(text), editwalk.SECTION):
        part, i, kept = text[a:a + editwalk.SECTION], 0, set(editwalk.steps(k).tolist())
        for step in range(max(kept) + 1):
            code = int(editwalk.mix(np.array([ord(part[i]) + 0x1F3D5B79], np.uint64))[0]) | 1 if i < len(part) else 0
            if step in kept:
                out += f"{1 + (code >> 40) % 15:x}" if code else "0"
            i += (code * int(editwalk.STEP_CODE[step]) % (1 << 64)) >> 63
    return f"{k:02x}{out.rstrip('0')}"


def test_walk_equals_single_steps():
    texts = ["", "a", "ab", "été 日本 😀 \x00", "x" * 33, "the quick brown fox " * 20, "long text " * 1700]
    assert editwalk.fingerprints([editwalk.codes(t) for t in texts]) == [by_steps(t) for t in texts]


def test_fingerprint_does_not_depend_on_its_neighbours():
    r = random.Random(2)
    texts = ["".join(r.choice("abcdef ") for _ in range(r.randrange(3000))) for _ in range(60)]
    together = editwalk.fingerprints([editwalk.codes(t) for t in texts])
    assert together == [editwalk.fingerprints([editwalk.codes(t)])[0] for t in texts]


def test_bit_parallel_distance():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(14))) for _ in range(2))
        assert editwalk.distance(a, b) == levenshtein(a, b)


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(n))


def changed(r, text, n):
    out = list(text)
    for _ in range(n):
        i, kind = r.randrange(len(out)), r.randrange(3)
        out[i:i + (kind != 2)] = [] if kind == 0 else ["q"]
    return "".join(out)


def test_likeness_falls_with_the_edits():
    r = random.Random(6)
    texts = [prose(r, r.randrange(40, 400)) for _ in range(60)]
    own = editwalk.fingerprints([editwalk.codes(t) for t in texts])
    means = []
    for share in (0.0, 0.005, 0.02, 0.08):
        other = editwalk.fingerprints([editwalk.codes(changed(r, t, int(share * len(t)))) for t in texts])
        means.append(np.mean([editwalk.likeness(a, b) for a, b in zip(own, other)]))
    assert means[0] == 1 and means[0] > means[1] > means[2] > means[3]
    assert max(editwalk.likeness(a, b) for a, b in zip(own, own[1:])) < 0.35


@pytest.mark.parametrize("slices", [1, 4])
def test_successors_by_hand(spark, edge, rows, slices):
    got = editwalk.successors(edge.repartition(slices)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    runs = {}
    for r in order:
        runs.setdefault(r[0], []).append(r[1] or "")
    ids = list(runs)
    for r in got:
        own = [t for t in runs[r.doc_id] if len(t) == r.n_chars]
        nxt = runs[r.doc_id] + runs[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        assert any(hashlib.sha256(editwalk.edited(t, n).encode()).hexdigest() == r.edited_sha256 for t in own for n in nxt)
        assert r.fingerprint in editwalk.fingerprints([editwalk.codes(t) for t in own])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_successors_of_unique_ids(spark):
    r = random.Random(8)
    docs = [(i * 3, prose(r, r.randrange(0, 60))) for i in range(300)]
    got = {x.doc_id: x for x in editwalk.successors(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()}
    docs.sort(reverse=True)
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1]):
        new = editwalk.edited(t, n)
        own, other, behind = editwalk.fingerprints([editwalk.codes(x) for x in (t, new, n)])
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, other)
        assert (got[i].near_edited, got[i].near_next) == (editwalk.likeness(own, other), editwalk.likeness(own, behind))


def test_successors_of_little(spark, nothing):
    assert editwalk.successors(nothing).count() == 0
    row = editwalk.successors(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()[0]
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_near_duplicates_against_all_pairs(spark):
    """Classes of texts within 3 % of edits: recall of at least 0.9 of all pairs, and no pair that is not one."""
    r = random.Random(9)
    base = [prose(r, r.randrange(30, 200)) for _ in range(25)]
    texts = base + [changed(r, t, r.randrange(1, max(2, int(0.025 * len(t))))) for t in base for _ in range(3)] + [base[0]] * 3 + ["", "", None]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.class_id for x in editwalk.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    links = [(i, j) for i in range(len(plain)) for j in range(i)
             if abs(len(plain[i]) - len(plain[j])) < 0.03 * len(plain[i]) + 1 and editwalk.distance(plain[i], plain[j]) <= editwalk.EDITS * max(len(plain[i]), len(plain[j]))]
    root = list(range(len(plain)))
    for i, j in links:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    want = {i + 1: x + 1 for i, x in enumerate(root)}
    joined = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    assert sum(got[a] == got[b] for a, b in joined) >= 0.9 * len(joined)
    assert all(want[a] == want[b] for a in got for b in got if a < b and got[a] == got[b])


def test_near_duplicates_of_the_edge_table(spark, edge, rows, nothing):
    got = editwalk.near_duplicates(edge).collect()
    assert len(got) == len(rows) and editwalk.near_duplicates(nothing).count() == 0
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1}


# --- centroids

def by_hand(rows, k=16, rounds=3):
    kept = [(i, [int((Fraction(x) * 64).__floor__()) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), centroids.pack(r[1])))[:k]
    c = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        label = [j for _, j in assign()]
        for j in range(len(c)):
            own = [v for (_, v), m in zip(kept, label) if m == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    last = assign()
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, fits(far), fits(sum(f for f, m in last if m == j)), fits(sum(f for f, _ in last)),
                    hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (far, j) in zip(kept, last)), key=repr)


def clustered(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("vector", "dots", "cluster", "distance", "n", "total")})
    return sorted((tuple(r) for r in centroids.report(df).collect()), key=repr)


def test_clusters_by_hand(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=64) * 0.2 + i % 5).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 63 + [None]), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] + [0.0] * 63),
             (None, [0.5] * 64), (5, [0.25] * 64), (5, [0.25] * 64), (6, rows[6][1]), (7, [-0.0, -1e-300] + [5e-324] * 62)]
    assert clustered(spark, rows) == by_hand(rows)


def test_huge_components_are_exact(spark):
    rows = [(i, [float((-1) ** i * 10.0 ** (i % 39)) if j == i % 64 else 0.1 for j in range(64)]) for i in range(60)]
    assert clustered(spark, rows) == by_hand(rows)


def test_few_vectors_and_ties(spark):
    rows = [(i, [float(i // 2)] + [0.0] * 63) for i in range(6)]
    assert clustered(spark, rows) == by_hand(rows)
    assert clustered(spark, rows * 40) == by_hand(rows * 40)
    assert clustered(spark, []) == [] and clustered(spark, [(1, [1.0])]) == []


def test_floats_are_taken_as_doubles(spark):
    rows = [(i, [float(np.float32(i * 0.1 + j * 0.01)) for j in range(64)]) for i in range(40)]
    assert clustered(spark, rows, "float") == by_hand(rows)


def test_only_changes_are_multiplied():
    r = np.random.default_rng(2)
    v = r.integers(-50, 50, (20, 8))
    old = r.integers(-50, 50, (3, 8)).tolist()
    new = [list(c) for c in old]
    new[1][4] += 7
    changes = centroids.moved(old, new)
    assert changes == [(1, [4], [7])]
    assert (centroids.advance(v, v @ np.array(old).T, changes) == v @ np.array(new).T).all()
