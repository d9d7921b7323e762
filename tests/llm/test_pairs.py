"""Line dedup, SimHash and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from compframe.llm import lines, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, n, letters):
    out = list(text)
    for _ in range(n):
        at = rnd.randrange(len(out) + 1)
        kind = rnd.randrange(3)
        if kind == 0 or at == len(out):
            out.insert(at, rnd.choice(letters))
        elif kind == 1:
            del out[at]
        else:
            out[at] = rnd.choice(letters)
    return "".join(out)


def test_banded_distance():
    rnd = random.Random(1)
    for _ in range(3000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(13)))
        b = edited(rnd, a, rnd.randrange(5), "abc")
        k = rnd.randrange(5)
        assert lines.edit_distance(a, b, k) == min(distance(a, b), k + 1), (a, b, k)


def test_character_counts_bound_the_distance():
    rnd = random.Random(3)
    pairs = [(a, edited(rnd, a, rnd.randrange(6), "abcé😀")) for a in ("".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 30))) for _ in range(500))]
    found = [distance(a, b) for a, b in pairs]
    bound = [lines.can_be_close([a for a, _ in pairs], [b for _, b in pairs], lines.np.array([d - k for d in found])) for k in (0, 1)]
    assert bound[0].all() and 0 < bound[1].sum() < len(pairs)


def test_close_lines_share_a_key_and_a_sketch():
    rnd = random.Random(2)
    for _ in range(3000):
        a = "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(24, 60)))
        b = edited(rnd, a, rnd.randrange(1, 3), "abcé")
        short, long = sorted((a, b), key=len)
        index = {(len(short), i, short[p:p + n]) for i, (p, n) in enumerate(lines.segments(len(short)))}
        assert index & {(n, i, long[p:q]) for n, i, p, q in lines.probes(len(long))}
        x, y = lines.sketches([a, b]).tolist()
        gap = (x ^ y) & (1 << 64) - 1
        assert (gap & 0xFFFFFFFF).bit_count() <= 4 and (gap >> 32).bit_count() <= 8


def brute_lines(docs):
    """What stays of each document: links by distance, classes by search, the first line of a class stays."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    first = {}
    for i, t in order:
        for k, x in lines.worded(t):
            first.setdefault(x, (i, k))
    group = {x: {x} for x in first}
    links = Counter()
    longer = [x for x in first if len(x) >= lines.SHORTEST]
    for i, a in enumerate(longer):
        for b in longer[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    head = {x: min((first[y] for y in group[x]), key=lambda p: (p[0] is None, p)) for x in first}
    out = {}
    for i, t in docs:
        gone = {k for k, x in lines.worded(t) if head[x] != (i, k)}
        out[i] = (len(gone), sum(links[x] for _, x in lines.worded(t)), "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone))
    return out


def test_line_dedup_finds_every_close_line(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdef ghij") for _ in range(rnd.randrange(20, 45))) + "z" for _ in range(12)]
    docs = [(i, "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2]), "xyz") for _ in range(4)) + "\n\n ") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_lines(docs)
    got = {r.doc_id: (r.n_removed, r.n_links, r.kept_sha256) for r in lines.report(df).collect()}
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in want.items()}
    assert {r.doc_id: r.text for r in lines.without_repeats(df).collect()} == {i: t for i, (_, _, t) in want.items()}


def test_the_limit_of_edits_grows_with_the_line(spark):
    rnd = random.Random(15)
    base = ["".join(rnd.choice("abcdef ghij") for _ in range(n)) + "z" for n in (12, 15, 70, 130, 260, 500)]
    near = lambda n: 1 if n < 20 else max(2, n // 20)
    docs = [(i, "\n".join(edited(rnd, x, rnd.randrange(near(len(x)) + 2), "xyz") for x in base)) for i in range(12)]
    seen = sorted({x for _, t in docs for _, x in lines.worded(t)})
    want = {frozenset((a, b)) for i, a in enumerate(seen) for b in seen[:i]
            if (n := min(len(a), len(b))) >= 10 and abs(len(a) - len(b)) <= near(n) and distance(a, b) <= near(n)}
    assert {min(map(len, p)) // 50 for p in want} >= {0, 1, 2, 5}
    names = {lines.line_id(x): x for x in seen}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [frozenset((names[r.u], names[r.v])) for r in lines.links(lines.with_place(df, "doc_id", "text")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_crowd_of_close_lines_is_counted_without_a_row_for_each_pair(spark):
    rnd = random.Random(16)
    base = "".join(rnd.choice("abcdef ghij") for _ in range(150))
    seen = sorted({edited(rnd, base, 3, "xyz") for _ in range(130)})
    want = Counter(x for i, a in enumerate(seen) for b in seen[:i] if distance(a, b) <= max(2, min(len(a), len(b)) // 20) for x in (a, b))
    own = lines.with_place(spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string"), "doc_id", "text")
    rows, got = lines.linked(own).collect(), Counter()
    for r in rows:
        got[r.line] += r.links
    assert got == {lines.line_id(x): n for x, n in want.items()} and len(rows) < sum(want.values()) // 4


def test_exploded_rows_are_not_sent_through_the_driver(spark):
    nodes = simhash.staged(spark.range(3000).selectExpr("xxhash64(id) AS fp", "id AS node"), "nodes")
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_distances_at_once_equal_single_ones():
    rnd = random.Random(18)
    texts, limits = [], []
    for size in (1, 5, 40, 63, 64, 65, 200, 900):
        for k in (0, 1, 2, 7, 31, 32, 62, 63):
            a = "".join(rnd.choice("abc dя€") for _ in range(size))
            b = edited(rnd, a, rnd.randrange(k + 3), "abcx") or "a"
            if abs(len(a) - len(b)) <= k:
                texts += [a, b]
                limits.append(k)
    x = 2 * lines.np.arange(len(limits))
    got = lines.Texts(texts).distances(x, x + 1, lines.np.array(limits))
    want = [lines.edit_distance(texts[i], texts[i + 1], k) for i, k in zip(x.tolist(), limits, strict=True)]
    assert [min(d, k + 1) for d, k in zip(got.tolist(), limits, strict=True)] == want


def test_lines_of_a_crowd_meet_at_few_places(spark):
    rnd = random.Random(19)
    base = "".join(rnd.choice("abcdef ghij") for _ in range(150))
    seen = sorted({edited(rnd, base, 3, "xyz") for _ in range(200)})
    own = lines.with_place(spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string"), "doc_id", "text")
    pairs = lines.staged(lines.candidates(own), "line-pairs")
    met = lines.placed(pairs).collect()
    assert sum(len(r.data) for r in met) == sum(len(r.data) for r in pairs.collect())  # no pair is lost
    assert len({r.place for r in met}) == 1  # until now 16 places for each line with many partners


def test_index_rows_of_long_lines_take_few_bytes():
    rnd = random.Random(17)
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(rnd.randrange(60, 700))) for _ in range(400)]
    h, of, place, lens = lines.first_grams(texts, 2, lines.np.zeros(1 << lines.HEAVY_BITS, lines.np.uint8))
    assert len(h) * lines.ROW.itemsize < 2 * lens.sum()
    for i, n in enumerate(lens.tolist()):
        end = apart = 0
        for p in sorted(place[of == i].tolist()):
            if p >= end:
                apart, end = apart + 1, p + lines.GRAM
        assert apart >= n // 20 + 2  # two are left whatever a near line changes


def test_line_dedup_edge_cases(spark, edge, nothing, rows):
    got = lines.without_repeats(edge)
    assert got.columns == edge.columns and got.count() == len(rows)
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert (1, rows[0][1]) in texts and (2, "") in texts and (4, None) in texts and (7, rows[6][1]) in texts
    assert (11, "\nx") in texts  # the shared line and the second x go, the empty line stays
    assert [r.text for r in got.where("doc_id = 9").collect()] == ["one two", "one two"]  # wholly equal rows are treated alike
    assert lines.report(edge).count() == len(rows)
    assert lines.report(nothing).count() == 0 and lines.without_repeats(nothing).count() == 0


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles)) if shingles else 0


def components(prints):
    """Smallest id reachable by links of at most four bits."""
    ids = list(prints)
    best = {i: min(k for k in ids if k is not None and prints[k] == prints[i]) for i in ids if i is not None}
    changed = True
    while changed:
        changed = False
        for i in best:
            for j in best:
                if best[j] < best[i] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    best[i], changed = best[j], True
    return best


def test_fingerprint_equals_its_definition(rows):
    for _, t in rows:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)


def test_every_link_is_found(spark):
    rnd = random.Random(9)
    seeds = [rnd.getrandbits(64) for _ in range(15)]
    prints = {}
    for i in range(300):
        x = rnd.choice(seeds)
        for _ in range(rnd.randrange(7)):
            x ^= 1 << rnd.randrange(64)
        prints[i] = x
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for x, i in {x: i for i, x in prints.items()}.items()], "fp long, node long")
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(nodes).collect()}
    unique = {x: i for i, x in prints.items()}
    assert got == {tuple(sorted((i, j))) for x, i in unique.items() for y, j in unique.items() if x < y and (x ^ y).bit_count() <= 4}


def test_simhash_edge_cases(edge, nothing, rows):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(rows)
    prints = {i: brute_fingerprint(t) for i, t in rows if i is not None and i != 7}
    want = components(prints)
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 1 and ids.count(None) == 2 and 2 not in ids and 5 not in ids and 4 in ids
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def brute_substrings(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {}
    for i, t in order:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - substrings.WINDOW + 1):
            key = tuple(w[k:k + substrings.WINDOW])
            if key in seen:
                gone.update(range(k, k + substrings.WINDOW))
            seen.add(key)
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("slice_bytes", [4 << 20, 300])
def test_substring_dedup_equals_brute_force(spark, slice_bytes, monkeypatch):
    from compframe.llm import common
    monkeypatch.setattr(common.by_slice, "__defaults__", (slice_bytes,))
    rnd = random.Random(4)
    parts = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(15, 45))) for _ in range(12)]
    docs = [(i, "  ".join(rnd.choice(parts) if rnd.random() < 0.5 else " ".join(f"v{rnd.randrange(9999)}" for _ in range(rnd.randrange(1, 30)))
                          for _ in range(rnd.randrange(1, 7)))) for i in range(60)]
    docs += [(60, "buy now " * 200), (61, "buy now " * 50), (62, docs[3][1]), (63, docs[3][1]), (64, None), (None, docs[5][1] + " tail")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(df).collect()}
    assert got == brute_substrings(docs)


def test_substring_edge_cases(edge, nothing, rows):
    got = substrings.without_repeats(edge).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 7, 9)}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_words and by[4].n_words == 0 and 0 < by[3].n_removed < by[3].n_words
    assert by[12].n_removed == 0 and max(r.n_words for r in got) == 30_000
    assert substrings.without_repeats(nothing).count() == 0


def colliding(make):
    """Two texts whose hashes (Spark's, seed 42) agree in their upper 31 bits."""
    seen = {}
    for i in range(1 << 20):
        upper = xxhash.xxh64_intdigest(make(i), 42) >> 33
        if upper in seen:
            return make(seen[upper]), make(i)
        seen[upper] = i
    raise AssertionError


def test_rows_without_id_are_told_apart_by_the_whole_hash(spark):
    """A text that stands once keeps its line although another one without an id, alike in 31 bits, loses its own."""
    once, twice = colliding(lambda i: f"other line {i} of some text")
    df = spark.createDataFrame([(None, once), (None, twice), (1, twice)], "doc_id long, text string")
    assert sorted(r.text for r in lines.without_repeats(df).collect()) == sorted(["", once, twice])
    once, twice = colliding(lambda i: " ".join(f"w{i}x{j}" for j in range(25)))
    df = spark.createDataFrame([(None, once), (None, twice), (1, twice)], "doc_id long, text string")
    assert sorted(r.kept for r in substrings.without_repeats(df).collect()) == sorted(["", once, twice])
