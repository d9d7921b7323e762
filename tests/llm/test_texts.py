"""Archives, tokenizers, secrets, quality rules, decontamination and the language model."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from compframe.llm import bpe, counts, decontam, hmm, quality, secrets, warc
from compframe.llm.common import inside, least_hashed, table, words
from tokenizers import Tokenizer

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PARTS = ["a", "the ", "  ", "\n", "\t", " ", "'r", "e", "'s", "12", "é", "ñ ", "▁", "<|endoftext|>", "<s>", " ", "　", "日本", "😀", "ing", "THE",
         "...", "!! ", "\r\n", "\x00", "ﬁ", "​"]


def fuzz(n, seed=1, size=300):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(size))) for _ in range(n)] + ["", "a" * 3000, " " * 500, "ab " * 900, "x" * 600 + " y"]


def test_words_are_those_of_the_pattern(rows):
    texts = [t for _, t in rows] + fuzz(60)
    for lower in (False, True):
        w = words(pa.array(texts, pa.string()), lower)
        got = [w.data[a:z].tobytes().decode() for a, z in zip(w.start, w.end, strict=True)]
        assert got == [x for t in texts for x in WORD.findall(t or "")]
        assert np.diff(w.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
        names = [x.translate({c: c + 32 for c in range(65, 91)}) if lower else x for x in got]
        assert len(set(zip(names, w.hash.tolist(), strict=True))) == len(set(names)) == len(set(w.hash.tolist()))
    assert inside(np.array([0, 3, 3, 7]), 7, 3).tolist() == [True, False, False, True, True]


# --- archives ----------------------------------------------------------------------------------


class Bytes(io.BytesIO):
    def read_at(self, n, offset):
        self.seek(offset)
        return self.read(n)


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_of_an_archive(zip64):
    f = Bytes()
    with zipfile.ZipFile(f, "w") as z:
        with z.open(zipfile.ZipInfo("a/é.txt"), "w", force_zip64=zip64) as m:
            m.write(b"first")
        for i in range(70_000 if zip64 else 3):  # more members than the plain end record can count
            z.writestr(f"m{i}", b"x%d" % i)
        z.comment = b"a comment PK\5\6 with the mark"
    size = len(f.getvalue())
    found = warc.members(f, size)
    assert [(m.name, m.size, m.header) for m in found] == [(i.filename, i.file_size, i.header_offset) for i in z.infolist()]
    at = warc.member_start(f, found[-1])
    assert f.getvalue()[at:at + found[-1].stored] == b"x%d" % (len(found) - 2)


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        warc.members(Bytes(b"no archive at all, but long enough to hold an end record"), 56)
    f = Bytes()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", b"x" * 100)
    with pytest.raises(ValueError):
        warc.member_start(f, warc.members(f, len(f.getvalue()))[0])


def test_zip64_sizes_come_from_the_extra_field():
    import struct
    name = b"big"
    extra = struct.pack("<HHQQQ", 1, 24, 5 << 32, 6 << 32, 7 << 32)
    central = warc.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), 0)
    raw = central + end64 + warc.LOCATOR + struct.pack("<IQI", 0, len(central), 1) + warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc.members(Bytes(raw), len(raw)) == [warc.Member("big", 0, 6 << 32, 5 << 32, 7 << 32)]


def test_round_trip_of_pages(spark):
    pages = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/\r\nx", "other é"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (None, "u", "alone"),
             (6, "u", "x" * 200_000), (3, "http://again/", "other é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'z' AS sha", "1 AS salt", "2 AS first", "3 AS n", "4 AS payload")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    want = []
    for i, _, h in pages:
        p = (h or "").encode()
        first = min((j for j, _, x in pages if (x or "") == (h or "") and j is not None), default=None)
        ref = first if first is not None and first != i else None
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if ref is None else "revisit", ref))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_records_keep_their_payload():
    raw = warc.record(7, "http://x/", b"payload\r\n\r\nmore", warc.digest_of(b"payload\r\n\r\nmore"), None, 15)
    assert warc.parse(raw).payload == b"payload\r\n\r\nmore"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"more", b"less"))


# --- tokenizers --------------------------------------------------------------------------------


def test_chunked_encoding_equals_the_library(monkeypatch):
    library, v = Tokenizer.from_file(BYTE_BPE), bpe.Vocabulary(BYTE_BPE)
    for shortest, average in ((16, 16), (256, 1024)):
        monkeypatch.setattr(bpe, "SHORTEST", shortest)
        monkeypatch.setattr(bpe, "AVERAGE", average)
        e = bpe.Encoder(v, {})
        for t in fuzz(150, shortest) + fuzz(10, 7, 4000):
            ids = library.encode(t, add_special_tokens=False).ids
            assert e.encode(t.encode()) == ids
            assert v.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents_are_encoded_and_decoded(spark, edge, nothing, rows):
    library = Tokenizer.from_file(BYTE_BPE)
    got = bpe.encode_documents(edge, BYTE_BPE, with_ids=True)
    want = sorted((repr(i), repr(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    taken = got.collect()
    assert sorted((repr(r.doc_id), repr(r.ids)) for r in taken) == want
    for r in taken:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert sorted(repr(r.text) for r in bpe.decode_documents(got, BYTE_BPE).collect()) == sorted(repr(t or "") for _, t in rows)
    assert {r.decoded_sha256 for r in taken} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert bpe.encode_documents(nothing, BYTE_BPE).count() == 0


def test_shared_chunks_are_a_dictionary(spark):
    text = " ".join(f"word{i}" for i in range(2000))
    shared = bpe.shared_chunks(spark.createDataFrame([(text,), ("start " + text,)], "text string"), BYTE_BPE)
    assert shared and all(c.decode() in text for c in shared)
    v = bpe.Vocabulary(BYTE_BPE)
    assert bpe.Encoder(v, shared).encode(text.encode()) == Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids


def test_counts_equal_the_library(monkeypatch):
    sp, model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), counts.Model(PIECE_BPE)
    texts = fuzz(150) + ["é" * 900, "the" * 400]
    want = [len(x) for x in sp.encode(texts)]
    assert counts.Counter(model).counts(texts) == want
    monkeypatch.setattr(counts, "LONG", 3)  # nearly all by the queue
    assert counts.Counter(model).counts(texts) == want


def test_counts_of_documents(edge, nothing, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = sorted(repr((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)) for r in counts.token_counts(edge, PIECE_BPE).collect())
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows]
    assert got == sorted(repr((*w, w[2] > 4096)) for w in want)
    assert counts.token_counts(nothing, PIECE_BPE).count() == 0


# --- secrets -----------------------------------------------------------------------------------


def test_base_spans():
    key = "AKIA" + "ABCD1234EFGH5678"
    text = f"é Password: 'abc123' token=token = abcdefgh {key} AKIASHORT {'0af' * 8} {'0af' * 7}ab_k toKen=abc"
    spans = secrets.base_spans(text)
    assert [text[a:z] for a, z, _ in spans] == ["Password: 'abc123", key, "0af" * 8]
    assert [k for _, _, k in spans] == ["assign", "access", "hex"]  # token=token took the second keyword with it
    assert secrets.base_spans("paſsword=abcdefgh") == []  # letters in either case are A-Z and a-z


def test_guess_cost_counts_every_segment_of_whole_values():
    """Nine segments, and a repeat over more than one piece of 128 characters."""
    assert secrets.guess_cost("password" * 9) == pytest.approx(9 * math.log10(2) + math.log10(math.factorial(9)))
    assert secrets.guess_cost("a" * 1000) == pytest.approx(4.0)
    assert secrets.value_spans("token: " + "a" * 1000) == secrets.value_spans("token: " + "password" * 9) == []
    assert secrets.guess_cost("x7K" * 4000, secrets.GUESSES) < secrets.GUESSES == secrets.guess_cost("".join(chr(33 + i * 7 % 90) for i in range(60)), secrets.GUESSES)


def test_guess_cost_orders_values():
    weak = ["password", "aaaaaaaaaaaa", "qwertyuiop", "2019-01-02", "passwordpassword"]
    strong = ["x7Kp2vQz9LmT", "f3a9c1d07be24680"]
    assert max(map(secrets.guess_cost, weak)) < secrets.GUESSES <= min(map(secrets.guess_cost, strong))
    assert secrets.guess_cost("") == 0.0 and secrets.guess_cost("x7K" * 200) < secrets.guess_cost("".join(chr(33 + i * 7 % 90) for i in range(600)))


def test_scan_of_documents(spark, edge, nothing, rows):
    assert secrets.scan(edge).count() == len(rows) and secrets.scan(nothing).count() == 0
    text = "auth: x7Kp2vQz9LmT and authorization: aaaaaaaaaaaa, password=hunter2222"
    r = secrets.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].n_assign, r[0].spans) == (1, f"value:6:18,assign:{text.index('password')}:{len(text)}")
    assert r[0].base_sha256 == hashlib.sha256(r[0].spans.split(",")[1].encode()).hexdigest()
    assert (r[1].n_assign, r[1].n_access, r[1].n_hex, r[1].spans) == (0, 0, 0, "")


# --- quality -----------------------------------------------------------------------------------


def brute_rules(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered)


def test_quality_rules(spark, edge, nothing, rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality.verdicts(edge, labels).collect()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(repr((r.doc_id, *[r[c] for c in columns])) for r in got) == sorted(repr((i, *brute_rules(t))) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    kept = quality.keep(edge, labels)
    assert kept.columns == edge.columns and {r.rules for r in kept.collect()} <= {"extra rules"}
    assert {r.doc_id for r in kept.collect()} >= {1, 2}
    assert quality.verdicts(nothing, labels).count() == 0
    unlabelled = quality.verdicts(edge, labels.limit(0)).collect()  # only the base rules decide
    assert all(r.kept == (not r.base_failed) and r.score is None for r in unlabelled)


def test_ratio_tells_junk(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEANING", 1000)  # the sample is small here
    rnd = random.Random(3)
    good = [(i, " ".join(rnd.choice(["sun", "moon", "tree", "river", "cloud", "stone"]) + str(rnd.randrange(5)) for _ in range(120))) for i in range(80)]
    junk = [(100 + i, " ".join("#" + str(rnd.randrange(500)) + "!!" for _ in range(120))) for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.verdicts(docs, labels).collect() if not r.base_failed}
    assert all(kept == (i < 100) for i, kept in got.items()) and len(got) == 100


def test_repeated_words_survive_hash_collisions(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a b c a b c d",), ("x " * 9,), ("a b",), ("a b c d e f",)], "t string")
    assert [r[0] for r in df.select(quality.repeated_words(quality.words_of(F.col("t")))).collect()] == [6, 9, 0, 0]


# --- decontamination ------------------------------------------------------------------------------


def test_common_subsequence():
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


def test_leaks_are_found_and_clean_documents_left(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.randrange(15, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "too short"), (93, say(200))]
    docs, want = [], set()
    for d in range(200):
        text = say(rnd.randrange(20, 400))
        if d % 4 == 0:
            i, item = items[rnd.choice([*range(30), 33])]
            w = item.split()
            if d % 8 == 0:  # a paraphrase: a fifth of the words are others, the end stands
                for k in rnd.sample(range(len(w) - 5), (len(w) - 5) // 5):
                    w[k] = "other"
            text = f"{text} {' '.join(w).upper()} {say(rnd.randrange(50))}"
            want.add((d, i))
        docs.append((d, text))
    docs += [(None, None), (300, ""), (301, say(3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS leaky_id", "3 AS scale")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len({d for d, _ in got})
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0
    assert decontam.clean(df, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("every", [2, 3])
def test_an_item_copied_everywhere_is_found(spark, every):
    rnd = random.Random(16)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.randrange(15, 60))) for i in range(20)]
    docs = [(d, f"{say(rnd.randrange(60, 300))} {items[4][1] if d % every == 0 else ''} {say(rnd.randrange(60))}") for d in range(150)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rows in (docs, docs[:6]):  # few documents, too
        got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
        assert got == {(d, 4) for d, _ in rows if d % every == 0}


def test_clean_judges_each_row_by_itself(spark):
    rnd = random.Random(26)
    say = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    bench = spark.createDataFrame([(i, say(30)) for i in range(5)], "item_id long, text string")
    item = bench.where("item_id = 2").first().text
    leaky = [(None, f"{say(20)} {item} {say(9)}"), (7, f"{say(40)} {item}")]
    good = [(None, say(60)), (None, say(50)), (None, None), (7, say(60)), (7, None), (8, say(60))]
    df = spark.createDataFrame(leaky + good, "doc_id long, text string").selectExpr("*", "1 AS leaky_tag")
    assert sorted((r.doc_id, r.text) for r in decontam.clean(df, bench).collect() if r.doc_id and r.text) == sorted(x for x in good if x[0] and x[1])
    assert decontam.clean(df, bench).count() == len(good)


def test_the_space_of_a_sample_keeps_the_cosine_matches_and_the_leaks(spark, small):
    docs, bench = (table(spark, small, t) for t in ("documents", "benchmark"))
    own = docs.select("doc_id", "text")
    (items,) = decontam.items_of(bench)
    weighted = decontam.features(own.select("text"), items)
    picked = least_hashed(own, "doc_id", "text", 100).selectExpr("text", f"{decontam.CORPUS} AS scale")
    space = decontam.latent_space(picked.unionByName(bench.selectExpr("text", "1.0D AS scale")), weighted)
    column = docs.select("text").toArrow().column(0).combine_chunks()
    w = words(column, lower=True)
    latent, exact = (decontam.Searcher(items, weighted, x) for x in (space, np.eye(len(weighted.hash), dtype=np.float32)))  # no reduction: the cosine itself
    want, got = (set(x.candidates(w, weighted.find(w.hash))) for x in (exact, latent))
    assert space.shape[1] < len(weighted.hash) and len(want) > 100 and len(want & got) >= 0.9 * len(want)
    found = {h[:2] for h in exact.search(column)}
    assert found and len(found & {h[:2] for h in latent.search(column)}) >= 0.9 * len(found)


# --- language model -------------------------------------------------------------------------------


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(1)
    k, size = 3, 5
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((size, k)), 0))
    texts = [rng.integers(0, size, n) for n in (1, 4, 2, 6)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = hmm.log10_likelihood(np.concatenate(texts), first, m)
    import itertools
    for t, g in zip(texts, got, strict=True):
        total = sum(m.start[p[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(m.emit[s, z] for s, z in zip(t, p, strict=True))
                    for p in itertools.product(range(k), repeat=len(t)))
        assert math.isclose(g, math.log10(total), rel_tol=1e-9)


def test_training_raises_the_likelihood(monkeypatch):
    rng = np.random.default_rng(2)
    v = hmm.Vocabulary(np.arange(6, dtype=np.uint64), np.full(6, 10), np.arange(6), 6, 70, 7, 10)
    flat = np.concatenate([np.append(rng.integers(0, 3, 8) + 3 * (i % 2), v.end) for i in range(40)])
    first = np.arange(41) * 9
    m = hmm.first_model(v, 2)
    last = -np.inf
    for _ in range(8):
        starts, moves, emits, total = hmm.expectations(flat, first, m)
        assert math.isclose(emits.sum(), len(flat), rel_tol=1e-9) and math.isclose(starts.sum(), 40, rel_tol=1e-9)
        assert math.isclose(moves.sum(), len(flat) - 40, rel_tol=1e-9)
        m = hmm.normalised(starts, moves, emits, hmm.shares(v))
        assert total > last - 5
        last = total
    monkeypatch.setattr(hmm, "PIECE", 4)
    begin, length, heads = hmm.pieces(flat, first)
    assert length.sum() == len(flat) and heads.sum() == 40 and length.max() == 4 and begin[1] == 4


def test_every_round_learns_from_every_training_text(spark, monkeypatch):
    texts = [f"w{i % 7} x{i % 11} w{i % 5}" if i % 9 else None for i in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    v = hmm.vocabulary(hmm.word_counts(df.select("text")), len(texts), 12, 20)
    flat, first, _, _ = hmm.sequences(pa.array(texts), v)
    want, models, real = hmm.first_model(v, 3), [], hmm.one_round
    monkeypatch.setattr(hmm, "one_round", lambda rows, v, m: models.append(real(rows, v, m)) or models[-1])
    hmm.trained(df, v, 3)
    assert len(models) == 14
    for got in models:
        want = hmm.normalised(*hmm.expectations(flat, first, want)[:3], hmm.shares(v))
        assert all(np.allclose(a, b, rtol=1e-3, atol=1e-6) for a, b in zip(got, want, strict=True))


def test_scores(spark, edge, nothing, rows):
    lower = {c: c + 32 for c in range(65, 91)}
    tokens = [(i, WORD.findall((t or "").translate(lower)) + [None]) for i, t in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in tokens}
    c = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = hmm.scores(edge, symbols=50, known=200).collect()
    want = sorted((repr((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens)
    have = sorted((repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)), r.base_score) for r in got)
    assert [x for x, _ in have] == [x for x, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-9) for (_, a), (_, b) in zip(have, want, strict=True))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.scores(nothing).count() == 0


def test_the_model_beats_word_frequencies_on_held_out_texts(spark):
    rnd = random.Random(11)
    topics = [[f"{c}{i}" for i in range(15)] for c in "xyz"]
    docs = [(i, " ".join(rnd.choice(topics[i % 3]) for _ in range(60))) for i in range(300)]
    got = hmm.scores(spark.createDataFrame(docs, "doc_id long, text string"), states=4).where("held_out").collect()
    assert len(got) > 10 and sum(r.score for r in got) > sum(r.base_score for r in got) + 10 * len(got)
