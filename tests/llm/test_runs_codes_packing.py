"""Periodic runs, vector codes and packing against brute force."""

import collections
import hashlib
import os
import zlib

import numpy as np
import oracle_check
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from newspulse.llm import packing, periodic, queries, vectorcodes

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark, rows):
    """Rows (doc_id, text) with other columns of names the operators use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in "row n runs tiles plain q lo hi length start period piece rank bucket ids offset lang".split()})


# --- Periodic runs ---------------------------------------------------------------


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_runs(words):
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    out = []
    for q in range(1, len(ids) // 3 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]]).astype(int)
        lo, hi = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(lo.tolist(), hi.tolist()):
            if b - a + q >= max(24, 3 * q) and not any(q % d == 0 and (ids[a : a + q - d] == ids[a + d : a + q]).all() for d in range(1, q)):
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, planting=True):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    words = plant(doc_id, words) if planting else words
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = (None,) * 4
    for s, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def key(row):
    return tuple((x is None, x) for x in row)


def test_runs_of_all_documents(spark):
    got = [tuple(r) for r in queries.QUERIES["op11_scale_tiled_runs"](spark, SF).collect()]
    want = [brute_row(r.doc_id, r.text) for r in documents(spark).collect()]
    assert sum(r[1] > 0 for r in want) > 10
    assert sorted(got, key=key) == sorted(want, key=key)


def periodic_cases():
    rng = np.random.default_rng(5)
    word = lambda k: [f"w{i}" for i in rng.integers(0, 10**6, k)]
    yield from (None, "", " \t\n", "one", "a b " * 12, "a b " * 11 + "a", "x " * 23, "x " * 24, "x " * 5000)
    for q in (1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100):
        for extra in (-1, 0, 1, q // 2, 2 * q + 1):
            block, n = word(q), max(24, 3 * q) + extra
            yield " ".join(word(int(rng.integers(0, 40))) + [block[i % q] for i in range(n)] + word(int(rng.integers(0, 40))))
    for _ in range(60):  # few different words: many runs, of powers and of overlapping periods
        yield " ".join(map(str, rng.integers(0, 2, 300)))
        block = list(map(str, rng.integers(0, 2, int(rng.integers(2, 12)))))
        yield " ".join((block * 40)[: int(rng.integers(30, 200))] + (block[::-1] * 40)[: int(rng.integers(30, 200))])
    a, b = "a", ["a"]
    for _ in range(12):  # Fibonacci words
        a, b = b if isinstance(b, list) else [b], (b if isinstance(b, list) else [b]) + (a if isinstance(a, list) else [a])
    yield " ".join("xy"[w == "a"] for w in b[:2000])
    yield " ".join(["a"] * 30 + ["b"] + ["a"] * 100 + ["c"] + ["a"] * 30)


def test_runs_of_made_texts(spark):
    rows = [(k, t) for k, t in enumerate(periodic_cases())] + [(None, "y z " * 30), (7, "repeated id " * 20), (7, "repeated id " * 20)]
    got = [tuple(r) for r in periodic.digest(periodic.collapse(texts(spark, rows))).collect()]
    want = [brute_row(i, t, False) for i, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_collapsed_text_and_spans(spark):
    rows = periodic.collapse(texts(spark, [(1, "start " + "a b c " * 10 + "end"), (2, "nothing here")])).collect()
    by = {r.doc_id: r for r in rows}
    assert bytes(by[1].text) == b"start a b c end" and [tuple(x) for x in by[1].runs] == [(1, 30, 3)]
    assert by[2].text is None and by[2].runs == [] and by[2].n_words == 2


def test_z_function_and_tables_without_rows(spark):
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.integers(0, 2, 30).tolist()
        assert periodic.z_function(s) == [next((k for k in range(30 - i) if s[k] != s[i + k]), 30 - i) for i in range(30)]
    assert periodic.digest(periodic.collapse(texts(spark, []))).collect() == []


# --- Vector codes ------------------------------------------------------------------


def test_codes_equal_sql(spark):
    con = oracle_check.connect("/root/testdata/sf0.01")
    name = "op12_gnat_codes"
    assert oracle_check.compare(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), con, queries.ORACLES[name]) is None


def test_gnat_finds_the_nearest_entry_with_ties():
    rng = np.random.default_rng(2)
    for entries, width, spread in ((1, 3, 9), (16, 8, 3), (16, 2, 2), (200, 4, 50), (300, 1, 10), (40, 8, 1 << 27)):
        e = rng.integers(-spread, spread + 1, (entries, width))
        q = rng.integers(-spread, spread + 1, (500, width))
        d = ((q[:, None] - e[None]) ** 2).sum(axis=2)
        index, best = vectorcodes.Gnat(e).nearest(q)
        assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()


def test_gnat_leaves_whole_children_out(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(-100_000, 100_000, (16, 8))
    e = np.concatenate([centres + rng.integers(-50, 50, centres.shape) for _ in range(16)])
    q = centres[rng.integers(0, 16, 400)] + rng.integers(-50, 50, (400, 8))
    asked = []
    plain = vectorcodes.Gnat._squares
    tree = vectorcodes.Gnat(e)
    monkeypatch.setattr(vectorcodes.Gnat, "_squares", lambda self, a, b: asked.append(len(a)) or plain(self, a, b))
    index, _ = tree.nearest(q)
    assert (index == ((q[:, None] - e[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(asked) < 0.3 * len(q) * len(e)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("x") for c in "v code error at s of n".split()})


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5] * 8, 1), (1, [0.25] * 8, None), (1, [0.25] * 8, None), (None, [-0.1] * 8, 1), (2, None, 1), (3, [nan] * 8, 1),
            (4, [inf] * 8, 1), (6, [None] + [0.0] * 7, 1), (7, [0.0] * 16, 1), (8, [0.0] * 3, 2), (9, [], 2), (10, [1e30] * 8, 3)]
    got = vectorcodes.compress(vectors(spark, rows)).collect()
    assert collections.Counter(r.vec_id for r in got) == {1: 2, 5: 1, None: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    by = {r.vec_id: r for r in got}
    assert by[7].code is None and by[8].error is None and by[8].label_error is None and by[10].code is not None
    assert by[1].label_error == 2 * by[1].error and by[5].label_error == by[5].error + by[None].error
    assert len({r.codebooks_sha256 for r in got}) == 1
    assert vectorcodes.compress(vectors(spark, [])).collect() == []
    assert [r.code for r in vectorcodes.compress(vectors(spark, [(1, [], 1), (2, None, 2)])).collect()] == [None]


def test_means_are_rounded_down(spark):
    rows = [(k, [x / 4096] * 8, 0) for k, x in enumerate((-3, 3, -4, -4, 5))]
    ints = vectorcodes.integers(vectors(spark, rows))
    books = vectorcodes.train(ints, parts=8, entries=2, rounds=1)
    assert books[0].tolist() == [[-4], [4]]  # floor(-11 / 3) and 8 / 2


# --- Packing -------------------------------------------------------------------------


def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def reference_ids(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [0] for e in t.encode_batch([r or "" for r in rows], add_special_tokens=False)]


def check_packing(rows, got, capacity):
    """Every token of every document is in one place, sequences have no gap and aren't too long."""
    want = collections.Counter()
    for doc_id, ids in rows:
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_all_documents(spark):
    docs = documents(spark).collect()
    ids = reference_ids([r.text for r in docs])
    got = queries.QUERIES["op13_pattern_packing"](spark, SF).collect()
    n = check_packing([(r.doc_id, i) for r, i in zip(docs, ids, strict=True)], got, 2048)
    assert n <= 1.01 * sum(map(len, ids)) / 2048 + 1


ODD = ["dogs' it's I'LL '''s <|endoftext|> a<|startoftext|>b", "İΣΑΣ ΑΣ éa ́x a b\x1cc\x85d 12ab3 ...'s' can't.", "_a_ 한글이 한 abc̀ don't), x",
       "ab's. ab'S. x.y.z..", None, "", "word " * 3000, "A" * 9000, " \t\n"]


def test_packing_of_awkward_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    ids = reference_ids([t for _, t in rows])
    for capacity in (2048, 7):
        got = packing.pack(texts(spark, rows), vocabulary(), capacity).collect()
        check_packing([(r[0], i) for r, i in zip(rows, ids, strict=True)], got, capacity)
    whole = packing.pack(texts(spark, rows), vocabulary(), 64, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in whole)
    assert packing.pack(texts(spark, []), vocabulary()).collect() == []


def used(groups):
    out = collections.Counter()
    for parts, m in groups:
        for n, t in parts:
            out[n] += m * t
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 100, 512]))
    hist = np.zeros(capacity + 1, np.int64)
    for n in rng.integers(1, capacity + 1, int(rng.integers(0, 60))):
        hist[n] += int(rng.choice([1, 7, 10**6, 10**10]))
    for groups in (packing.plan(hist, capacity), packing.best_fit(hist, capacity)):
        assert used(groups) == {n: c for n, c in enumerate(hist.tolist()) if c}
        assert all(sum(n * t for n, t in parts) <= capacity for parts, _ in groups)


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(9)
    for _ in range(30):
        lengths = sorted(rng.integers(1, 101, 80).tolist(), reverse=True)
        room = []
        for n in lengths:
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else 100) - n)
        assert sum(m for _, m in packing.best_fit(np.bincount(lengths, minlength=101), 100)) == len(room)


def test_patterns_and_their_fit():
    ways = packing.patterns(np.array([2, 3, 5, 8, 10]), 10)
    assert {tuple(w) for w in ways.tolist()} == {(0, 0, 10), (0, 2, 8), (0, 5, 5), (2, 3, 5)}
    hist = np.zeros(11, np.int64)
    hist[[2, 3, 5, 8, 10]] = 7, 3, 9, 4, 2  # twice 10, four times 2+8, three times 2+3+5 and 5+5
    x = {tuple(w): n for w, n in zip(ways.tolist(), packing.fit(hist, ways, 5000), strict=True)}
    assert all(abs(x[w] - n) < 0.01 for w, n in {(0, 0, 10): 2, (0, 2, 8): 4, (2, 3, 5): 3, (0, 5, 5): 3}.items())
    assert sum(m for _, m in packing.plan(hist, 10)) == 12


def test_accented_words_are_encoded_together_and_frequent_ones_kept(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 2000)
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        known = packing.WordIds(f.read())
    letters = [c for c in map(chr, range(0xC0, 0x480)) if packing._LETTERS.fullmatch(c.encode())]
    words = [x.encode() for c in letters for x in (c, "a" + c + "b", c + "'", c + c + "...")]
    asked, encode = [], known.encode
    known.encode = lambda texts, **kw: (asked.append(len(texts)), encode(texts, **kw))[1]
    known.learn(set(words))
    assert sum(asked) < 20
    alone = encode([w.decode() for w in words], add_special_tokens=False)
    assert all(known.known[w] == np.array(e.ids, "<u4").tobytes() for w, e in zip(words, alone, strict=True))
    often = set(words[:100])
    known.learn(often)
    known.learn({b"x%d" % k for k in range(10)})
    assert often <= known.known.keys() and len(known.known) < 200
