"""Every operator against brute force on small tables, and on awkward ones."""

import collections
import hashlib
import math
import re
import timeit
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newspulse.llm import bwt, common, decontam, exact_dedup, hashing, langid, licenses, lm, mixing, neardup, quality, queries, stages, substrings, urlfilter

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
COPY = "Alpha beta gamma, delta epsilon; zeta eta theta iota kappa " * 10
EDGES = [
    (1, COPY, "en", "b"), (2, None, None, None), (3, "", "en", "a"), (4, COPY, "de", "b"), (4, COPY, "de", "b"),
    (None, COPY, "en", None), (5, LONG, "en", "b"), (6, "one", "fr", "c"), (7, " \t\n", "en", "a"), (8, "0 1 2 !", None, "a"),
    (4, "another text of a repeated id", "en", "b"),
]
EXTRA = "label node kept score digest row f r size taken stats place __gone __leak".split()


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def on_path(operator):
    def run(docs, tmp=None):
        from newspulse.session import scratch_path

        path = scratch_path(docs.sparkSession, "edge-docs")
        docs.write.parquet(path)
        return operator(docs.sparkSession, path)

    return run


def items(spark, rows=((1, "some words that nobody else has written down before"), (2, None), (3, "short"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((1, 1), (3, 0), (5, 0), (6, None), (None, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


PER_ROW = {
    "op1": lm.score,
    "op2": on_path(exact_dedup.dedup),
    "op4": substrings.remove,
    "op5": lambda d: quality.classify(d, quality.train(d, labels(d.sparkSession))),
    "op6": langid.learn_and_identify,
    "op7": lambda d: neardup.cluster(d, 3, 85),
    "op8": licenses.scan,
    "op9": lambda d: mixing.ordered(mixing.mix(d)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_each_row_has_a_result(name, edges, empty):
    got = collections.Counter(r.doc_id for r in PER_ROW[name](edges).collect())
    assert got == collections.Counter(r[0] for r in EDGES)
    assert PER_ROW[name](empty).collect() == []


def test_leaks_on_awkward_tables(spark, edges, empty):
    assert decontam.leaks(edges, items(spark)).collect() == []
    assert decontam.leaks(empty, items(spark)).collect() == []
    assert decontam.leaks(edges, items(spark, ())).collect() == []
    hit = decontam.leaks(edges, items(spark, [(9, "Beta GAMMA delta epsilon zeta, eta theta")])).collect()
    assert collections.Counter(r.doc_id for r in hit) == collections.Counter([1, 4, 4, None])


def test_scores_equal_counted_base(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in rows}
    count = collections.Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(count.values()), len(count)
    old, lm.FREQUENT = lm.FREQUENT, 50  # so that most words take the join
    try:
        got = by_id(lm.score(documents(spark)))
    finally:
        lm.FREQUENT = old
    for i, t in texts.items():
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)


def test_model_beats_counted_ids_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = by_id(lm.score(docs))
    tokenizer = lm.Tokenizer(open(lm.VOCABULARY, "rb").read())
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    tokenizer.learn(collections.Counter(w for x in words.values() for w in x))
    ids = {i: tokenizer.ids(w) for i, w in words.items()}
    count = sum(np.bincount(x, minlength=lm.IDS) for i, x in ids.items() if not got[i].held_out) + 0.1
    share = np.log10(count / count.sum())
    out = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].score for i in out) > 0.9 * sum(share[ids[i]].sum() for i in out)


def test_frequent_ids_have_rows_of_their_own():
    row = lm.rows_by_count(np.arange(lm.IDS)[::-1])
    assert lm.DIM >= 16 and len(np.unique(row)) == lm.ROWS >= 2048 and (row[: lm.ROWS - 1] == np.arange(lm.ROWS - 1)).all()


def test_every_training_token_is_a_target(spark):
    with open(lm.VOCABULARY, "rb") as f:
        raw = f.read()
    gathered = lm.gather(documents(spark), raw).collect()
    counts = np.zeros(lm.IDS, np.int64)
    for r in gathered:
        if r.kind == lm.ID:
            counts[r.key] += r.n
    m = lm._matrix([r.ids for r in gathered if r.kind == lm.WINDOWS])
    target = m[2 * lm.HALF :]
    assert (np.bincount(target[target >= 0], minlength=lm.IDS) == counts).all()


def test_model_is_near_counted_words_on_held_out_rows(spark):
    out = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)).where("held_out").collect()
    assert sum(r.score for r in out) > 1.05 * sum(r.base_score for r in out)



def test_every_window_trains_once_at_every_size(spark, monkeypatch):
    trained = []
    monkeypatch.setattr(lm, "_round", lambda windows, w, *_: trained.extend(windows.select("key", "n").collect()) or w)
    for n in (1, 400_000):  # windows that a text says it has
        rows = [(lm.ID, 5, None, 9, None)] + [(lm.WINDOWS, k, None, n, np.arange(9, dtype=np.uint16).tobytes()) for k in range(20)]
        trained.clear()
        lm.fit(spark.createDataFrame(rows, lm.GATHERED))
        assert sorted(r.key for r in trained) == list(range(20))


def test_training_starts_from_counted_followers(spark):
    ids = [np.tile([7, 9, 11, 13], 50).astype(np.uint16), np.tile([9, 7, 13, 11], 50).astype(np.uint16)]
    rows = [(lm.ID, k, None, 100, None) for k in (7, 9, 11, 13)] + [(lm.WINDOWS, 1, None, 25, x.tobytes()) for x in ids]
    old, lm.ROUNDS = lm.ROUNDS, 0
    try:
        w, v = lm.fit(spark.createDataFrame(rows, lm.GATHERED))
    finally:
        lm.ROUNDS = old
    m = lm._matrix([ids[0].tobytes()])
    got = lm.Scorer(w, v).log10(m, np.zeros(m.shape[1], int), 1)[0]
    assert got > 0.95 * 200 * np.log10(0.25)  # the four ids are told better than without context


def test_tokenizer_pieces_give_back_the_words():
    tokenizer = lm.Tokenizer(open(lm.VOCABULARY, "rb").read())
    pieces = {int(n): p for p, n in ((lm.base64.b64decode(a), b) for a, b in map(bytes.split, open(lm.VOCABULARY, "rb")))}
    words = [b"the", "\u00a0x\u2003y".encode(), b"th" * 400, "été".encode(), b"\x00\x01", "日本".encode()]
    tokenizer.learn(dict.fromkeys(words, 1))
    for w in words:
        ids = tokenizer.ids([w])
        assert ids[-1] == lm.END and b"".join(pieces[i] for i in ids[:-1].tolist()) == b" " + w
    assert tokenizer.ids(words[:2]).tolist() == [*tokenizer.ids(words[:1])[:-1].tolist(), *tokenizer.ids(words[1:2]).tolist()]


def test_windows_ask_each_token_once():
    for n in (1, 7, 8, 9, 40):
        ids = np.arange(100, 100 + n)
        w = lm.windows_of(ids)
        target = w[2 * lm.HALF :].T.ravel()
        assert target[target >= 0].tolist() == ids.tolist()
        before = w[lm.HALF : 2 * lm.HALF].T.ravel()[:n]
        assert before.tolist() == [-2, *ids[:-1].tolist()]


def test_attention_gradient_and_mask():
    rng = np.random.default_rng(1)
    shapes = [(lm.ROWS + 2, lm.DIM), *[(lm.DIM, lm.DIM)] * 3, (2 * lm.HALF,), (lm.DIM, lm.CLASSES), (lm.CLASSES,), (lm.ROWS, lm.DIM), (lm.ROWS,)]
    w = lm.Weights(*((rng.standard_normal(s) * 0.3).astype(np.float32) for s in shapes))
    rows, classes = rng.integers(0, 50, (2 * lm.HALF, 9)), rng.integers(0, lm.ROWS, (lm.HALF, 9))
    rows[:5, 0], classes[5:, 3] = lm.PAD, -1
    flat, g = w.flat().astype(np.float64), lm.gradient(w, rows, classes)[0].flat()
    for i in np.argsort(-np.abs(g))[:10]:
        e = np.zeros_like(flat)
        e[i] = 1e-2
        ends = [lm.gradient(w.like(flat + s * e), rows, classes)[1] for s in (1, -1)]
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(g[i], rel=0.02)
    scorer = lm.Scorer(w, None)
    wanted = np.maximum(classes, 0)
    p = scorer.slots(rows, wanted)
    assert -lm.gradient(w, rows, wanted)[1] == pytest.approx(float(p.mean()), abs=1e-4)
    whole = sum(np.exp(scorer.slots(rows, np.full_like(wanted, k))) for k in range(lm.ROWS))
    assert np.allclose(whole, 1, atol=1e-3)
    # What comes after a position, and the space before a text, change nothing.
    logp = lm.forward(w, rows)[0]
    later = rows.copy()
    later[lm.HALF + 4 :] = 7
    assert np.allclose(lm.forward(w, later)[0][:4], logp[:4], atol=1e-5)
    other = lm.Weights(w.emb.copy(), *w[1:])
    other.emb[lm.PAD] = 5
    assert np.allclose(lm.forward(other, rows)[0], logp, atol=1e-5)
    assert np.allclose(np.exp(logp).sum(1), 1, atol=1e-4)


def test_training_step_costs_few_plain_passes():
    rng, n, least = np.random.default_rng(2), 128, lambda f: min(timeit.repeat(f, number=1, repeat=40))
    shapes = [(lm.ROWS + 2, lm.DIM), *[(lm.DIM, lm.DIM)] * 3, (2 * lm.HALF,), (lm.DIM, lm.CLASSES), (lm.CLASSES,), (lm.ROWS, lm.DIM), (lm.ROWS,)]
    w = lm.Weights(*((rng.standard_normal(s) * 0.3).astype(np.float32) for s in shapes))
    rows, slots = rng.integers(0, 600, (2 * lm.HALF, n)), rng.integers(0, 600, (lm.HALF, n))

    def plain(w):
        x, out = w.emb[rows].transpose(0, 2, 1), []
        k, v, q = (np.matmul(m.T, x) for m in (w.key, w.value, w.query))
        for j in range(lm.HALF, 2 * lm.HALF):
            s = (k[: j + 1] * q[j]).sum(1) / np.float32(lm.DIM**0.5) + w.near[j::-1][: j + 1, None]
            s = np.exp(s - s.max(0))
            z = w.out.T @ (x[j] + (s[:, None] * v[: j + 1]).sum(0) / s.sum(0)) + w.bias[:, None]
            out.append(z - z.max(0) - np.log(np.exp(z - z.max(0)).sum(0)))
        return np.stack(out)

    assert np.allclose(lm.forward(w, rows)[0], plain(w), atol=1e-4)
    far = w._replace(out=w.out * 300, query=w.query * 300)  # exponentials that leave their range
    assert np.allclose(lm.forward(far, rows)[0], plain(far), rtol=1e-3, atol=1e-1)
    assert least(lambda: lm.gradient(w, rows, slots)) < 3.2 * least(lambda: plain(w))


def test_dedup_checks_bytes_of_colliding_digests(spark, tmp_path):
    rows = [(1, "aa"), (2, "ab"), (3, "aa"), (4, None), (5, ""), (6, "b"), (7, "ab"), (8, "ac")]
    for part in range(2):
        spark.createDataFrame(rows[part::2], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/d")
    first_letter = lambda text: F.substring(text, 1, 1)
    for options in ({}, {"digest": first_letter}, {"files_per_batch": 1}):
        got = by_id(exact_dedup.dedup(spark, f"file://{tmp_path}/d", **options))
        for i, t in rows:
            group = [j for j, u in rows if (u or "") == (t or "")]
            sha = hashlib.sha256((t or "").encode()).hexdigest()
            assert tuple(got[i]) == (i, max(group), len(group), i == max(group), sha), options


def test_dropping_copies_keeps_one_row_with_all_columns(spark, edges):
    left = exact_dedup.drop_copies(spark, edges)
    assert left.columns == edges.columns
    assert collections.Counter(r.text or "" for r in left.collect()) == collections.Counter({r[1] or "" for r in EDGES})


def test_leaks_equal_search_of_all_items(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    texts = [(r.doc_id, f" {words(r.text)} ") for r in documents(spark).collect()]
    want = {(i, b.item_id) for b in bench.collect() for i, t in texts if f" {words(b.text)} " in t}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents(spark), bench).collect()}
    assert len(want & got) >= 0.9 * len(want) and got == want


def test_paraphrases_need_their_answer(spark):
    item = [f"w{i}" for i in range(40)]
    filler = [f"z{i}" for i in range(300)]
    changed = [w if i % 3 or i > 34 else f"x{i}" for i, w in enumerate(item)]
    no_answer = changed[:35] + ["other"] * 5
    docs = spark.createDataFrame(
        [(1, " ".join(filler + item + filler)), (2, " ".join(filler + changed + filler)), (3, " ".join(filler + no_answer)), (4, " ".join(filler))],
        "doc_id long, text string")
    got = by_id(decontam.leaks(docs, items(spark, [(1, " ".join(item))])))
    assert set(got) == {1, 2} and got[2].answer_found and got[1].lcs_share == 1


def test_leaks_find_verbatim_items_of_large_benchmarks(spark):
    rng = np.random.default_rng(5)
    texts = [decontam.words_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    texts = [[w.decode("utf-8", "replace") for w in t] for t in texts if len(t) > 80]
    cuts = [(int(t), int(rng.integers(len(texts[t]) - 38))) for t in rng.integers(200, len(texts), 2000)]
    bench = [(i, " ".join(texts[t][a : a + 38])) for i, (t, a) in enumerate(cuts)]
    docs = [(k, " ".join([*texts[k][:40], bench[k][1], *texts[k][40:]])) for k in range(200)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), items(spark, bench)).collect()
    assert {(k, k) for k in range(200)} <= {(r.doc_id, r.item_id) for r in got if r.lcs_share == 1}


def test_latent_search_leads(spark):
    """What the cosine finds alone is all but the items shorter than a window; without it these are all that is left."""
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    long = {r.item_id for r in bench.collect() if len(decontam.words_of(r.text)) >= decontam.BLOCK}
    pairs = lambda **how: {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, **how).collect()}
    found = pairs()
    assert found and pairs(exact=False) == {x for x in found if x[1] in long}
    assert pairs(cosine=10.0) == {x for x in found if x[1] not in long} != found


@pytest.mark.parametrize("changed", [0.0, 0.4])
def test_latent_search_alone_finds_edited_items(spark, changed):
    rng = np.random.default_rng(7)
    around = [decontam.words_of(r.text) for r in documents(spark).orderBy("doc_id").collect()]
    around = [[w.decode("utf-8", "replace") for w in t] for t in around if len(t) > 80]
    rows = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()
    bench = [(r.item_id, " ".join(w.decode() for w in decontam.words_of(r.text))) for r in rows]
    docs = []
    for k, (i, text) in enumerate(bench):
        w, t, other = text.split(), around[k % len(around)], around[(7 * k + 1) % len(around)]
        for at in rng.choice(len(w) - 5, int(changed * len(w)), replace=False):
            w[at] = other[int(rng.integers(len(other)))]
        docs.append((i, " ".join([*t[: 60 + k % 16], *w, *t[60 + k % 16 :]])))
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), items(spark, bench), exact=False)
    assert len({r.doc_id for r in got.collect() if r.doc_id == r.item_id}) >= 0.95 * len(bench)


def test_texts_searched_together_keep_apart(monkeypatch):
    """Each text has the leaks that it has alone, none across two texts, and a batch sums its words in few steps."""
    words = [[f"b{i}x{k}".encode() for k in range(40)] for i in range(6)]
    checks = [(i, decontam.Item(w, w[-5:]), w) for i, w in enumerate([*words, [b"t1", b"t2", b"t3", b"t4", b"t5", b"t6", b"t7"]])]
    idf, place = np.ones(decontam.FEATURES, np.float32), np.full(decontam.FEATURES, -1, np.int32)
    features = np.unique(np.concatenate([decontam.features_of(w) for *_, w in checks]))
    place[features] = np.arange(len(features))
    rows = np.zeros((len(checks), len(features)), np.float32)
    for i, (*_, w) in enumerate(checks):
        f, v = decontam.weigh([x.decode() for x in w], idf)
        rows[i, np.searchsorted(features, f)] = v
    texts = [[b"o%d" % n, b"p", *words[n % 6][: 40 - n % 25], *([b"q"] * (n % 20))] for n in range(120)]
    texts += [words[0][:20], words[0][20:], [b"t1", b"t2", b"t3"], [b"t4", b"t5", b"t6", b"t7"], checks[6][2]]
    for rank in (7, 5):  # all passages, and too few dimensions for them
        space = np.ascontiguousarray(np.linalg.svd(rows, full_matrices=False)[2][:rank].T)
        latent, rest = decontam.routes_of(checks, idf, features, space)
        gates = decontam.gates_of([(k, checks[k][1]) for k in rest], place, len(features), idf)
        rest_of = (latent, place, idf, [c[:2] for c in checks], rest, gates, decontam.COSINE)
        alone = [(i, hit[0], *hit[2:]) for i, t in enumerate(texts) for _, hit in decontam.of_documents([t], *rest_of)]
        steps, take = [], np.take
        monkeypatch.setattr(np, "take", lambda *a, **k: steps.append(1) or take(*a, **k))
        together = [(i, hit[0], *hit[2:]) for i, hit in decontam.of_documents(texts, *rest_of)]
        monkeypatch.undo()
        assert together == alone and len(steps) < len(texts)
        assert {i for i, *_ in together} >= {0, 1, 2, 124} and not {i for i, *_ in together} & {120, 121, 122, 123}


def test_large_benchmarks_take_both_ways(spark):
    """A space of rank 8 can't hold 60 unlike items; those it loses are found by their rarest words."""
    bench = [(i, " ".join(f"i{i}x{k}" for k in range(30))) for i in range(60)]
    docs = spark.createDataFrame([(i, f"before that {text} and after") for i, text in bench], "doc_id long, text string")
    pairs = lambda **how: {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items(spark, bench), rank=8, **how).collect()}
    assert pairs() == {(i, i) for i in range(60)} > pairs(exact=False)


def test_leaking_rows_go_whatever_their_id(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, "clean text"), (1, f"some {item} here"), (None, f"other {item}"), (None, "clean"), (2, None), (2, "")], "doc_id long, text string")
    left = decontam.drop_leaks(docs, items(spark, [(1, item), (None, "clean text"), (3, None)])).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("1", "clean text"), ("2", ""), ("2", "None"), ("None", "clean")]


def test_leaks_find_short_and_edited_items(spark):
    rng = np.random.default_rng(6)
    rare = iter(f"r{i}" for i in range(100_000))
    around = lambda words: " ".join([*(next(rare) for _ in range(80)), *words, *(next(rare) for _ in range(80))])
    short = {n: [f"c{n}x{i}" for i in range(n)] for n in range(1, 13)}
    edited = {100 + k: [f"e{k}x{i}" for i in range(40)] for k in range(30)}
    docs = [(n, around(w)) for n, w in short.items()] + [(1000 + n, " ".join(w)) for n, w in short.items()]
    for k, w in edited.items():
        gone = set(rng.choice(35, 16, replace=False).tolist())
        docs.append((k, around([next(rare) if i in gone else x for i, x in enumerate(w)])))
    docs += [(500 + n, around(short[n][:-1] + ["other"] + short[n][-1:])) for n in range(2, 6)]
    # The words of the items are common elsewhere, so rarer words surround them.
    docs += [(5000, " ".join(w[::-1])) for w in [*short.values(), *edited.values()] for _ in range(3) if len(w) > 1]
    bench = [(i, " ".join(w)) for i, w in {**short, **edited}.items()]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), items(spark, bench)).collect()}
    assert got == {(i, i) for i in [*short, *edited]} | {(1000 + i, i) for i in short}


def test_subsequence_length():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = ([bytes([c]) for c in rng.integers(97, 101, n)] for n in (9, 14))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontam.Item(a, []).common(b) == table[-1, -1]


@pytest.mark.parametrize("large", [substrings.LARGE, 3000])
def test_removal_equals_brute_force(spark, large):
    rng = np.random.default_rng(2)
    passage = bytes(rng.integers(97, 123, 700)).decode()
    rows = [(i, "".join(chr(c) for c in rng.integers(97, 123, 300)) + passage[i % 7 : 690] + f"é{i}" * 40) for i in range(30)]
    rows += [(100, "a" * 1500), (101, "b" * 399), (102, "ab" * 450), (103, None), (104, rows[3][1]), (105, "\x00" * 500)]
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[k : k + 400] for b in raw.values() for k in range(len(b) - 399))
    got = by_id(substrings.remove(spark.createDataFrame(rows, "doc_id long, text string"), large=large))
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((gone[1:] > gone[:-1]).sum() + gone[0])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), len(b) - len(left), runs), i
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()


def test_interval_expansion_gives_common_prefixes():
    rng = np.random.default_rng(4)
    for n, least in ((60, 3), (200, 5), (300, 9)):
        text = np.concatenate([rng.integers(1, 3, n), [1, 2, 1, 2] * 5, [0]]).astype(np.uint16)
        order, shared = bwt.long_prefixes(text, least)
        whole = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        prefix = lambda a, b: next((k for k in range(len(text)) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 0)
        want = [False] + [prefix(a, b) >= least for a, b in zip(whole, whole[1:], strict=False)]
        assert shared.tolist() == want and sorted(order.tolist()) == list(range(len(text)))


def test_quality_rules_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op5_rule_ensemble_quality"](spark, "/root/testdata/sf0.01").collect()}
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    out = [(got[r.doc_id].predicted, r.quality) for r in truth if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in truth)
    assert np.mean([p == y for p, y in out]) > 0.97
    assert len({r.score for r in got.values()}) > 2


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random((300, len(quality.STATS)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] <= 0.7)).astype(float)
    model = quality.fit(x, y)
    assert model.rules and model == quality.fit(x, y)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, s array<double>")
    got = np.array([r.p for r in df.select("i", quality.score(model, F.col("s")).alias("p")).orderBy("i").collect()])
    raw = model.bias + sum(r.weight * quality._holds(x, r.parts) for r in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-raw))) and np.mean((got >= 0.5) == y) > 0.95
    assert quality.fit(x[:0], y[:0]).rules == () and quality.fit(x, np.ones(300)).bias > 0


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.learn_and_identify(docs).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_profiles_equal_counting(spark, edges):
    rows = [("en", "The cat. the"), ("en", None), ("fr", "été"), (None, "xx")]
    got = langid.fit_profiles(spark.createDataFrame(rows, "lang string, text string"), 5).collect()
    want = {}
    for lang in ("en", "fr"):
        n = collections.Counter()
        for t in (t or "" for k, t in rows if k == lang):
            s = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " ")
            n.update(g for k in (1, 2, 3) for g in (s[i : i + k] for i in range(len(s) - k + 1)) if g != " " and not (k == 3 and g[1] == " "))
        n.pop("  ", None)
        pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        want[lang] = [k for k, _ in sorted(((pack(g), c) for g, c in n.items()), key=lambda p: (-p[1], p[0]))][:5]
    assert {k: [r.gram for r in sorted(got, key=lambda r: r.rank) if r.lang == k] for k in want} == want
    undetermined = {r.doc_id for r in langid.learn_and_identify(edges).collect() if r.lang_pred == "und"}
    assert undetermined == {2, 3, 7, 8}


def _shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_copies_equal_all_pairs(spark, k, percent):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    for i in range(60):  # a group of different near-copies, some linked through others only
        own = list(base)
        for at in rng.choice(120, size=i % 9, replace=False):
            own[at] = f"v{i}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000, "two words"), (2001, "Two  words"), (2002, "one"), (2003, None)]
    sets = {i: _shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = by_id(neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), k, percent))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_groups_run_across_batches():
    import pandas as pd

    rows = pd.DataFrame({"a": [1, 1, 2, 2, 2, 3], "b": range(6)})
    for cut in ([rows], [rows[:1], rows[1:3], rows[:0], rows[3:4], rows[4:]]):
        assert [g["b"].tolist() for g in neardup._groups(iter(cut), ["a"])] == [[0, 1], [2, 3, 4], [5]]


@pytest.mark.parametrize("chunk", [1024, 4])
def test_residual_links_join_what_is_near(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    rows, sets = [], {}
    for i in range(40):  # a chain: each differs from the one before in a few shingles
        own = base.copy()
        own[: 2 * i] = rng.integers(0, 2**63, 2 * i).astype(np.uint64) if i % 10 == 0 else own[: 2 * i]
        base = own if i % 10 == 0 else np.concatenate([rng.integers(0, 2**63, 4).astype(np.uint64), own[:-4]])
        sets[i] = np.unique(own)
        label = 0 if i < 12 else i
        rows.append((i % 1, bytes([i]), bytes([label]), neardup.signature(sets[i]).tobytes(), sets[i].tobytes()))
    schema = "area int, node binary, label binary, sig binary, shingles binary"
    got = neardup.residual_links(spark.createDataFrame(rows, schema), 85).collect()
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))}
    links = [(r.a[0], r.b[0]) for r in got]
    assert set(links) <= near and len(links) <= 3 * len(rows)

    def parts(pairs):
        of = {i: 0 if i < 12 else i for i in sets}
        for _ in sets:
            for a, b in pairs:
                low, high = sorted((of[a], of[b]))
                of = {i: low if v == high else v for i, v in of.items()}
        return of

    assert parts(links) == parts(near)


def test_license_places_and_suppression(spark):
    text = "Licensed under the Apache-License, version 2.0. CC BY CC  BY-NC 4.0; mit license. GNU General Public License gnu lesser general public license"
    r = licenses.scan(spark.createDataFrame([(1, text), (2, "mit licenses, amit license")], "doc_id long, text string")).collect()
    one, two = sorted(r, key=lambda x: x.doc_id)
    assert (one.n_words, one.n_base, one.first_word, one.last_word) == (26, 5, 3, 17)
    assert one.base_labels == "apache,cc-by,gpl,mit" and set("apache,cc-by,cc-by-nc,gpl,lgpl,mit".split(",")) <= set(one.labels.split(","))
    assert (two.n_base, two.first_word, two.base_labels) == (0, None, "")
    assert len(licenses.rules()) > 200
    assert all(re.search(re.escape(x.keyword.encode()), b"") is None and x.keyword for x in licenses.rules())
    kept = licenses.suppress([(0, 9, 1, "a"), (2, 5, 3, "b"), (3, 5, 1, "c"), (0, 4, 2, "d"), (0, 4, 2, "d")])
    assert kept == [(0, 4, 2, "d"), (0, 9, 1, "a"), (2, 5, 3, "b")]


def test_license_clauses_and_names_in_other_use():
    found = lambda text: {d[3] for d in licenses.detections(text.encode())}
    assert found("unauthorised copying of this file is strictly prohibited") == {"proprietary"}
    assert found("provided by the authors as is without any express") == {"warranty-disclaimer"}
    assert found("the apache helicopter landed at the afl final near the osl hall") == set()
    assert found("licensed under the afl") == found("spdx license identifier afl 2 0") == found("afl licensed code") == {"afl"}
    assert found("apache 2 0") == found("apache license") == found("the license is apache") == {"apache"}


def test_keywords_stand_in_all_that_their_rules_find():
    """A rule's matches, with every alternative and option taken in turn, hold its keyword."""
    for r in licenses.rules():
        if r.pattern.startswith("either version"):  # the words of several licenses: only next to this one's name
            continue
        for text in samples(r.pattern):
            assert re.fullmatch(r.pattern, text), (r, text)
            assert r.keyword in text, (r, text)


def samples(pattern):
    """Texts that a pattern of literals, groups, classes and options finds, each choice made at least once."""
    from re import _parser as parser

    def walk(items, pick):
        out = ""
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                out += chr(value)
            elif name == "ANY":
                out += "x"
            elif name == "IN":
                what, given = value[pick % len(value)]
                out += chr(given if str(what) == "LITERAL" else given[0] if str(what) == "RANGE" else ord("1"))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = value
                out += walk(inner, pick) * max(low, min(int(high), pick % 2))
            elif name == "SUBPATTERN":
                out += walk(value[-1], pick)
            elif name == "BRANCH":
                out += walk(value[1][pick // 2 % len(value[1])], pick)
            else:
                raise ValueError(name)
        return out

    parsed = parser.parse(pattern)
    return {walk(parsed, pick) for pick in range(24)}


def test_base_places_equal_word_search(spark):
    got = by_id(licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.encode().lower())
        at = [(i, k) for p, k in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == [w.encode() for w in p.split()]]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.base_labels) == (len(words), len(at), ",".join(sorted({k for _, k in at})))
        assert (g.first_word, g.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))


def test_mixture_meets_targets(spark, edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(3)).collect())
    sizes = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == sizes
    per = collections.defaultdict(int)
    for r in rows:
        per[r.source] += r.size
    names, total = sorted(per), sum(per.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    while free:  # deal out, cap, reshare
        left = total - sum(3 * per[s] for s in names if s not in free)
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * per[s]}
        if not over:
            break
        free -= over
    for s in names:
        target[s] = level * weight[s] if s in free else 3 * per[s]
    for r in rows:
        assert r.source_size == per[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
    for s in names:
        assert sum(r.taken for r in rows if r.source == s) == round(target[s])
    assert {r.source for r in mixing.mix(edges).collect()} == {"a", "b", "c", None}


def test_schedule_inversion(spark):
    for knots in mixing.SCHEDULES:
        t = np.linspace(0, 1, 41)
        w = np.interp(t, *zip(*knots, strict=True))
        fine = np.linspace(0, 1, 20_001)
        area = np.concatenate([[0], np.cumsum(np.diff(fine) * (np.interp(fine, *zip(*knots, strict=True))[1:] + np.interp(fine, *zip(*knots, strict=True))[:-1]) / 2)])
        share = np.interp(t, fine, area / area[-1])
        df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(share)], "i int, s double")
        got = [r.t for r in df.select("i", mixing.time_of(F.col("s"), knots).alias("t")).orderBy("i").collect()]
        assert np.allclose(got, t, atol=1e-3) and len(w) == 41


def test_url_parts_rules_and_rows(spark):
    rows = [
        (1, "https://A.Example.NET/en/5?x=/#y"), (2, "http://x.net"), (3, None), (4, "nothing"), (5, "ftp://example.com/de/"),
        (6, "http://org/fr/1"), (7, "http://notexample.com/de/1"), (8, "http://b.org/FR/1"), (9, "http://c.net?a/b"), (1, "https://A.Example.NET/en/5?x=/#y"),
        (None, "http://deep.org/" + "/".join("abcdefghij")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "rule", "label", "t", "n")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert urlfilter.judge(pages).count() == len(rows)
    assert got[1] == ("a.example.net", "/en/5", "example.net/en/", "allow")
    assert got[2][:3] == ("x.net", "", None) and got[3][:3] == ("", "", None) == got[4][:3]
    assert got[5] == ("example.com", "/de/", "example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][2] is None and got[8][2] is None and got[9][:3] == ("c.net", "", None)
    assert urlfilter.judge(pages.limit(0)).collect() == []


def test_url_templates_generalise_merge_and_reject(spark):
    rules = [("block", "spam.com/a/"), ("allow", "spam.com/ok/")]
    urls = [f"http://spam.com/{d}/{i}" for d in "ab" for i in range(40 if d == "a" else 4)]
    urls += [f"http://good.com/n{i}x/page" for i in range(200)] + ["http://good.com/about/page"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {u: r for u, r in zip(urls, sorted(urlfilter.judge(pages, rules).collect()), strict=True)}
    assert got["http://spam.com/b/1"].template == "/~/{num}" and got["http://spam.com/b/1"].verdict == "block"
    assert got["http://good.com/n7x/page"].verdict == "allow"
    assert {got[u].template for u in urls if "good" in u} <= {"/*/page", "/about/page", "/~/page"}


def test_url_rows_equal_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op10_url_templates"](spark, "/root/testdata/sf0.01").collect()}
    for p in pages.select("page_id", "url").collect():
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", p.url).groups()
        fits = [(len(t), t, v) for v, t in urlfilter.RULES for h, _, x in [t.partition("/")]
                if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith("/" + x)]
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host.lower(), path, max(fits)[1] if fits else None)
        assert not fits or r.verdict == max(fits)[2]


@pytest.mark.parametrize("stage", ["keep_quality", "drop_copies", "drop_near_copies", "drop_leaks"])
def test_stages_keep_columns(spark, edges, empty, stage):
    run = getattr(stages, stage)
    for docs in (edges, empty):
        out = run(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()


def test_dedup_query_equals_its_sql(spark):
    import oracle_check

    con = oracle_check.connect("/root/testdata/sf0.01")
    name = "op2_stateful_dedup"
    assert oracle_check.compare(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), con, queries.ORACLES[name]) is None


def test_near_copies_are_sought_in_small_batches(spark):
    """Wide rows come few at a time while the step runs, and tables of powers are kept once."""
    key, sizes = common.ARROW_ROWS, "rows long"
    docs = spark.range(5000).repartition(1)

    def seen(frames):
        for f in frames:
            yield pd.DataFrame({"rows": [len(f)]})

    before = spark.conf.get(key)
    with common.rows_at_once(spark, neardup.ROWS_AT_ONCE):
        assert max(r.rows for r in docs.mapInPandas(seen, sizes).collect()) <= neardup.ROWS_AT_ONCE
    assert spark.conf.get(key) == before
    assert neardup.cluster(frame(spark, EDGES)).count() == len(EDGES) and spark.conf.get(key) == before
    long, short = hashing._powers(1 << 14), hashing._powers(1 << 12)
    assert np.shares_memory(long[0], short[0]) and np.shares_memory(long[1], short[1])


def test_suffixes_that_are_told_apart_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(3)
    copy = rng.integers(1, 250, 500)
    text = np.concatenate([copy, rng.integers(1, 250, 9000), copy, [0]]).astype(np.uint16)
    sorted_so_far, argsort = [], np.argsort
    monkeypatch.setattr(bwt.np, "argsort", lambda a, **kw: (sorted_so_far.append(len(a)), argsort(a, **kw))[1])
    order, shared = bwt.long_prefixes(text, 400)
    raw = [text[k:].tolist() for k in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=raw.__getitem__)
    assert sum(shared) == 101 and all(raw[order[k]][:400] == raw[order[k - 1]][:400] for k in np.flatnonzero(shared))
    assert sum(sorted_so_far) < 4 * len(text)
