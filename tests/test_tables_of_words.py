"""Segmentation by a dictionary table and scores by a lexicon table."""

import itertools
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from newspulse.operators import lexicon, segment

KOREAN = [
    ("영업", "NNG", 10), ("이익", "NNG", 10), ("영업이익", "NNG", 12), ("이", "JKS", 6), ("가", "JKS", 6), ("은", "JX", 6), ("증가", "NNG", 10),
    ("하", "XSV", 5), ("했다", "EP", 8), ("삼성", "NNP", 10), ("전자", "NNG", 10), ("삼성전자", "NNP", 12), ("것", "NNB", 5), ("이것", "NP", 9),
]


def brute(run, entries, unknown=segment.UNKNOWN_COST):
    """The least (cost, pieces, starts from the last piece on) over all ways through a run."""
    known = {}
    for word, tag, cost in entries:
        known[word] = min(known.get(word, (cost, tag)), (cost, tag))
    n, best = len(run), None
    for marks in itertools.product((0, 1), repeat=n - 1):
        at = [0, *[i + 1 for i, m in enumerate(marks) if m], n]
        pieces = list(zip(at, at[1:], strict=False))
        costs = [known[run[i:j]][0] if run[i:j] in known else unknown if j == i + 1 else None for i, j in pieces]
        if None not in costs:
            way = (sum(costs), len(pieces), [i for i, _ in pieces][::-1])
            best = way if best is None or way < best else best
    return best


def measured(run, pieces, entries, unknown=segment.UNKNOWN_COST):
    known = {}
    for word, _, cost in entries:
        known[word] = min(known.get(word, cost), cost)
    cost, starts = 0, []
    for i, j, tag in pieces:
        if tag == segment.UNKNOWN_TAG:
            cost, starts = cost + unknown * (j - i), starts + list(range(i, j))
        else:
            cost, starts = cost + known[run[i:j]], [*starts, i]
    return cost, len(starts), starts[::-1]


def test_cut_is_the_cheapest_way_with_ties():
    rng = random.Random(4)
    for _ in range(300):
        entries = [("".join(rng.choices("ab", k=rng.randint(1, 4))), rng.choice("XYZ"), rng.randint(1, 6)) for _ in range(rng.randint(0, 6))]
        best = {}
        for word, tag, cost in entries:
            best[word] = min(best.get(word, (cost, tag)), (cost, tag))
        trie = segment.Trie((w, t, c) for w, (c, t) in best.items())
        run = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        pieces = segment.cut(run, trie.starting)
        assert "".join(run[i:j] for i, j, _ in pieces) == run
        assert measured(run, pieces, entries) == brute(run, entries)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumns({c: F.lit(1) for c in ("run", "word", "k", "all")})


def dictionary(spark, entries):
    return spark.createDataFrame(entries, "word string, tag string, cost int")


@pytest.mark.parametrize("limit", [segment.MAX_BYTES, 0])
def test_particles_come_off(spark, limit):
    texts = ["삼성전자가 영업이익은 증가했다!", "이것이 것", None, "", "모르는말이", "증가 증가가"]
    entries = [*KOREAN, ("증가", "VV", 30), (None, "X", 1), ("", "X", 1), ("전자", None, None)]
    out = segment.segment(docs(spark, texts), dictionary(spark, entries), "body", r"[가-힣]+", max_bytes=limit)
    rows = {r.id: [tuple(p) for p in r.pieces] for r in out.collect()}
    assert rows[0] == [("삼성전자", "NNP", 0), ("가", "JKS", 0), ("영업이익", "NNG", 1), ("은", "JX", 1), ("증가", "NNG", 2), ("했다", "EP", 2)]
    assert rows[1] == [("이것", "NP", 0), ("이", "JKS", 0), ("것", "NNB", 1)] and rows[2] == rows[3] == []
    assert rows[4] == [("모르는말", "UNK", 0), ("이", "JKS", 0)] and rows[5][-2:] == [("증가", "NNG", 1), ("가", "JKS", 1)]
    kept = {r.id: r.w for r in out.select("id", segment.kept_words("pieces").alias("w")).collect()}
    assert kept[0] == ["삼성전자", "영업이익", "증가"] and kept[1] == [] and out.columns[-1] == "pieces"


def test_one_letter_stopwords_and_tags(spark):
    pieces = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("tag"), F.lit(0).alias("run")) for w, t in
                       (("수", "NNB"), ("수", "NNG"), ("회사", "NNG"), ("가다", "VV-R"), ("가다", "VV"), ("발표", "NNG"))])
    row = spark.range(1).select(segment.kept_words(pieces, min_length=1).alias("w"), segment.kept_words(pieces, stopwords=()).alias("v")).first()
    assert row.w == ["회사", "가다"] and row.v == ["회사", "가다", "발표"]


@pytest.mark.parametrize("limit", [segment.MAX_BYTES, 0])
def test_a_very_long_run(spark, limit):
    run = "ab" * 50_000
    out = segment.segment(docs(spark, [run, "ab"]), dictionary(spark, [("ab", "NNG", 3), ("ba", "NNG", 3)]), "body", r"[a-z]+", max_bytes=limit)
    sizes = {r.id: (r.n, r.last) for r in out.select("id", F.size("pieces").alias("n"), F.element_at("pieces", -1)["word"].alias("last")).collect()}
    assert sizes == {0: (50_000, "ab"), 1: (1, "ab")}


def test_tokens_are_not_shuffled_for_a_small_dictionary(spark):
    out = segment.segment(docs(spark, ["ab"]), dictionary(spark, [("ab", "NNG", 3)]), "body", r"[a-z]+")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


# --- Lexicon tables -----------------------------------------------------------


def test_hits_equal_counts_of_each_word():
    rng = random.Random(5)
    for _ in range(200):
        words = list({"".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        found = lexicon.Automaton((w, 1) for w in words)
        text = "".join(rng.choices("abc", k=rng.randint(0, 60)))
        assert {words[k]: n for k, n in found.hits(text).items()} == {w: text.count(w) for w in words if w in text}
    assert lexicon.Automaton([]).hits("abc") == {}


WORDS = [("성장", 1), ("하락", -1), ("aa", 2), ("a", 1), ("aab", -3), ("😀", 5), ("성장", 1), (None, 9), ("", 9), ("x", None)]
TEXTS = ["성장 하락 성장", None, "", "aaaab aab", "😀😀 a", "x" * 1000 + "하락"]


@pytest.mark.parametrize("limit", [lexicon.MAX_BYTES, 3])
def test_scores_and_hits(spark, limit):
    table = spark.createDataFrame(WORDS, "word string, weight int")
    rows = docs(spark, TEXTS).withColumn("title", F.lit("aab 성장"))
    weight = {}
    for w, n in WORDS:
        if w and n is not None:
            weight[w] = weight.get(w, 0) + n
    score = lambda t: sum(n * (t or "").count(w) for w, n in weight.items())
    got = {r.id: r.score for r in lexicon.table_score(rows, table, {"title": 2, "body": 1}, max_bytes=limit).collect()}
    assert got == {k: 2 * score("aab 성장") + score(t) for k, t in enumerate(TEXTS)}
    one = {r.id: r.s for r in lexicon.table_score(rows, table, {"body": 1}, "s", max_bytes=limit).collect()}
    assert one == {k: score(t) for k, t in enumerate(TEXTS)}
    hits = {(r.id, r.word): r.n for r in lexicon.word_hits(rows, table, "id", "body", limit).collect()}
    assert hits == {(k, w): (t or "").count(w) for k, t in enumerate(TEXTS) for w in weight if w in (t or "")}


def test_an_empty_lexicon_scores_nothing(spark):
    none = spark.createDataFrame([], "word string, weight int")
    assert {r.score for r in lexicon.table_score(docs(spark, TEXTS), none, {"body": 1}).collect()} == {0}
    assert lexicon.word_hits(docs(spark, TEXTS), none, "id", "body").collect() == []


def test_hits_of_a_batch_come_in_pieces():
    """A batch of 10,000 texts held a dict for every hit at once."""
    import pyarrow as pa

    words = [("".join(w), 1) for w in itertools.product("abc", repeat=3)]
    texts = ["".join(random.Random(i).choices("abc", k=300)) for i in range(5_000)] + ["ab" * lexicon.LETTERS, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t or "" for t in texts])], names=["id", "text"])
    pieces = list(lexicon._counter(words, "id")([batch]))
    assert len(pieces) > 3 and max(p.num_rows for p in pieces) <= 27 * lexicon.LETTERS // 300 + 27
    got = {}
    for p in pieces:
        for row, word, n in zip(*[c.to_pylist() for c in p.columns], strict=True):
            assert (row, word) not in got
            got[row, word] = n
    assert got == {(i, w): t.count(w) for i, t in enumerate(texts) if t for w, _ in words if w in t}


@pytest.mark.parametrize("letters", [5, lexicon.LETTERS])
@pytest.mark.parametrize("cells", [1, lexicon.CELLS])
def test_texts_in_windows_and_pairs_in_tables(monkeypatch, letters, cells):
    """Words across windows and texts side by side, with and without a full table; scores too."""
    monkeypatch.setattr(lexicon, "LETTERS", letters)
    monkeypatch.setattr(lexicon, "CELLS", cells)
    rng = random.Random(6)
    for _ in range(100):
        words = list({"".join(rng.choices("ab😀", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        found = lexicon.Automaton((w, k - 3) for k, w in enumerate(words))
        texts = ["".join(rng.choices("abc😀 ", k=rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        owner, word, n = found.counts(texts)
        assert {(i, words[k]): m for i, k, m in zip(owner, word, n, strict=True)} == {
            (i, w): t.count(w) for i, t in enumerate(texts) for w in words if w in t}
        assert found.scores(texts).tolist() == [sum((k - 3) * t.count(w) for k, w in enumerate(words)) for t in texts]


def test_small_parts_meet_large_shares_of_texts(spark):
    """A share was 16 times a part, so small parts were repeated for every few texts."""
    table = spark.createDataFrame([("ab", 1), ("bc", 2), ("cd", 3)], "word string, weight int")
    rows = spark.range(300).select(F.col("id"), F.lit("abcd" * 20).alias("body"))
    out = lexicon.table_score(rows, table, {"body": 1}, max_bytes=2)
    words = [j for j in out._jdf.queryExecution().analyzed().toString().split("\n") if "sequence(0" in j]
    assert any("sequence(0, 0" in line for line in words) and {r.score for r in out.collect()} == {120}


def test_pieces_come_some_texts_at_a_time(spark):
    """The pieces of a batch of 10,000 texts were held at once."""
    import pandas as pd

    entries = [("ab", "NNG", 3), ("b", "X", 2)]
    texts = [[["abb", "xab"], [], ["b"]][i % 3] for i in range(2_000)]
    out = list(segment._cutter(entries, segment.UNKNOWN_COST).func(iter([pd.Series(texts)])))
    assert max(map(len, out)) <= segment.ROWS_AT_ONCE and sum(map(len, out)) == len(texts)
    rows = [r for part in out for r in part.itertuples(index=False, name=None)]
    want = [(["ab", "b", "x", "ab"], ["NNG", "X", "UNK", "NNG"], [0, 0, 1, 1]), ([], [], []), (["b"], ["X"], [0])]
    assert rows == [want[i % 3] for i in range(2_000)]


def letters(rng, n):
    return "".join(rng.choices("abcdé", k=n))


def written(spark):
    """Sizes of the shuffles and settled tables on this machine, by path."""
    own = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = [p for d in own for p in pathlib.Path(d).rglob("shuffle_*.data")]
    tables = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*.parquet")
    return {p: p.stat().st_size for p in (*shuffles, *tables) if p.is_file()}


def test_a_large_dictionary_takes_little_disk(spark, tmp_path):
    """Texts and pieces went through shuffles several times, and the shuffles of settled tables stayed."""
    rng = random.Random(7)
    texts = [" ".join(letters(rng, rng.choice([3, 4, 4, 5, 5, 7])) for _ in range(400)) for _ in range(1_500)]
    spark.createDataFrame(list(enumerate(texts)), "id long, body string").coalesce(2).write.parquet(f"{tmp_path}/texts")
    entries = [(w, "NNG", 10 + len(w)) for w in sorted({letters(rng, rng.randint(1, 4)) for _ in range(300)})]
    known, before = dictionary(spark, entries), written(spark)
    out = segment.segment(spark.read.parquet(f"{tmp_path}/texts"), known, "body", r"\p{L}{2,}", max_bytes=0)
    settled = {p: size for p, size in written(spark).items() if p not in before}
    assert sum(size for p, size in settled.items() if p.suffix == ".data") < 10_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan
    got = {r.id: "".join(p.word for p in r.pieces) for r in out.collect()}
    assert got == {k: t.replace(" ", "") for k, t in enumerate(texts)}
    assert sum(size for p, size in written(spark).items() if p not in before) < 3 * sum(len(t.encode()) for t in texts)


@pytest.mark.parametrize("bits", [6, segment.FILTER_BITS])
def test_both_ways_cut_the_same(spark, monkeypatch, bits):
    """Whatever the bits of the filter let through."""
    monkeypatch.setattr(segment, "FILTER_BITS", bits)
    rng = random.Random(bits)
    texts = [" ".join(letters(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    entries = [(letters(rng, rng.randint(1, 5)), rng.choice(["NNG", "JX", segment.UNKNOWN_TAG]), rng.randint(1, 40)) for _ in range(200)]
    both = [
        segment.segment(docs(spark, [*texts, None, "a", "a1b2"]), dictionary(spark, entries), "body", r"\p{L}{2,}", max_bytes=limit)
        for limit in (segment.MAX_BYTES, 0)]
    one, other = ({r.id: [tuple(p) for p in r.pieces] for r in out.collect()} for out in both)
    assert one == other and len(one) == 603
    assert both[0].columns == both[1].columns and both[0].schema["pieces"].dataType == both[1].schema["pieces"].dataType


def test_columns_of_any_type_stay_as_they_are(spark):
    rows = spark.sql("""SELECT id, IF(id % 2 = 0, CAST(9007199254740993 + id AS BIGINT), NULL) AS big, CAST(id AS DECIMAL(20, 3)) AS d,
      DATE '0001-01-01' AS day, TIMESTAMP '2024-05-05 01:02:03.000004' AS at, MAP('a', STRUCT(id AS x, ARRAY(id) AS y)) AS deep,
      IF(id = 3, DOUBLE('NaN'), NULL) AS f, X'00FF' AS raw, INTERVAL '3' MONTH AS months, IF(id = 1, NULL, 'ab cd') AS body FROM range(4)""")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        out = segment.segment(rows, dictionary(spark, [("ab", "NNG", 3)]), "body", r"[a-z]+", max_bytes=0)
        assert out.columns == [*rows.columns, "pieces"] and out.dtypes[:-1] == rows.dtypes
        strings = [F.col(c).cast("string").alias(c) for c in rows.columns if c != "raw"]
        assert sorted(map(str, out.select(*strings).collect())) == sorted(map(str, rows.select(*strings).collect()))
        assert {(r.id, bytes(r.raw), len(r.pieces)) for r in out.select("id", "raw", "pieces").collect()} == {(k, b"\x00\xff", 0 if k == 1 else 2) for k in range(4)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_no_dictionary_and_no_texts(spark):
    nothing = dictionary(spark, [])
    out = segment.segment(docs(spark, ["ab c", "", None]), nothing, "body", r"[a-z]+", max_bytes=-1)
    assert {r.id: [tuple(p) for p in r.pieces] for r in out.collect()} == {0: [("ab", "UNK", 0), ("c", "UNK", 1)], 1: [], 2: []}
    assert segment.segment(docs(spark, ["ab"]).limit(0), nothing, "body", r"[a-z]+", max_bytes=-1).collect() == []


def test_a_block_that_two_tasks_read(monkeypatch):
    """Its runs are asked for twice; texts are looked up some runs at a time."""
    import pyarrow as pa

    monkeypatch.setattr(segment, "PLACES_AT_ONCE", 3)
    texts = pa.table({"_block": pa.array([7] * 4), "_runs": pa.array([["ab", "b"], [], ["b", "ab", "ab"], ["c"] * 9])})
    whole = texts.to_batches()[0]
    asked = [list(segment._asker(2)(iter(part))) for part in ([whole.slice(0, 1), whole.slice(1, 2)], [whole.slice(2)])]
    assert [len(part) for part in asked] == [1, 1]
    asked = pa.Table.from_batches([b for part in asked for b in part])
    words = pa.table({"word": ["a", "c"], "tag": ["N", "X"], "cost": [1, 2]})
    answers = segment._solver(20)(asked, words)
    want = {"ab": [("a", "N"), ("b", "UNK")], "b": [("b", "UNK")], "c": [("c", "X")]}
    got = segment._put(texts, answers)
    assert [len(t) for t in segment._slices(texts)] == [2, 1, 1]
    for row, runs in zip(got["_pieces"].to_pylist(), texts["_runs"].to_pylist(), strict=True):
        assert [(p["word"], p["tag"], p["run"]) for p in row] == [(w, t, k) for k, run in enumerate(runs) for w, t in want[run]]


def test_stretches_that_may_be_words(spark, monkeypatch):
    """All words in the runs are handed on, those of some letters at a time, and few other stretches."""
    import pyarrow as pa

    monkeypatch.setattr(segment, "LETTERS_AT_ONCE", 4)
    known = dictionary(spark, [(w, "N", 1) for w in ("ab", "é", "éa", "bab", "zz", "𐐷b")])
    probe = segment._prober(segment._filter(known, 1 << 16), 3)
    runs = ["abab", "éaé", "xyxy", "𐐷b𐐷", "zab", ""]
    asked = pa.RecordBatch.from_pydict({"_bucket": pa.array([4], pa.int32()), "runs": [segment._packed(runs)]})
    batches = list(probe(iter([asked])))
    words = {w for b in batches for w in b["word"].to_pylist()}
    assert {"ab", "bab", "é", "éa", "𐐷b"} <= words and len(words) <= 6 and len(batches) > 3
    assert words <= {run[i:j] for run in runs for i in range(len(run)) for j in range(i + 1, len(run) + 1)}
    assert {x for b in batches for x in b["_bucket"].to_pylist()} == {4}
