"""Small made tables, one per rule."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newspulse.functions import dates, fixed, html, sentiment, text, urls
from newspulse.operators import daily, evaluate, frontier, keywords, pages, sample, scoring, segment, state
from newspulse.operators.ranking import running_totals
from newspulse.session import scratch_path, settle
from newspulse.sinks import files as sinks
from newspulse.sources import files, schemas

D = lambda n: dt.date(2024, 1, n)


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


def values(df):
    return sorted(tuple(r) for r in df.collect())


# --- text -------------------------------------------------------------------


def test_null_texts_are_empty(spark):
    df = spark.createDataFrame([(None, "b"), ("t", None), (None, None)], "title string, content string")
    assert [r[0] for r in df.select(text.full_text("title", "content")).collect()] == [" b", "t ", " "]
    assert [r[0] for r in df.select(text.model_text("title", "content")).collect()] == ["b", "t t", ""]


PYTHON_SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def test_space_characters_are_those_of_python(spark):
    assert sorted(fixed.SPACE_CHARS) == sorted(PYTHON_SPACES)
    assert one(spark, f"{PYTHON_SPACES}a{PYTHON_SPACES}b{PYTHON_SPACES}", text.collapse_spaces) == "a b"
    assert one(spark, f"{PYTHON_SPACES}a b{PYTHON_SPACES}", text.strip) == "a b"


def python_clean(s):
    """What the cleaned text means, in the terms of Python's re and str."""
    for pattern, new in [(r"https?://\S+", ""), (r"\S+@\S+", ""), (r"<[^>]+>", ""), (r"[^\w\s]", " ")]:
        s = re.compile(pattern).sub(new, s)
    return " ".join(w for w in s.split() if not re.fullmatch(r"\d+", w))


CLEAN_CASES = [
    "", " ", "see https://a.b/c?d=1 now", "mail me a@b.c, or x@y", "@start a@ @b a@@ @a@ a@b@c é@ü",
    "<p>bold</p> 3 < 4 > 2 <<>> <a <b> c", "<unclosed <still open", "é12 12é 12 １２ a_1 _ 7_ ½ 3", "삼성 2024년 12 월!",
    "tabs\tand nbsp\x1cand　wide", "a<b>@c>d", "x <> y",
]


def test_clean_text_equals_python(spark):
    rng = random.Random(1)
    cases = CLEAN_CASES + ["".join(rng.choice("ab@<> .1é１_\n") for _ in range(30)) for _ in range(400)]
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", text.clean_text("c").alias("got"))
    for r in df.collect():
        assert r["got"] == python_clean(r["c"]), repr(r["c"])


@pytest.mark.parametrize("piece", ["a", "<", "@", "@a", "http://", "1", "é. "])
def test_clean_text_is_linear_in_a_long_run(spark, piece):
    assert one(spark, piece * 300_000, text.clean_text) is not None


def python_sentences(s):
    return re.sub(r"([.!?다요]) ", "\\1\n", " ".join((s or "").split())).split("\n")


def test_summaries_equal_python(spark):
    rng = random.Random(2)
    cases = ["", "  ", "no end", "갔다 왔어요 끝", "A. B! C? D.", " lead. \n\n x.\ty. z"] + [
        "".join(rng.choice("a. !다요\n ") for _ in range(25)) for _ in range(300)
    ]
    df = spark.createDataFrame([(c,) for c in cases], "c string").select(
        "c", text.lead_summary("c").alias("lead"), text.sentences("c").alias("s"),
        text.sentence_breaks("c", 100).alias("breaks"), text.ends_sentence("c").alias("ends"), text.is_blank("c").alias("blank"),
    )
    for r in df.collect():
        want = python_sentences(r["c"])
        assert r["s"] == want
        assert r["lead"] == " ".join(want[:3])
        breaks = len(python_sentences(r["c"] + " x")) - 1
        if r["c"].strip():
            assert r["breaks"] == breaks and r["ends"] == (breaks > 0), repr(r["c"])
        assert r["blank"] == (not r["c"].strip())


def test_boilerplate_patterns(spark):
    raw = (
        "[서울=홍길동 기자] 본문 첫 줄\n  둘째 줄  \n\n\n(c) 무엇 무단 전재 및\n재배포 금지\n저작권자 © 어디\n 홍길동 기자 hong@a.kr \n"
        "홍길동 특파원\n▶ 더 보기\n【속보】 셋째 (끝) \nask@news.co.kr 제보\nplain c text\r\nlast"
    )
    assert one(spark, raw, text.strip_boilerplate) == "본문 첫 줄\n둘째 줄\n셋째\nplain c text\nlast"
    assert one(spark, None, text.strip_boilerplate) == ""


def test_tokens_ngrams_and_ties(spark):
    assert one(spark, "기자 삼성 이 상승", lambda c: text.tokens(c, fixed.HANGUL_WORD)) == ["삼성", "상승"]
    assert one(spark, ["a"], text.ngrams, "array<string>") == []
    assert one(spark, [], text.ngrams, "array<string>") == []
    assert one(spark, ["a", "b", "c"], text.ngrams, "array<string>") == ["a b", "b c"]
    assert one(spark, ["a", "b", "c", "d"], lambda c: text.ngrams(c, 3), "array<string>") == ["a b c", "b c d"]
    words = ["z", "b", "a", "b", "z", "c"]
    assert one(spark, words, lambda c: text.top_terms(text.term_counts(c), 3), "array<string>") == ["z", "b", "a"]
    counts = one(spark, words, text.term_counts, "array<string>")
    assert {r["word"]: (r["n"], r["first_pos"]) for r in counts} == {"a": (1, 2), "b": (2, 1), "c": (1, 5), "z": (2, 0)}
    assert one(spark, [], text.term_counts, "array<string>") == []
    assert one(spark, ["bb", "a", "cc"], text.longest, "array<string>") == "bb"
    assert one(spark, [], text.longest, "array<string>") is None


# --- labels -------------------------------------------------------------------


def test_polarity_variants(spark):
    df = spark.createDataFrame([("positive",), ("POSITIVE ",), ("Negative",), ("other",), (None,)], "c string")
    get = lambda **k: [r[0] for r in df.select(sentiment.polarity("c", **k)).collect()]
    assert get() == [1, 0, -1, 0, 0]
    assert get(trim=True) == [1, 1, -1, 0, 0]
    assert get(fold=False, unknown=None) == [1, None, None, None, None]


def test_gate_and_refine_borders(spark):
    df = spark.createDataFrame(
        [(0.6, 5), (0.59996, 5), (0.7, 2), (0.7, -2), (0.7, 1), (0.69, 9), (None, 1), (None, -3)], "p double, k int"
    )
    gated = [r[0] for r in df.select(sentiment.gate_label(F.lit("Positive"), "p")).collect()]
    assert gated == ["positive", "neutral", "positive", "positive", "positive", "positive", "positive", "positive"]
    refined = [r[0] for r in df.select(sentiment.refine(F.lit("model"), "p", "k")).collect()]
    assert refined == ["neutral", "neutral", "positive", "negative", "model", "neutral", "model", "negative"]


def test_lexicon_counts_each_word_on_its_own(spark):
    df = spark.createDataFrame([("상승진 하락", "감소감소"), (None, None)], "title string, content string")
    assert [r[0] for r in df.select(sentiment.lexicon_score("title", "content")).collect()] == [2 * (2 - 1) - 2, 0]


def test_scorer_failures_and_blank_texts(spark):
    def factory():
        def score(texts):
            if "boom" in texts:
                raise RuntimeError("boom")
            return [("POSITIVE", 0.59996 if t == "low" else 0.987654) for t in texts]

        return score

    rows = [(1, "fine"), (2, "low"), (3, None), (4, "  "), (5, "boom"), (6, "fine")]
    df = spark.createDataFrame(rows, "id long, model_text string").coalesce(1)
    got = values(scoring.score_with_model(df, factory, batch_size=2).select("id", "sentiment", "confidence"))
    assert got == [
        (1, "positive", 0.9877), (2, "neutral", 0.6), (3, "neutral", 0.0), (4, "neutral", 0.0),
        (5, "neutral", 0.0), (6, "neutral", 0.0),
    ]
    plain = scoring.score_with_model(df.where("id = 2"), factory, threshold=None, digits=None)
    assert values(plain.select("sentiment", "confidence")) == [("positive", 0.59996)]


# --- days ---------------------------------------------------------------------


def days(spark, counts):
    rows = [(day, v) for day, vs in counts.items() for v in vs]
    return spark.createDataFrame(rows, "date_only date, sentiment_num int")


def test_support_is_applied_before_the_lag(spark):
    articles = days(spark, {D(1): [1] * 5, D(2): [-1] * 4, D(3): [0] * 5, None: [1] * 9, D(5): [0, 0, 0, 0, 0, None]})
    got = values(daily.with_change(daily.daily_sentiment(articles)))
    assert got == [(D(1), 1.0, 5, None, None), (D(3), 0.0, 5, 1.0, -1.0), (D(5), 0.0, 5, 0.0, 0.0)]


def test_threshold_is_inclusive_and_first_day_is_no_event(spark):
    articles = days(spark, {D(1): [1, 1], D(2): [1, 0], D(3): [1, 0]})
    events = daily.change_events(daily.daily_sentiment(articles, min_count=1), 0.5)
    assert values(events.select("date_only", "change")) == [(D(2), -0.5)]


def test_random_days_keep_the_invariants(spark):
    rng = random.Random(3)
    articles = days(spark, {D(n): [rng.choice([-1, 0, 1]) for _ in range(rng.randint(1, 12))] for n in range(1, 31)})
    kept = sorted(daily.with_change(daily.daily_sentiment(articles)).collect(), key=lambda r: r["date_only"])
    assert all(r["article_count"] >= 5 for r in kept)
    for before, after in zip(kept, kept[1:]):
        assert after["prev"] == before["sentiment_mean"]
        assert after["change"] == after["sentiment_mean"] - before["sentiment_mean"]


def test_lookback_is_strict(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:01",)], "t string").select(
        F.to_timestamp("t").alias("ts")
    )
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    assert daily.within_lookback(df, "ts", as_of).count() == 1
    assert daily.within_lookback(df, "ts", as_of, None).count() == 2


def summary_by_hand(rows):
    by_day = {}
    for day, order, content in sorted(rows, key=lambda r: r[1]):
        by_day.setdefault(day, []).append(content or "")
    return {d: " ".join(python_sentences(" ".join(t))[:3]) for d, t in by_day.items() if "".join(t).strip()}


def test_event_summary_spans_articles(spark):
    rng = random.Random(4)
    rows = [(D(1), 1, "no end"), (D(1), 2, ""), (D(1), 3, "here. B"), (D(1), 4, "C. D. E."), (D(2), 5, "  "), (D(3), 6, None)]
    rows += [
        (D(4 + i % 25), 100 + i, "".join(rng.choice("ab . 다\n") for _ in range(rng.randint(0, 8)))) for i in range(400)
    ]
    articles = spark.createDataFrame(rows, "date_only date, id long, content string")
    events = articles.select("date_only").distinct()
    got = {r[0]: r[1] for r in daily.event_summary(articles, events, "id").collect()}
    assert got == summary_by_hand(rows)


def test_event_keywords_on_a_hot_day(spark):
    rng = random.Random(5)
    rows = [(D(1) if i % 3 else D(2), i, " ".join(rng.choice(["가나", "다라", "마바", "사아", "자차", "카타"]) for _ in range(9))) for i in range(300)]
    articles = spark.createDataFrame(rows, "date_only date, id long, content string").repartition(7)
    got = {}
    for r in daily.event_keywords(articles, articles.select("date_only").distinct(), "id").collect():
        got.setdefault(r["date_only"], {})[r["rank"]] = r["word"]
    for day in (D(1), D(2)):
        joined = " ".join(c for d, _, c in rows if d == day)
        want = [w for w, _ in Counter(re.findall(r"[가-힣]{2,}", joined)).most_common(5)]
        assert [got[day][i] for i in range(1, 6)] == want


# --- terms ----------------------------------------------------------------------


def test_heaps_and_zipf_by_hand(spark):
    docs = [["a", "b", "a"], [], ["b", "c"], ["d"], ["a", "d"]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>").repartition(3)
    seen, total, want = set(), 0, []
    for i, t in enumerate(docs):
        seen |= set(t)
        total += len(t)
        want.append((i, total, len(seen)))
    assert values(keywords.heaps_curve(df, "doc_id")) == want
    freqs = sorted(Counter(w for t in docs for w in t).values(), reverse=True)
    assert values(keywords.zipf_curve(keywords.word_counts(df))) == [(i + 1, n) for i, n in enumerate(freqs)]


def test_long_rank_ranges_are_cut(spark):
    from newspulse.operators.ranking import expand_ranks, rank_ranges

    counts = spark.range(2500).select(F.when(F.col("id") < 3, 9).otherwise(1).cast("long").alias("n"))
    got = values(expand_ranks(rank_ranges(counts), chunk=100))
    assert got == [(i + 1, 9 if i < 3 else 1) for i in range(2500)]


def test_running_totals_match_a_flat_window(spark):
    rng = random.Random(6)
    rows = [(i * 7 % 1009, rng.randint(0, 5)) for i in range(1009)]
    got = values(running_totals(spark.createDataFrame(rows, "k long, v long"), "k", {"v": "total"}).select("k", "total"))
    total, want = 0, []
    for k, v in sorted(rows):
        total += v
        want.append((k, total))
    assert got == want


def test_tfidf_without_vocabulary_is_empty(spark):
    df = spark.createDataFrame([(["a", "b"],)], "tokens array<string>")
    assert keywords.tfidf_top(df).collect() == []


# --- evaluation -------------------------------------------------------------------


def test_report_with_missing_classes(spark):
    df = spark.createDataFrame(
        [("a", "a"), ("a", "c"), ("b", "a"), (None, "a"), ("b", None)], "t string, p string"
    )
    report = {r["label"]: r for r in evaluate.classification_report(df, "t", "p").collect()}
    assert (report["a"]["precision"], report["a"]["recall"], report["a"]["support"]) == (0.5, 0.5, 2)
    assert (report["b"]["precision"], report["b"]["f1"], report["b"]["support"]) == (0.0, 0.0, 1)
    assert (report["c"]["recall"], report["c"]["support"]) == (0.0, 0)
    assert report["accuracy"]["f1"] == pytest.approx(1 / 3)
    assert report["macro avg"]["precision"] == pytest.approx(0.5 / 3)
    assert report["weighted avg"]["recall"] == pytest.approx(1 / 3)
    matrix = values(evaluate.confusion_matrix(df, "t", "p", ["a", "b", "c"]))
    assert matrix == [("a", 1, 0, 1), ("b", 1, 0, 0), ("c", 0, 0, 0)]


def test_distribution_divides_by_all_rows(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", None), (None, 1.0), ("b", 0.0)], "l string, c double")
    assert values(evaluate.label_distribution(df, "l", "c")) == [("a", 2, 50.0, 0.5), ("b", 1, 25.0, 0.5)]


def test_sample_with_a_small_class(spark):
    rows = [(i, f"t{i}", "c" * 300, "positive" if i < 2 else "negative", 0.9) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, title string, content string, sentiment string, confidence double")
    got = sample.tagging_sample(df, "id", quotas={"positive": 5, "negative": 4}).collect()
    assert sorted(r["number"] for r in got) == list(range(1, 7))
    assert {(r["predicted"], r["quota_met"]) for r in got} == {("positive", False), ("negative", True)}
    assert all(len(r["body_start"]) == 200 for r in got)
    again = sample.tagging_sample(df.repartition(5), "id", quotas={"positive": 5, "negative": 4}).collect()
    assert sorted(got) == sorted(again)


# --- state --------------------------------------------------------------------------


def test_new_articles_null_and_repeated_urls(spark):
    stored = spark.createDataFrame([("u1",), ("u1",)], "url string")
    incoming = spark.createDataFrame([("u1", 1), ("u2", 3), ("u2", 2), (None, 5), (None, 4)], "url string, k int")
    assert set(tuple(r) for r in state.new_articles(incoming, stored, [F.col("k")]).collect()) == {("u2", 2), (None, 4)}
    with_null = stored.unionByName(spark.createDataFrame([(None,)], "url string"))
    assert values(state.new_articles(incoming, with_null, [F.col("k")])) == [("u2", 2)]


def test_upsert_newest_wins_and_nulls_are_one_key(spark):
    old = spark.createDataFrame([("u1", "old", "2024-01-01", 1), (None, "old", "2024-01-02", 2)], "url string, v string, date string, k int")
    new = spark.createDataFrame([("u1", "new", "2024-01-03", 9), ("u1", "newer", "2024-01-04", 1), (None, "new", "2024-01-05", 1)], old.schema)
    got = [(r["url"], r["v"]) for r in state.upsert(old, new, [F.col("k")]).collect()]
    assert got == [(None, "new"), ("u1", "newer")]


def test_keyed_update_adds_columns(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    scores = spark.createDataFrame([(2, "positive", 0.9), (3, "x", 0.1)], "id long, sentiment string, score double")
    got = {r["id"]: (r["title"], r["sentiment"], r["score"]) for r in state.keyed_update(table, scores, "id", ["sentiment", "score"]).collect()}
    assert got == {1: ("a", None, None), 2: ("b", "positive", 0.9)}


def test_csv_with_bom_and_quoted_lines(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿title,content,date,press,url\n"a ""b""","line 1\nline 2, x\r\n\n3",2024,,u\n', encoding="utf-8")
    rows = files.read_articles(spark, str(path), "csv").collect()
    assert [tuple(r) for r in rows] == [('a "b"', "line 1\nline 2, x\r\n\n3", "2024", None, "u")]


def test_csv_round_trip_of_hard_text(spark):
    # An empty text comes back as missing, as CSV readers do by default.
    rows = [(' a "q" \\ ', 'x\ny\r\nz,"', "d", None, "u"), (None, "\\", '"', "\t", "v")]
    df = spark.createDataFrame(rows, schemas.ARTICLE_RAW)
    path = scratch_path(spark, "csv")
    sinks.write_csv(df, path)
    assert sorted(map(tuple, files.read_articles(spark, path, "csv").collect()), key=str) == sorted(rows, key=str)


def test_optional_table_and_failure_log(spark):
    path = scratch_path(spark, "log")
    assert files.read_optional(spark, path, schemas.ARTICLE_RAW).count() == 0
    rejects = spark.createDataFrame([("u1", "본문 짧음(12자)"), ("u2", "본문 짧음(3자)"), ("u3", "본문 없음")], "url string, reason string")
    sinks.append_failure_log(rejects.where("url = 'u1'"), path)
    sinks.append_failure_log(rejects.where("url <> 'u1'"), path)
    log = files.read_failure_log(spark, path)
    assert log.where("ts IS NOT NULL").count() == 3
    assert values(pages.count_reasons(log)) == [("본문 없음", 1), ("본문 짧음", 2)]


# --- collection plan -------------------------------------------------------------------


def test_month_ranges_clip_both_ends(spark):
    span = spark.createDataFrame([(dt.date(2022, 1, 15), dt.date(2022, 12, 30))], "start date, end date")
    got = values(frontier.month_ranges(span))
    assert got[0] == ("2022.01.15", "2022.01.31") and got[1] == ("2022.02.01", "2022.02.28")
    assert got[-1] == ("2022.12.01", "2022.12.30") and len(got) == 12
    plan = frontier.page_plan(frontier.month_ranges(span))
    assert plan.count() == 480 and plan.agg(F.max("offset")).first()[0] == 391


def stop_rule(spark, months):
    rows = [
        (m, page, pos, url) for m, listed in months.items() for page, found in listed.items() for pos, url in enumerate(found)
    ]
    df = spark.createDataFrame(rows, "month long, page long, pos long, url string")
    return {r["month"]: (r["pages_visited"], r["new_urls"], r["stop_reason"]) for r in frontier.page_stop_rule(df).collect()}


def test_stop_rules(spark):
    u = lambda *names: [f"https://x/{n}" for n in names]
    got = stop_rule(
        spark,
        {
            1: {0: u("a", "b"), 1: u("c")},  # then three empty pages
            2: {0: u("d"), 3: u("e"), 6: u("f")},  # two empty pages do not stop
            3: {p: u("g", f"h{p}") for p in range(7)} | {7: u("g", "h0"), 8: u("i")},  # page 7 adds nothing
            4: {p: u(f"j{p}" if p > 3 else "j") for p in range(40)},  # a repeat before page 6 does not stop
        },
    )
    assert got == {1: (5, 3, "empty_pages"), 2: (10, 3, "empty_pages"), 3: (8, 8, "nothing_new"), 4: (40, 37, "page_limit")}


# --- urls, dates, pages -------------------------------------------------------------------


def test_urls(spark):
    assert one(spark, "https://a.b/c//?x=1?y", urls.normalise) == "https://a.b/c"
    assert one(spark, "https://a.b/c#f/", urls.normalise) == "https://a.b/c#f"
    page = "https://h.example/fr/825?page=2"
    resolve = lambda link: one(spark, link, lambda c: urls.absolute(c, F.lit(page)))
    assert resolve("/x") == "https://h.example/x"
    assert resolve("//o.example/x") == "https://o.example/x"
    assert resolve("y/z") == "https://h.example/fr/y/z"
    assert resolve("http://q/") == "http://q/" and resolve("mailto:a@b") == "mailto:a@b"


def test_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-02 03:04:05",), ("2024.01.02",), ("3시간 전",), ("",), (None,), ("2024-13-40",)], "c string"
    )
    got = [r[0] for r in df.select(F.date_format(dates.parse_timestamp("c"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-01-02 03:04", "2024-01-02 00:00", None, None, None, None]
    like = [r[0] for r in df.select(dates.looks_like_date("c")).collect()]
    assert like == [True, True, True, False, False, True]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        df.select(dates.parse_timestamp_strict("c")).collect()


def test_page_parts(spark):
    page = (
        "<html><head><title>Fallback | Site News</title><script>var a='<article>';</script></head><body><!-- <h1>no</h1> -->"
        '<div id="content"><div>one <b>bold</b></div>\n<div>two &amp; &lt;three&gt;<div>deep</div></div>more text to be long</div>'
        '<div>outside</div><div class="logo"><img src=a alt=" Paper &amp; Co "></div>'
        '<span class="t" data-date-time="2024-01-02 08:00:00">x</span></body></html>'
    )
    visible = one(spark, page, html.visible_html)
    assert one(spark, visible, lambda c: html.page_title(c, site_names=["Site News"])) == "Fallback"
    assert one(spark, visible, html.page_body) == "one\nbold\ntwo & <three>\ndeep\nmore text to be long"
    assert one(spark, visible, lambda c: html.inner_html(c, "div", 'id="content"')).endswith("more text to be long")
    assert one(spark, visible, html.page_date) == "2024-01-02 08:00:00"
    assert one(spark, visible, lambda c: html.page_publisher(c, F.lit("list"), ("div", 'class="logo"'))) == "Paper & Co"
    assert one(spark, "<p>none</p>", html.page_body) is None
    assert one(spark, "<p>none</p>", lambda c: html.page_date(c, F.lit("3시간 전"))) == "3시간 전"
    assert one(spark, None, html.page_date) is None
    meta = '<meta content="2024-02-03" property="article:published_time"><time>later</time>'
    assert one(spark, meta, html.page_date) == "2024-02-03"


def test_character_references(spark):
    import html as stdlib

    cases = [
        "", "plain", "a & b", "&amp;lt; &lt;b&gt; &#38;lt;", "&#8217;&#x27;&#39;&#X1F600; &eacute;&nbsp;&hellip;",
        "&unknown; &amp", "&#0; &#xD800;", "a&b;c&amp;", "&&amp;&", "&copy;&middot;&apos;&quot;",
    ]
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", html.unescape("c").alias("got"))
    for r in df.collect():
        if r["c"] in ("&#0; &#xD800;", "&unknown; &amp"):  # kept as they are
            assert r["got"] == r["c"]
        else:
            assert r["got"] == stdlib.unescape(r["c"]), r["c"]


def test_link_containers_follow_nesting(spark):
    page = '<div class="outer"><div class="inner">plain</div><li class="x"><a href="/a">link</a></li></div><div class="empty"><a href="/b"></a></div>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert values(pages.link_containers(df).select("tag", "class", "text")) == [
        ("div", "outer", "plainlink"), ("li", "x", "link"),
    ]


def test_articles_are_accepted_or_rejected(spark):
    body = "<article>" + "<p>word word word word.</p>" * 5 + "</article>"
    rows = [
        (1, "https://h.example/1", "<h1>Fine title</h1>" + body),
        (2, "https://h.example/2", "<p>nothing</p>"),
        (3, "https://h.example/3", "<article>thirty five characters are in this text</article>"),
    ]
    found = pages.extract_articles(spark.createDataFrame(rows, schemas.HTML_PAGES))
    assert [(r["page_id"], r["title"], r["press"]) for r in pages.accepted_articles(found).collect()] == [(1, "Fine title", "h.example")]
    assert values(pages.rejected(found)) == [("https://h.example/2", "본문 없음"), ("https://h.example/3", "본문 짧음(39자)")]


def test_stop_rule_looks_at_visited_pages_only(spark):
    schema = "month long, page long, pos long, url string"
    link = lambda n: f"https://news.example/a/{n}"
    plan = spark.createDataFrame([(m, p) for m in (1, 2, 3) for p in range(40)], "month long, page long")
    # A month whose only hit is past the stop of empty pages; its url is new to the next month.
    rows = [(1, 0, 0, link("a")), (1, 20, 0, link("b")), (2, 0, 0, link("b"))]
    got = {r["month"]: tuple(r)[1:] for r in frontier.page_stop_rule(spark.createDataFrame(rows, schema), plan=plan).collect()}
    assert got == {1: (4, 1, "empty_pages"), 2: (4, 1, "empty_pages"), 3: (3, 0, "empty_pages")}
    progress = frontier.frontier_progress(spark.createDataFrame(rows, schema), plan=plan).collect()
    assert [tuple(r) for r in sorted(progress)] == [(1, 1, 1), (2, 1, 2), (3, 0, 2)]
    # A page past the plan is not visited.
    far = spark.createDataFrame([(1, 45, 0, link("a"))], schema)
    assert [tuple(r)[1:3] for r in frontier.page_stop_rule(far, plan=plan.where("month = 1")).collect()] == [(3, 0)]


def test_stop_rule_stops_shift_later_months(spark):
    schema = "month long, page long, pos long, url string"
    link = lambda n: f"https://news.example/a/{n}"
    full = lambda m, urls: [(m, p, 0, link(u)) for p, u in enumerate(urls)]
    # Month 1 repeats itself from page 6 on and never sees x; month 2 finds x new on page 6 and goes on.
    rows = full(1, ["a"] * 8 + ["x"]) + full(2, ["a", "b", "c", "d", "e", "f", "x", "a", "y"])
    got = {r["month"]: tuple(r)[1:] for r in frontier.page_stop_rule(spark.createDataFrame(rows, schema), pages=9).collect()}
    assert got == {1: (7, 1, "nothing_new"), 2: (8, 6, "nothing_new")}
    stored = spark.createDataFrame([(link("b") + "?x=1",)], "url string")
    again = {r["month"]: r["new_urls"] for r in frontier.page_stop_rule(spark.createDataFrame(rows, schema), pages=9, stored=stored).collect()}
    assert again == {1: 1, 2: 5}


def test_confusion_matrix_counts_every_label(spark):
    df = spark.createDataFrame([("positive", "mixed"), ("positive", "positive"), ("mixed", "neutral"), (None, "x")], "t string, p string")
    got = evaluate.confusion_matrix(df, "t", "p", ["negative"])
    assert got.columns == ["true_label", "pred_mixed", "pred_negative", "pred_neutral", "pred_positive"]
    assert {tuple(r) for r in got.collect()} == {
        ("mixed", 0, 0, 1, 0), ("negative", 0, 0, 0, 0), ("neutral", 0, 0, 0, 0), ("positive", 1, 0, 0, 1)}


def test_container_text_is_as_long_as_asked(spark):
    words = "".join(f"<p>word{i:04d}</p>" for i in range(60))
    df = spark.createDataFrame([(1, f'<div class="c">{words}<a href="x">y</a></div>')], "page_id long, html string")
    assert len(pages.link_containers(df, prefix=100).first()["text"]) == 100


def test_update_takes_one_change_per_key(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (None, "z", 1)], "id long, v string, step int")
    got = state.keyed_update(table, changes, "id", ["v"], [F.col("step")]).collect()
    assert sorted(map(tuple, got)) == [(1, "y"), (2, "b")]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    from newspulse.sources.files import read_csv_table

    (tmp_path / "a.csv").write_text('﻿url,more,title,when\nu1,1,"two\nlines, ""quoted""",2024-01-02\nu2,2,t,no date\n', encoding="utf-8")
    got = read_csv_table(spark, f"file://{tmp_path}/a.csv", "title string, url string, press string, when date")
    assert got.columns == ["title", "url", "press", "when"]
    assert [(r.title, r.url, r.press, str(r.when)) for r in got.collect()] == [
        ('two\nlines, "quoted"', "u1", None, "2024-01-02"), ("t", "u2", None, "None")]


def test_partition_ranges_of_a_database_key():
    from newspulse.sources.jdbc import partition_options

    assert partition_options("ID", None, 8) == {}
    assert partition_options("ID", (5, 6), 8) == {"partitionColumn": "ID", "lowerBound": "5", "upperBound": "7", "numPartitions": "2"}


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from newspulse.session import shared_dir

    none = SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_summary_of_a_day_without_sentence_ends(spark):
    rows = spark.range(20_000).select(
        F.lit("2024-01-01").cast("date").alias("date_only"), F.col("id").alias("o"), F.concat(F.lit("w"), F.col("id")).alias("content"))
    days = spark.createDataFrame([("2024-01-01",)], "d string").select(F.col("d").cast("date").alias("date_only"))
    got = daily.event_summary(rows, days, "o").first()["summary"]
    assert got == " ".join(f"w{i}" for i in range(20_000))


def test_event_news_meets_events_before_ranking(spark):
    schema = "date_only date, title string, final_sentiment string, confidence double, url string"
    plan = daily.event_news(spark.createDataFrame([], schema), spark.createDataFrame([], "date_only date"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("WindowGroupLimit" if "WindowGroupLimit" in text else "Window") < text.index("LeftSemi")


def test_article_minimum_and_list_values(spark):
    page = '<article class="x">' + "<p>Some words of a body that goes on for a while.</p>" * 3 + "</article>"
    df = spark.createDataFrame([(1, "https://a.example/1", page), (2, "https://a.example/2", "<p>x</p>")], "page_id long, url string, html string")
    lists = {"list_title": F.lit("From the list"), "list_date": F.lit("2024.01.02."), "list_press": F.lit("Daily")}
    long = {r.page_id: r for r in pages.extract_articles(df, (), min_body=1000, **lists).collect()}
    short = {r.page_id: r for r in pages.extract_articles(df, (), min_body=10, **lists).collect()}
    assert short[1].reason is None and long[1].reason.startswith(fixed.REASON_SHORT_BODY) and long[2].reason == fixed.REASON_NO_BODY
    assert (short[1].title, short[1].press) == ("From the list", "Daily") and short[1].date.startswith("2024.01.02")


def test_corpus_stats_sends_a_repeated_pair_once(spark, monkeypatch):
    rows = [(["a", "b"] * 50,), ([],), (None,), (["x"],), (["b", "a", "b"],), (["a b"],), (["é", "日本"],)]
    docs = spark.createDataFrame(rows, "tokens array<string>").coalesce(1)
    want = (7, 100 + 1 + 3 + 1 + 2, 6, 3)
    assert tuple(keywords.corpus_stats(docs).first()) == want
    sent = [r.term for r in keywords._terms(docs, "tokens").collect() if r.term[0] == "b"]
    assert sorted(sent) == ["ba b", "bb a", "bé 日本"]
    monkeypatch.setattr(keywords, "TOKENS_AT_ONCE", 2)
    assert tuple(keywords.corpus_stats(docs).first()) == want
    assert tuple(keywords.corpus_stats(docs.limit(0)).first()) == (0, 0, 0, 0)


def test_a_run_meets_its_pieces_once_per_block(spark, monkeypatch):
    settled = {}
    monkeypatch.setattr(segment, "settle", lambda df, name: settled.setdefault(name, settle(df, name)))
    dictionary = spark.createDataFrame([("ab", "N", 1), ("cd", "V", 1)], "word string, tag string, cost int")
    docs = spark.createDataFrame([(k, "abcd " * 50) for k in range(300)] + [(300, None), (301, "")], "id int, t string").coalesce(1)
    got = segment.segment(docs, dictionary, "t", fixed.LETTER_WORD, max_bytes=0).collect()
    assert settled["runs-by-block"].count() == 2  # of 15,000 places
    assert settled["distinct-runs"].count() == 1
    for r in got:
        want = [(w, t, k) for k in range(50) for w, t in (("ab", "N"), ("cd", "V"))] if r.id < 300 else []
        assert [tuple(p) for p in r.pieces] == want
    assert len(got) == 302
