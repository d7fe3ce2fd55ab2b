"""Spread forms equal plain ones, with one key holding most of the rows."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from folioscope.operators import analytics, keyword, locations, progress, skew, summaries, vectors


def hot_rows(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", rng.randint(0, 30)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, v int")


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_segmented_windows(spark):
    df = hot_rows(spark)
    seg = F.floor(F.col("id") / 16)
    w = W.partitionBy("k").orderBy("id")
    got = skew.segmented_running_sums(df, ["k"], ["id"], seg, {"s": F.col("v").cast("long"), "n": F.lit(1).cast("long")})
    plain = df.select(
        "id", "k", "v", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"), (F.row_number().over(w) - 1).cast("long").alias("n")
    )
    assert as_set(got.select(plain.columns)) == as_set(plain)
    for lead in (False, True):
        got = skew.segmented_lag(df, ["k"], ["id"], seg, ["v"], "o", lead)
        plain = df.select("id", (F.lead if lead else F.lag)("v").over(w).alias("o"))
        assert as_set(got.select("id", F.col("o.v"))) == as_set(plain)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_spread(spark, no_broadcast, how):
    big = hot_rows(spark)
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, x int")
    assert as_set(skew.lookup_join(big, small, ["k"], how)) == as_set(big.join(small, "k", how))


def test_speed_percentile_and_rank(spark):
    rng = random.Random(2)
    rows = [(i, "m0" if rng.random() < 0.7 else f"m{i % 4}", "regular" if i % 2 else "spoiler", 5.0 if rng.random() < 0.5 else rng.random() * 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "result_id long, model string, evaluation_type string, response_time double")
    pdf = df.toPandas()
    pdf["pct"] = pdf.groupby("model")["response_time"].rank(pct=True) * 100
    got = analytics.with_speed_percentile(df).toPandas().set_index("result_id")["response_speed_percentile"].sort_index()
    assert np.allclose(got, pdf.set_index("result_id")["pct"].sort_index())
    pdf["avg"] = pdf.groupby("model")["response_time"].transform("mean").round(2)
    pdf["rank"] = pdf.groupby("evaluation_type")["avg"].rank(method="min")
    got = analytics.with_speed_rank(df).toPandas().set_index("result_id")["model_speed_rank"].sort_index()
    assert (got == pdf.set_index("result_id")["rank"].sort_index()).all()


@pytest.mark.parametrize("values", [[0, 1, 2, 3, 4, 5, 6] * 20, [3] * 50 + [4] * 3, [1] * 9 + [2] * 9, [7]])
def test_context_bins_equal_quantile_cut(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "result_id long, context_count int")
    s, labels = pd.Series(values), ["low", "mid", "high"]
    try:
        want = pd.qcut(s, 3, labels=labels, duplicates="drop").astype(str)
    except ValueError:
        try:
            want = pd.qcut(s.rank(method="first"), 3, labels=labels).astype(str)
        except ValueError:
            want = pd.Series(["all"] * len(s))
    got = analytics.context_bins(df).toPandas().set_index("result_id")["context_bin"].sort_index()
    assert list(got) == list(want)


@pytest.mark.parametrize("seed", range(4))
def test_summary_closes(spark, seed, monkeypatch):
    """Small blocks and fans, gaps wider than both: same as one long walk."""
    monkeypatch.setattr(summaries, "BLOCK", 32)
    monkeypatch.setattr(summaries, "FAN", 4)
    rng = random.Random(seed)
    rows, want = [], []
    for book in ("a", "b", "c"):
        at, last = rng.randint(1, 60), 0
        for _ in range(rng.randint(1, 400)):
            rows.append((book, at))
            if at - last >= 11:
                want.append((book, at))
                last = at
            at += rng.choice([0, 0, 1, 1, 1, 2, 5, 11, 30]) if rng.random() > 0.02 else rng.randint(100, 700)
    df = spark.createDataFrame(rows, "book_id string, location int")
    assert as_set(summaries.closing_locations(df)) == sorted(want, key=repr)


@pytest.mark.parametrize("blocks", [{}, {"probes_per_block": 3, "items_per_block": 5}])
def test_vector_search_in_tiles(spark, blocks):
    rng = np.random.default_rng(5)
    items = [(i, "hot" if i % 3 else "cold", int(i % 17) + 1, "summary" if i % 5 == 0 else "content", rng.normal(size=8).round(2).tolist()) for i in range(120)]
    asked = [(q, "hot" if q % 4 else "cold", int(q % 13) + 3, rng.normal(size=8).round(2).tolist()) for q in range(20)]
    vdf = spark.createDataFrame(items, "vec_id long, book_id string, location int, content_type string, vector array<double>")
    pdf = spark.createDataFrame(asked, "question_id long, book_id string, boundary int, vector array<double>")
    got = as_set(vectors.similar_vectors(pdf, vdf, ["question_id"], ["vec_id"], limit=4, threshold=0.1, **blocks).select("question_id", "rank_in_method", "vec_id"))
    want = []
    for q, book, bound, qv in asked:
        scored = [(-round(float(np.dot(qv, v) / np.linalg.norm(qv) / np.linalg.norm(v)), 9), i) for i, b, l, _, v in items if b == book and l <= bound]
        want += [(q, n + 1, i) for n, (s, i) in enumerate(sorted(x for x in scored if -x[0] >= 0.1)[:4])]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("blocks", [{}, {"asked_per_block": 5}])
def test_keyword_search_in_blocks(spark, no_broadcast, blocks):
    rng = random.Random(4)
    word = lambda: rng.choice("the the the of whale sea ship captain rope storm".split())
    chunks = [(b, c, n, c * 2 + n, " ".join(word() for _ in range(rng.randint(3, 15)))) for b in ("x", "y") for c in range(12) for n in range(3)]
    asked = [(q, "x" if q % 3 else "y", rng.randint(5, 30), " ".join(word() for _ in range(4)) + " the") for q in range(9)]
    index = keyword.chunk_terms(spark.createDataFrame(chunks, "book_id string, chapter_order int, chunk_no int, location int, chunk string"))
    questions = spark.createDataFrame(asked, "question_id long, book_id string, boundary int, question string")
    got = as_set(keyword.keyword_search(questions, index, limit=5, **blocks).select("question_id", "rank_in_method", "chapter_order", "chunk_no", F.round("score", 6)))
    want = []
    for q, book, bound, text in asked:
        docs = [(c, n, l, t.split()) for b, c, n, l, t in chunks if b == book]
        avg = sum(len(d) for *_, d in docs) / len(docs)
        vocab = {w for *_, d in docs for w in d}
        df = {w: sum(w in d for *_, d in docs) for w in vocab}
        idf = {w: np.log(len(docs) - df[w] + 0.5) - np.log(df[w] + 0.5) for w in vocab}
        floor = 0.25 * np.mean(list(idf.values()))
        idf = {w: floor if x < 0 else x for w, x in idf.items()}
        scored = []
        for c, n, l, d in docs:
            s = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in text.split())
            if l <= bound and s > 0:
                scored.append((-round(s, 9), c, n))
        best = sorted(scored)[:5]
        want += [(q, i + 1, c, n, round(s / best[0][0] * 0.95, 6)) for i, (s, c, n) in enumerate(best)]
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=repr)]
    assert np.allclose([g[4] for g in got], [w[4] for w in sorted(want, key=repr)], atol=2e-6)


def test_chapter_at_with_gaps(spark, no_broadcast):
    rng = random.Random(6)
    chapters, spans = [], defaultdict(list)
    for book in ("a", "b"):
        at = 5
        for order in range(1, 40):
            end = at + rng.randint(0, 20)
            chapters.append((book, len(chapters), order, f"t{order}", at, end))
            spans[book].append((at, end, order, len(chapters) - 1))
            at = end + rng.choice([1, 1, 1, 9, 40])
    points = [(i, rng.choice(["a", "a", "b"]), rng.randint(-3, 900)) for i in range(300)] + [(1000, "zzz", 4)]
    cdf = spark.createDataFrame(chapters, "book_id string, chapter_id long, order int, title string, start_location int, end_location int")
    pdf = spark.createDataFrame(points, "id long, book_id string, location int")
    got = {r["id"]: r["chapter_id"] for r in locations.chapter_at(pdf, cdf, ["id"]).collect()}
    for i, book, at in points:
        inside = [c for s, e, _, c in spans[book] if s <= at <= e]
        before = [c for s, _, _, c in sorted(spans[book]) if s <= at]
        want = inside[0] if inside else before[-1] if before else spans[book][0][3] if spans[book] else None
        assert got[i] == want, (i, book, at)
    near = {r["chapter_id"]: (r["prev_chapter_id"], r["next_chapter_id"]) for r in locations.chapter_neighbours(cdf).collect()}
    assert near[0] == (None, 1) and near[5] == (4, 6) and near[38] == (37, None)


def replay(events, total, starts):
    """The update rules, one event at a time."""
    location, pct, chapter = 1, 0.0, None
    find = lambda at: next(c for c, (s, e) in starts.items() if s <= at <= e)
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        if e["reset"]:
            location, pct, chapter = 1, 0.0, None
            continue
        at = e["location"]
        if e["chapter_id"] in starts:
            chapter = e["chapter_id"]
            at = starts[chapter][0] if at is None else at
        if at is not None:
            location = min(max(1, int(at)), total)
            chapter = find(location) if chapter is None else chapter
            pct = location / total * 100
        elif e["completion_percentage"] is not None:
            pct = max(0.0, min(100.0, e["completion_percentage"]))
            if location <= 1:
                location = max(1, min(total, int(pct / 100 * total)))
    return location, round(pct, 9), chapter


def progress_case(seed, n=400):
    rng = random.Random(seed)
    starts = {10: (1, 30), 11: (31, 31), 12: (32, 80)}
    stamp = pd.Timestamp("2024-01-01")
    events = []
    for i in range(n):
        kind = rng.choice(["loc", "loc", "pct", "pct", "pct", "chapter", "both", "reset", "create", "bad"])
        events.append(
            {
                "reader_id": 1 if rng.random() < 0.5 else rng.randint(2, 30), "book_id": "b", "event_id": i,
                "ts": (stamp + pd.Timedelta(seconds=rng.randint(0, 40))).to_pydatetime(),
                "location": rng.randint(-2, 99) if kind in ("loc", "both") else None,
                "completion_percentage": rng.choice([0.0, 1.0, 50.0, 130.0, -4.0]) if kind in ("pct", "both") else None,
                "chapter_id": rng.choice([10, 11, 12]) if kind in ("chapter", "both") else 99 if kind == "bad" else None,
                "reset": kind == "reset",
            }
        )
    return events, starts


EVENTS = "reader_id long, book_id string, event_id long, ts timestamp, location int, completion_percentage double, chapter_id long, reset boolean"


@pytest.mark.parametrize("seed", range(3))
def test_progress_equals_replay(spark, no_broadcast, seed):
    events, starts = progress_case(seed)
    edf = spark.createDataFrame([tuple(e.values()) for e in events], EVENTS.replace("event_id long, ts timestamp", "event_id long, ts timestamp"))
    totals = spark.createDataFrame([("b", 80)], "book_id string, total_locations int")
    cdf = spark.createDataFrame([("b", c, i, "t", s, e) for i, (c, (s, e)) in enumerate(starts.items())], "book_id string, chapter_id long, order int, title string, start_location int, end_location int")
    got = {r["reader_id"]: (r["current_location"], round(r["completion_percentage"], 9), r["current_chapter_id"]) for r in progress.progress_state(edf, totals, cdf).collect()}
    by_reader = defaultdict(list)
    for e in events:
        by_reader[e["reader_id"]].append(e)
    assert got == {k: replay(v, 80, starts) for k, v in by_reader.items()}


def test_rows_without_time_or_model_stay(spark):
    rows = [(1, "a", "regular", 2.0), (2, "a", "regular", None), (3, None, "regular", 5.0), (4, "a", None, 4.0)]
    df = spark.createDataFrame(rows, "result_id long, model string, evaluation_type string, response_time double")
    share = {r["result_id"]: r["response_speed_percentile"] for r in analytics.with_speed_percentile(df).collect()}
    assert share == {1: 50.0, 2: None, 3: 100.0, 4: 100.0}
    assert {r["result_id"] for r in analytics.with_speed_rank(df).collect()} == {1, 2, 3, 4} == {r["result_id"] for r in analytics.with_speed(df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_chapter_at_with_overlaps_and_far_locations(spark, monkeypatch, seed):
    """Chapters that hold one another, a hot place, and a book above 2**31 locations, over segments of four locations."""
    monkeypatch.setattr(locations, "SEGMENT_IDS", 4)
    rng = random.Random(seed)
    chapters = []
    for book, base in (("a", 1), ("far", 5 * 2**31), (None, 1)):
        at = base
        for order in range(1, 25):
            chapters.append((book, len(chapters), order, f"t{order}", at, at + rng.choice([0, 1, 3, 30])))
            at += rng.choice([1, 2, 5, 20])
    points = [(i, *rng.choice([("a", 17), ("a", rng.randint(-2, 260)), (None, rng.randint(1, 90)), ("far", 5 * 2**31 + rng.randint(-9, 200)), ("a", None), ("no", 1)])) for i in range(250)]
    cdf = spark.createDataFrame(chapters, "book_id string, chapter_id long, order int, title string, start_location long, end_location long")
    pdf = spark.createDataFrame(points, "id long, book_id string, location long")
    found = locations.chapter_at(pdf, cdf, ["id"])
    assert found.columns == ["id", "book_id", "location", "chapter_id", "order", "title", "start_location", "end_location", "location_in_chapter", "chapter_locations", "match"]
    got = {r["id"]: (r["chapter_id"], r["match"]) for r in found.collect()}
    assert len(got) == len(points)
    for i, book, at in points:
        own = [c for c in chapters if c[0] == book]
        inside = [c for c in own if at is not None and c[4] <= at <= c[5]]
        before = [c for c in own if at is not None and c[4] <= at]
        kind = "containing" if inside else "preceding" if before else "first" if own else None
        want = (inside[:1] or before[-1:] or own[:1] or [(None, None)])[0][1]
        assert got[i] == (want, kind), (i, book, at)
