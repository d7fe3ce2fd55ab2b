"""Quality classifier, line dedup, decontamination and mixing."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import catalog, decontaminate as dc, lines, mixing, quality
from folioscope.llm.common import read
from tests.compare import compare, duck
from tests.llm.data import SMALL, awkward, documents, prose, rows_of


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SMALL, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) is None


# --- quality classifier ---------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in catalog.QUERIES["op10_quality"](spark, folder).collect()}
    labels = [r for r in read(spark, folder, "labels").collect() if found[r["doc_id"]]["held_out"]]
    assert len(found) == 1000 and len(labels) > 50
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found.values())
    assert np.mean([found[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) >= 0.97


def test_quality_does_not_learn_from_held_out_labels(spark):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x, per_class=20) for x in (labels, turned))
    # only the bias could tell, and it does not: the shares are those of the other rows
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_quality_awkward_rows(spark):
    docs = awkward(spark)
    model = quality.fit(read(spark, SMALL, "documents"), read(spark, SMALL, "labels"), per_class=20)
    scored = quality.scores(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "quality_score"] + ["quality_score"]
    found = rows_of(scored, "doc_id", "quality_score")
    bias = model.score(0, 0)
    assert len(found) == docs.count() and [s for i, s in found if i in (3, 4, 5, 6)] == [bias] * 4
    assert len({s for i, s in found if i in (1, 2)}) == 1
    kept = quality.filter_quality(docs, read(spark, SMALL, "labels").where("false"))
    assert rows_of(kept) == rows_of(docs)  # no labels: all accepted, own columns untouched
    assert quality.scores(docs.where("false"), model).count() == 0


def test_features_count_words_grams_and_repeats():
    found, lags = quality.feature_numbers("ab ab ab")
    assert len(found) == 3 + 3 * 2 + 3 and lags.tolist() == [2, 1, 0, 0, 0, 0, 0, 0]  # words, 3-grams with marks, 4-grams
    assert len(quality.feature_numbers(None)[0]) == 0


# --- line dedup -------------------------------------------------------------------


def plain_chunks(text):
    parts = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in parts]
    r = [(h[i] + (31 * h[i - 1] if i else 0)) % 2**32 for i in range(len(h))]
    if len(parts) < 2:
        return [(0, parts, False)]
    out, start = [], 0
    for i in range(len(parts)):
        if i == len(parts) - 1 or 1 <= i <= len(parts) - 3 and r[i] < r[i - 1] and r[i] < r[i + 1]:
            out.append((start, parts[start : i + 1], True))
            start = i + 1
    return out


def test_line_dedup_awkward_rows(spark):
    docs = awkward(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "removed_lines"] + ["removed_chunks", "removed_lines"]
    first = {}
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    for i, t in rows:
        for start, chunk, multi in plain_chunks(t) if t is not None else []:
            if multi:
                first.setdefault("\n".join(chunk), (i, t, start))
    want = []
    for r in docs.collect():
        t = r["text"]
        if t is not None:
            kept = [c for s, c, m in plain_chunks(t) if not m or first["\n".join(c)] == (r["doc_id"], t, s)]
            t = "\n".join("\n".join(c) for c in kept)
        want.append((r["doc_id"], t))
    assert rows_of(out, "doc_id", "text") == sorted(want, key=repr)
    assert {r["removed_lines"] for r in out.where("doc_id = 9").collect()} != {0}
    assert lines.dedup_lines(docs.where("false")).count() == 0


def test_line_chunks_return_after_an_insertion(spark):
    body = [prose(k, 6) for k in range(40)]
    docs = documents(spark, [(1, "\n".join(body)), (2, "\n".join(["a new line", *body[:20], "another", *body[20:]]))])
    left = {r["doc_id"]: r["removed_lines"] for r in lines.dedup_lines(docs).collect()}
    assert left[1] == 0 and left[2] >= 25


# --- decontamination ---------------------------------------------------------------


def test_search_finds_all_above_threshold():
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = []
    for item in range(60):
        terms = rng.choice(40, size=rng.integers(1, 9), replace=False)
        weight = rng.random(len(terms))
        rows += [(item, item, "x y", len(terms), f"t{t}".encode(), w) for t, w in zip(terms, weight / weight.sum())]
    part = pd.DataFrame(rows, columns=["item_key", "item_id", "text", "n_words", "term", "impact"])
    index = dc.Index.build(part)
    impact = {(r.item_key, r.term): r.impact for r in part.itertuples()}
    for size in (1, 3, 10, 25):
        for threshold in (0.1, 0.5, 0.9):
            asked = rng.choice(40, size=size, replace=False)
            terms = [index.vocabulary[f"t{t}".encode()] for t in asked if f"t{t}".encode() in index.vocabulary]
            found = {index.ids[i]: s for i, s in index.search(terms, threshold)}
            every = {i: sum(impact.get((i, f"t{t}".encode()), 0) for t in asked) for i in range(60)}
            assert found.keys() == {i for i, s in every.items() if s >= threshold - 1e-9}
            parts = [x for a, b in zip(index.edges, index.edges[1:]) for x in index.search(terms, threshold, int(a), int(b))]
            assert sorted(parts) == sorted(index.search(terms, threshold))
            assert all(abs(found[i] - every[i]) < 1e-9 for i in found)


def test_leaks_equal_brute_force(spark):
    found = {(r["item_id"], r["doc_id"]) for r in catalog.QUERIES["op2_decontaminate"](spark, SMALL).collect()}
    docs = [(r["doc_id"], dc.words_of(r["text"])) for r in read(spark, SMALL, "documents").collect()]
    want = set()
    for r in read(spark, SMALL, "benchmark").collect():
        every, cut = dc.shingles(dc.words_of(r["text"])), dc.question_length(r["text"])
        parts = every[: max(1, cut - 4)], every[max(1, cut - 4) :]
        for doc_id, words in docs:
            have = set(dc.shingles(words))
            if all(not p or sum(s in have for s in set(p)) >= 0.8 * len(set(p)) for p in parts):
                want.add((r["item_id"], doc_id))
    assert found == want and want


def test_leaks_awkward_rows(spark):
    question, answer = prose(50, 20) + ".", "Answer " + prose(51, 6) + "."
    items = spark.createDataFrame(
        [(1, f"{question} {answer}", 0), (1, f"{question} {answer}", 0), (2, None, 0), (3, "", 0), (4, "...", 0), (None, prose(5200, 12), 0), (5, "two words", 0)],
        "item_id long, text string, doc_id int",
    )
    docs = awkward(spark).select("doc_id", "text", "lang").union(documents(spark, [
        (20, f"{prose(60, 500)} {question.upper()}\n{answer} {prose(61, 400)}"), (21, f"{question} {prose(62, 9)}"), (22, prose(5200, 12)), (None, prose(5200, 12)), (22, prose(5200, 12)), (23, "Two, words!"),
    ]).select("doc_id", "text", "lang"))
    found = rows_of(dc.leaks(docs, items), "item_id", "doc_id")
    assert found == sorted([(1, 20), (None, 22), (None, None), (5, 23)], key=repr)  # 21 holds the question only
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns and {20, 22, 23}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.where("doc_id is null").count() == 0
    assert dc.leaks(docs.where("false"), items).count() == 0 and dc.leaks(docs, items.where("false")).count() == 0


# --- mixing -------------------------------------------------------------------------


def test_marginals_are_reached(spark):
    cells = spark.createDataFrame([(f"={s}", f"={l}", f"={t}", float(3 + 7 * s + 2 * l * t)) for s in range(4) for l in range(3) for t in range(2)], "source string, lang string, topic string, base double")
    goals = {d: mixing.tempered(cells, d) for d in mixing.DIMENSIONS}
    raked = mixing.rake(cells, goals, 15).collect()
    total = sum(r["base"] for r in raked)
    assert abs(sum(r["x"] for r in raked) - total) < 1e-6 * total
    for d, goal in goals.items():
        for r in goal.collect():
            assert abs(sum(x["x"] for x in raked if x[d] == r["key"]) / total - r["share"]) < 1e-6


def test_mixing_awkward_rows(spark):
    docs = awkward(spark)
    sample = mixing.mix(docs, keep=50.0, rounds=2)
    assert sample.columns == [c for c in docs.columns if c != "probability"] + ["topic", "tokens", "probability", "copies"]
    assert rows_of(sample, "doc_id", "text") == rows_of(docs, "doc_id", "text")  # every probability is above one
    few = mixing.mix(docs, rounds=2)
    assert len({r["doc_id"] for r in few.where("doc_id = 2").collect()}) * 2 == few.where("doc_id = 2").count()  # equal rows share their fate
    goal = spark.createDataFrame([("=src0", 1.0), ("=src1", 0.0), ("=src2", 0.0), ("null", 0.0)], "key string, share double")
    only = mixing.mix(docs.where("length(text) > 0"), {"source": goal}, keep=50.0, rounds=1)
    assert mixing.mix(docs.where("false"), rounds=1).count() == 0 and only.count() > 0


def test_expected_sample_has_the_target_weights(spark):
    docs = documents(spark, [(k, " ".join(["word"] * (900 if k % 5 == 0 else 7 + k % 4)) + ("!!" if k % 11 == 0 else "")) for k in range(150)])
    judged = mixing.probabilities(docs, None, mixing.KEEP, mixing.ROUNDS).cache()
    sums = judged.groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("base"), F.sum(F.col("tokens") * F.col("probability")).alias("expected")).cache()
    rows, total = sums.collect(), sums.agg(F.sum("expected")).first()[0]
    for d in mixing.DIMENSIONS:
        for r in mixing.tempered(sums, d).collect():
            assert abs(sum(x["expected"] for x in rows if x[d] == r["key"]) / total - r["share"]) < 1e-6
    assert abs(total - mixing.KEEP * sum(r["base"] for r in rows)) < 1e-6 * total
    copies = {r["doc_id"]: r["copies"] for r in corpus_pipeline.source_mixing(spark, docs, SMALL).collect()}
    want = judged.select("row.doc_id", "probability").collect()
    assert max(r["probability"] for r in want) > 1
    assert all(int(r["probability"]) <= copies.get(r["doc_id"], 0) <= int(r["probability"]) + 1 for r in want)


def test_query_has_the_target_weights(spark):
    """Every document's expected copies, over the given table: the shares of op9_mixing before anything is drawn."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sums = mixing.probabilities(docs, None, mixing.KEEP, mixing.ROUNDS).groupBy(*mixing.DIMENSIONS).agg(
        F.sum("tokens").alias("base"), F.sum(F.col("tokens") * F.col("probability")).alias("expected")).cache()
    rows, total = sums.collect(), sums.agg(F.sum("expected")).first()[0]
    for d in mixing.DIMENSIONS:
        for r in mixing.tempered(sums, d).collect():
            assert abs(sum(x["expected"] for x in rows if x[d] == r["key"]) / total - r["share"]) < 1e-6
