"""Tables kept by the state of their inputs, and the keyword index built on them."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import hooks
from folioscope.operators import keyword, summaries
from folioscope.plans import ingest
from folioscope.sources import tables
from folioscope.sources.storage import materialise
from folioscope.sources.store import Files, Store

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def inputs(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    return path


def files_below(root):
    return sorted(f for folder, _, names in os.walk(root) for f in names if not f.startswith((".", "_")))


def test_built_once_and_again_when_inputs_change(spark, tmp_path, inputs):
    root, made = str(tmp_path / "store"), []

    def build():
        made.append(1)
        return spark.read.parquet(inputs).withColumn("b", F.col("id") % 2)

    for _ in range(2):
        assert Store(spark, [inputs], root).keep(build, "t", "b").count() == 5
    assert len(made) == 1
    before = files_below(root)
    spark.range(5, 8).write.mode("append").parquet(inputs)
    again = Store(spark, [inputs], root).keep(build, "t", "b")
    assert len(made) == 2 and sorted(r["id"] for r in again.collect()) == list(range(8)) and again.columns == ["id", "b"]
    assert not set(before) & set(files_below(root))  # the old version is gone
    assert Store(spark, [inputs], root, size=3).keep(build, "t", "b").count() == 8 and len(made) == 3


def test_a_half_written_version_is_built_again(spark, tmp_path, inputs):
    root = str(tmp_path / "store")
    store = Store(spark, [inputs], root)

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.keep(broken, "t")
    assert store.keep(lambda: spark.range(2), "t").count() == 2 and store.built == ["t"]
    assert Store(spark, [inputs], root).keep(broken, "t").count() == 2


def test_other_inputs_and_fresh_folders_stay(spark, tmp_path, inputs):
    root, other = str(tmp_path / "store"), str(tmp_path / "other")
    spark.range(3).write.parquet(other)
    first = Store(spark, [inputs], root)
    first.keep(lambda: spark.range(1), "t")
    spark.range(1).write.parquet(f"{root}/t/{first.origin}/somebody-is-writing")
    spark.range(1).write.mode("append").parquet(inputs)
    Store(spark, [other], root).keep(lambda: spark.range(2), "t")
    Store(spark, [inputs], root).keep(lambda: spark.range(4), "t")
    assert Store(spark, [other], root).keep(lambda: spark.range(0), "t").count() == 2
    assert any(path.endswith("somebody-is-writing") for path, *_ in Files(spark, root).entries(f"{root}/t/{first.origin}"))


def test_an_index_of_no_chapters(spark, tmp_path):
    chapters, texts = tables.chapters(spark, SMALL).limit(0), tables.chapter_texts(spark, SMALL).limit(0)
    index = ingest.keyword_index(lambda: chapters, texts, keep=ingest.stored_under(str(tmp_path / "library")))
    assert index.postings.count() == 0 and index.statistics.count() == 0


def test_postings_count_every_token(spark):
    chunks = spark.createDataFrame(
        [("a", 1, 1, 1, "The the sea."), ("a", 1, 2, 1, "ship"), ("a", 2, 1, 5, "whale"), (None, 1, 1, 3, "the"), ("b", 2, 1, 1, ""), ("b", 2, 2, 1, None)],
        "book_id string, chapter_order int, chunk_no int, location int, chunk string",
    )
    index = keyword.chunk_terms(chunks)
    lists = keyword.postings(index)
    got = {(r.book_id, r.term, r.chapter_order, r.chunk_no): (r.tf, r.n_tokens) for r in lists.collect()}
    assert got == {("a", "the", 1, 1): (2, 4), ("a", "sea", 1, 1): (1, 4), ("a", ".", 1, 1): (1, 4), ("a", "ship", 1, 2): (1, 1), ("a", "whale", 2, 1): (1, 1), (None, "the", 1, 1): (1, 1)}
    asked = spark.createDataFrame([(1, "a", 5, "the ship ship"), (2, None, 5, "the"), (3, "none", 5, "the"), (4, "a", 0, "ship")], "question_id long, book_id string, boundary int, question string")
    hits = keyword.keyword_search(asked, index, lists=materialise(lists, "lists")).collect()
    assert {(h.question_id, h.chapter_order, h.chunk_no) for h in hits if h.question_id != 2} == {(1, 1, 1), (1, 1, 2)}


def test_a_search_shuffles_postings_once(spark, tmp_path):
    index = ingest.keyword_index(lambda: tables.chapters(spark, SMALL), tables.chapter_texts(spark, SMALL), keep=ingest.stored_under(str(tmp_path / "library")))
    hits = keyword.keyword_search(materialise(tables.questions(spark, SMALL), "questions"), index.chunks, lists=index.postings, frequency=index.frequency, books=index.statistics)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    assert plan.count("REPARTITION_BY_COL") == 1 and "WindowGroupLimit" in plan


def test_terms_are_counted_in_linear_time(spark):
    """A text of very many different words; nulls and lists across stretches keep their place."""
    words = [f"w{n}" for n in range(200_000)]
    rows = [(1, None), (2, ["a", "b", "a"]), (3, []), (4, words + words[:5])]
    started = time.time()
    counted = spark.createDataFrame(rows, "id int, tokens array<string>").coalesce(1).select("id", keyword.term_counts(F.col("tokens")).alias("t"))
    got = {r["id"]: {(p["term"], p["tf"]) for p in r["t"] or ()} for r in counted.collect()}
    assert got[1] == got[3] == set() and got[2] == {("a", 2), ("b", 1)}
    assert got[4] == {(w, 2 if n < 5 else 1) for n, w in enumerate(words)} and time.time() - started < 30


def test_postings_are_written_unsorted_with_their_chunks(spark):
    kept = {}

    def keep(build, name, by=None):
        kept[name] = (by, build())
        return materialise(kept[name][1], name)

    index = ingest.keyword_index(lambda: tables.chapters(spark, SMALL), tables.chapter_texts(spark, SMALL), keep=keep)
    plan = kept["chunks"][1]._jdf.queryExecution().executedPlan().toString()
    assert all(by is None for by, _ in kept.values()) and "postings" not in kept and plan.count("ArrowEvalPython") == 1
    again = keyword.postings(keyword.chunk_terms(index.chunks.drop("terms")))
    assert index.postings.exceptAll(again).count() == again.exceptAll(index.postings).count() == 0 < again.count()


def test_tokens_are_counted_in_bounded_stretches(monkeypatch):
    monkeypatch.setattr(hooks, "TOKENS_AT_ONCE", 10)
    lists = pa.array([["a", "b"]] * 3 + [None, []] + [["c"] * 25] + [["a", "c"]] * 12)
    parts = list(hooks.coded_tokens(lists))
    assert pa.concat_arrays([p[0] for p in parts]).to_pylist() == lists.to_pylist()
    assert all(len(codes) <= 10 or len(np.unique(owner)) <= 6 for _, owner, codes, _ in parts) and len(parts) > 3
    assert [distinct[int(c)].as_py() for _, _, codes, distinct in parts for c in codes] == [t for own in lists.to_pylist() for t in own or ()]


def test_texts_are_not_numbered_to_find_their_segment(spark, no_broadcast):
    """The first chunk of a location is found without sorting texts; null books keep their chunks."""
    rows = [(b, 1, n, 1 + n // 3, f"chunk {n}", "One") for b in ("a", None) for n in range(60)]
    chunks = spark.createDataFrame(rows, "book_id string, chapter_order int, chunk_no int, location int, chunk string, chapter_title string")
    found = summaries.summary_segments(chunks)
    assert "row_number" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["book_id"], r["location"], r["segment_no"], r["n_chunks"]) for r in found.collect()} == {("a", 11, 0, 31), ("a", 20, 1, 29), (None, 20, 1, 60)}
