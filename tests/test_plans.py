import json

import pytest
from pyspark.sql import Row, functions as F

from folioscope.config import RetrievalParams
from folioscope.functions.hooks import join_replies, with_embedding, with_reply
from folioscope.operators import evaluation, fusion, library, maintenance
from folioscope.plans import evaluation as run_plan, figures, ingest, retrieval
from folioscope.sources import files, tables
from tests.conftest import SMALL
from tests.test_skew import as_set


@pytest.fixture(scope="module")
def corpus(spark):
    return ingest.build_corpus(tables.chapters(spark, SMALL), tables.chapter_texts(spark, SMALL))


@pytest.fixture(scope="module")
def questions(spark, corpus):
    return tables.questions(spark, SMALL, corpus.totals)


def test_nothing_past_the_boundary(spark, corpus, questions):
    ranked = retrieval.retrieve(questions, corpus)
    late = ranked.join(questions.select("question_id", "boundary"), "question_id").filter(F.col("location") > F.col("boundary"))
    assert late.count() == 0
    assert ranked.groupBy("question_id", "text_key").count().filter("count > 1").count() == 0
    both = ranked.filter((F.col("score") < 0) | (F.col("score") > 1))
    assert both.count() == 0


def test_unread_books_show_only_their_first_location(spark, corpus, questions):
    ranked = retrieval.retrieve(questions.withColumn("boundary", F.lit(1)), corpus)
    assert ranked.filter(F.col("location") > 1).count() == 0


def test_stored_corpus_gives_the_same_hits(spark, corpus, questions, tmp_path):
    folder = str(tmp_path / "library")
    chapters = tables.chapters(spark, SMALL)
    ingest.build_corpus(chapters, tables.chapter_texts(spark, SMALL), keep=ingest.stored_under(folder))
    again = ingest.load_corpus(spark, folder)
    columns = ["question_id", "rank", "search_method", "chapter_order", "chunk_no"]
    assert as_set(retrieval.retrieve(questions, again).select(columns)) == as_set(retrieval.retrieve(questions, corpus).select(columns))


def test_model_hooks(spark):
    df = spark.createDataFrame([(i, "w" * i) for i in range(1, 300)], "id int, t string")
    got = with_embedding(df, "t", "v", embed=lambda batch: [[float(len(x)), float(len(batch))] for x in batch], batch=50).collect()
    assert all(r["v"][0] == r["id"] and r["v"][1] <= 50 for r in got)
    got = with_reply(df, "t", "r", lambda prompts: [p[:3].upper() for p in prompts]).filter("id = 5").first()
    assert got["r"] == "WWW"
    replies = spark.createDataFrame([(1, "expand", "x"), (1, "rank", "y")], "id int, stage string, reply string")
    assert as_set(join_replies(df.filter("id < 3").select("id"), replies, ["id"], "rank", "r")) == [(1, "y"), (2, None)]


def hits(spark, rows):
    return spark.createDataFrame(
        [Row(question_id=q, search_method=m, probe_no=0, rank_in_method=n, score=s, text_key=t, location=1, text=t, chapter_title="C", content_type="content") for q, m, n, s, t in rows]
    )


def test_weights_need_both_searches(spark):
    rows = [(1, "vector", 1, 0.8, "a"), (1, "bm25", 1, 0.95, "b"), (2, "vector", 1, 0.8, "a"), (3, "bm25", 1, 0.95, "b"), (3, "summary", 1, 0.9, "s"), (3, "expanded_vector", 1, 0.6, "e")]
    got = {(r["question_id"], r["search_method"]): round(r["score"], 6) for r in fusion.weigh_scores(hits(spark, rows)).collect()}
    assert got == {(1, "vector"): 0.6, (1, "bm25"): 0.4, (2, "vector"): 0.8, (3, "bm25"): 0.95, (3, "summary"): 0.4, (3, "expanded_vector"): 0.7}


def test_rerank_limits_and_order(spark):
    rows = [(1, "vector", n, 1 - n / 100, f"t{n}") for n in range(1, 31)] + [(2, "vector", n, 1 - n / 100, f"t{n}") for n in range(1, 31)]
    ranked = fusion.rank_unique(hits(spark, rows))
    asked = spark.createDataFrame([(1, "who is the captain"), (2, "who is he")], "question_id long, question string")
    replies = spark.createDataFrame([(1, "[3]: 10\n[20]: 9\n[2]: 4"), (2, "[3]: 10")], "question_id long, reply string")
    got = fusion.apply_ratings(ranked, asked, replies).orderBy("question_id", "final_rank").collect()
    first = [r["rank"] for r in got if r["question_id"] == 1]
    assert first[:4] == [3, 2, 1, 4] and len(first) == 25 and first[14:] == list(range(15, 26))
    assert [r["rank"] for r in got if r["question_id"] == 2] == list(range(1, 11))
    blocks = fusion.context_blocks(fusion.apply_ratings(ranked, asked, replies)).filter("question_id = 2").first()
    assert blocks["context"].startswith("PASSAGE 1 (Chapter: C, Loc: 1):\nt1\n\nPASSAGE 2 ") and len(blocks["context_used"]) == 10
    assert fusion.rerank_prompts(ranked, asked).count() == 2


def test_no_hits_gives_no_context(spark):
    assert fusion.context_blocks(hits(spark, [(1, "bm25", 1, 1.0, "a")]).limit(0).withColumn("final_rank", F.lit(1))).count() == 0


def test_evaluation_run(spark):
    rules = tables.spoiler_rules(spark, SMALL)
    rows = tables.answers(spark, SMALL).withColumns(
        {
            "result_id": F.col("conv_id") * 100 + F.col("turn"), "context": F.col("answer"), "error": F.lit(None).cast("string"),
            "evaluation_type": F.when(F.col("turn") % 4 == 0, "regular").otherwise("spoiler"), "progress_stage": F.lit(30), "response_time": F.lit(2.0),
        }
    )
    verdicts = rows.select("result_id", F.lit("qualitative").alias("kind"), F.lit('{"contextual_fidelity": 4, "relevance": 4, "helpfulness": 4, "coherence": 4, "instruction_following": 1}').alias("reply"))
    out = run_plan.evaluate(rows, rules, verdicts)
    assert out.count() == rows.count()
    assert out.filter(F.col("paas_score") != 4 * F.col("spoiler_prevention_flag")).count() == 0
    plain = run_plan.evaluate(rows, rules).select("contextual_fidelity", "instruction_following").distinct().collect()
    assert [tuple(r) for r in plain] == [(1, 0)]
    timed = run_plan.with_timing(out, 10.0, 20.0)
    assert timed.count() == rows.count() and timed.first()["evaluation_total_duration"] == 30.0
    grid = run_plan.pending_work(rows.select(F.col("item_id").alias("query_id")).distinct(), ["m0", "m9"], rows.select("model", F.col("item_id").alias("query_id")))
    assert grid.filter("model = 'm9'").count() == rows.select("item_id").distinct().count()
    strict = evaluation.spoiler_flags(rows, rules.withColumn("n", F.lit(1)), ["item_id"], ["result_id"], "n", strict=True)
    assert strict.filter((F.col("progress_stage") >= F.col("percentage_of_book_read")) & (F.col("spoiler_prevention_flag") == 0)).count() == 0


def test_figure_tables(spark):
    out = figures.figure_tables(tables.results(spark, SMALL))
    counts = {name: df.count() for name, df in out.items()}
    assert counts["guides"] == 1 and counts["speed_quality"] == 5 and counts["robustness"] == 35 and counts["radar"] == 5


def test_library_rows(spark):
    up = spark.createDataFrame([("b", None, None, 1, None, 1, 10, 1), ("b", None, "Me", 2, "Two", 2, 2500, 3)], "book_id string, book_title string, author string, chapter_id int, chapter_title string, order int, n_chars int, n_locations int")
    books, chapters, progress = library.new_rows(up)
    assert tuple(books.first()) == ("b", "Unknown Title", "Me", 2, 4, 2510)
    assert [r["title"] for r in chapters.orderBy("order").collect()] == ["Untitled Chapter", "Two"]
    assert tuple(progress.first()) == ("b", 1, 0.0, None)
    content = library.book_content(chapters, spark.createDataFrame([(1, "x")], "chapter_id int, text string"))
    assert content.filter("text = '<p>Chapter content not found</p>'").count() == 1


def test_images(spark):
    images = spark.createDataFrame([("b", "OEBPS/img/My Pic-1.jpg", "i1")], "book_id string, path string, image_id string")
    assert as_set(library.image_names(images)) == sorted([("b", k, "My_Pic-1.jpg") for k in ("OEBPS/img/My Pic-1.jpg", "i1", "#i1")], key=repr)
    stored = spark.createDataFrame([("b", "a-b.jpg"), ("b", "a_b.jpg"), ("b", "C.JPG")], "book_id string, file_name string")
    asked = spark.createDataFrame([("b", "a_b.jpg"), ("b", "c.jpg"), ("b", "x.jpg")], "book_id string, name string")
    assert as_set(library.find_images(asked, stored)) == [("b", "a_b.jpg", "a_b.jpg", 0), ("b", "c.jpg", "C.JPG", 2)]


def test_maintenance(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, n int")
    new = spark.createDataFrame([(2, "B", 2), (3, "c", 2)], "id int, v string, n int")
    assert as_set(maintenance.upsert(base, new, ["id"], "n")) == [(1, "a", 1), (2, "B", 2), (3, "c", 2)]
    once = maintenance.upsert(base, new, ["id"], "n")
    assert as_set(maintenance.upsert(once, new, ["id"], "n")) == as_set(once)
    users = spark.createDataFrame([(1, 12.0, None)], "user_id int, size double, theme string")
    patch = spark.createDataFrame([(1, None), (2, 20.0)], "user_id int, size double")
    assert as_set(maintenance.merge_patch(users, patch, "user_id", {"size": 16.0, "theme": "light"})) == [(1, 12.0, "light"), (2, 20.0, "light")]
    assert as_set(maintenance.reset_to_defaults(users, "user_id", {"size": 16.0})) == [(1, 16.0)]


def test_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"book": "b", "query": "q\nr", "ground_truth": "g"}]))
    (tmp_path / "s.json").write_text(json.dumps([{"book": "b", "query": "q", "percentage_of_book_read": 40, "evaluation_rules": {"forbidden_keywords": ["x", "y"]}}]))
    assert as_set(files.comprehension_queries(spark, str(tmp_path / "q.json"))) == [("b", "q\nr", "g")]
    assert as_set(files.spoiler_rules(spark, str(tmp_path / "s.json"))) == [("b", "q", 40, ["x", "y"])]
    out = str(tmp_path / "results")
    rows = spark.createDataFrame([("m", 'He said "a, b"', 1.5)], ["model", " generated_answer ", "response_time"])
    files.append_results(rows, out)
    files.append_results(rows, out)
    back = files.results_csv(spark, out)
    assert back.columns == ["model", "generated_answer", "response_time"] and back.count() == 2
    files.replace_results(rows, out)
    assert files.results_csv(spark, out).count() == 1
    (tmp_path / "books").mkdir()
    for name in ("a.EPUB", "b.txt"):
        (tmp_path / "books" / name).write_text("x")
    assert [r["name"] for r in files.uploaded_books(spark, str(tmp_path / "books")).collect()] == ["a.EPUB"]
    (tmp_path / "ch").mkdir()
    (tmp_path / "ch" / "chapter_1.html").write_text("<p>a\nb</p>")
    assert files.chapter_files(spark, str(tmp_path / "ch")).first()["text"] == "<p>a\nb</p>"
    chapters = tables.chapters(spark, SMALL)
    files.save_book_metadata(files.book_metadata(tables.books(spark, SMALL), chapters), str(tmp_path / "meta"))
    documents = spark.read.json(str(tmp_path / "meta"))
    assert documents.count() == 20 and documents.select(F.sum(F.size("chapters"))).first()[0] == chapters.count()


def test_question_without_hits_gets_the_fixed_reply(spark, corpus, questions):
    none = hits(spark, [(-1, "bm25", 1, 1.0, "a")]).withColumn("final_rank", F.lit(1))
    rows = retrieval.answer_contexts(none, questions, corpus.totals)
    assert rows.count() == questions.count()
    assert rows.filter("prompt IS NOT NULL OR response IS NULL").count() == 0


def test_summaries_by_a_model(spark, corpus):
    short = lambda asks: [a.splitlines()[0][:9] for a in asks]
    made = ingest.embedded_summaries(corpus.chunks, summarise=short)
    assert made.count() == corpus.summaries.count()
    assert made.select("text").distinct().collect() == [Row(text="Summarise")]
    same = made.select("book_id", "location", "vector").exceptAll(corpus.summaries.select("book_id", "location", "vector"))
    assert same.count() == 0  # vectors are those of the raw text


def test_params_are_arguments(spark, corpus, questions):
    params = RetrievalParams(bm25_limit=2, vector_limit=3, summary_limit=1)
    got = retrieval.hits_of_all_searches(questions, corpus, params=params).groupBy("question_id", "search_method").count()
    most = {r["search_method"]: r["m"] for r in got.groupBy("search_method").agg(F.max("count").alias("m")).collect()}
    assert most["bm25"] == 2 and most["vector"] <= 3 and most.get("summary", 0) <= 1
