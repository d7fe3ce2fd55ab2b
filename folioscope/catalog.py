"""Every operator as a query over the given tables.

Each entry takes (spark, folder) and returns a DataFrame with stable column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope import config
from folioscope.functions import location as loc, parsing, scoring, text as tx
from folioscope.operators import (
    analytics, chunks as chunk_ops, evaluation, fusion, keyword, library, locations, maintenance, paging, passages,
    progress as progress_ops, similar_texts, summaries, vectors as vector_ops,
)
from folioscope.plans import evaluation as run_plan, ingest, retrieval
from folioscope.session import ship_package
from folioscope.sources import tables
from folioscope.sources.storage import materialise, spread
from folioscope.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def r6(column):
    return F.round(column, 6)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without zone, so results do not depend on the reader's zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


BERT = ["bert_precision", "bert_recall", "bert_f1"]


# --- library, chapters, locations -------------------------------------------


@query
def book_locations(spark, sf):
    return tables.chapters(spark, sf).select("book_id", "chapter_id", "order", "title", "n_chars", "n_locations", "start_location", "end_location")


@query
def book_totals(spark, sf):
    return tables.books(spark, sf)


def _chapters(spark, sf):
    """The chapter index as a stored table, for queries that use it repeatedly."""
    return materialise(tables.chapters(spark, sf), "chapters")


def _progress(spark, sf, chapters=None, totals=None):
    chapters = _chapters(spark, sf) if chapters is None else chapters
    totals = locations.book_totals(chapters) if totals is None else totals
    return progress_ops.progress_state(tables.progress_events(spark, sf), totals, chapters)


@query
def library_listing(spark, sf):
    books = tables.books(spark, sf)
    state = progress_ops.progress_state(tables.progress_events(spark, sf), books)
    rows = library.library_listing(books, state).withColumn("completion_percentage", r6("completion_percentage"))
    return ntz(rows, "last_read_at")


@query
def library_page(spark, sf):
    """Second page of ten books."""
    return library.page_of(tables.books(spark, sf), ["book_id"], skip=10, limit=10)


@query
def chapter_page(spark, sf):
    """The seventh page of 25 chapters in the order of the library, read through a page directory."""
    rows = tables.chapters(spark, sf).select("book_id", "order", "chapter_id", "title", "start_location", "end_location")
    return paging.Listing(rows, ["book_id", "order"]).page(150, 25)


@query
def book_detail(spark, sf):
    chapters = tables.chapters(spark, sf)
    detail = library.book_detail(locations.book_totals(chapters), chapters)
    return detail.select("book_id", "page", "total_chapters", "total_locations", F.to_json("chapters").alias("chapters"))


@query
def book_content(spark, sf):
    rows = library.book_content(tables.chapters(spark, sf), tables.chapter_texts(spark, sf))
    return rows.select("book_id", "chapter_id", "order", "title", "text")


@query
def chapter_lookup(spark, sf):
    """Chapters named by the labelled documents."""
    docs = tables.read(spark, sf, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"))
    wanted = docs.join(tables.read(spark, sf, "labels").select(F.col("doc_id").alias("chapter_id")), "chapter_id", "left_semi")
    return library.chapter_of(tables.chapters(spark, sf), wanted).select("book_id", "chapter_id", "order", "title", "start_location", "end_location")


@query
def chapter_neighbours(spark, sf):
    return locations.chapter_neighbours(tables.chapters(spark, sf))


@query
def chapter_by_location(spark, sf):
    points = tables.progress_events(spark, sf).filter(F.col("location").isNotNull()).select("event_id", "book_id", "location")
    return locations.chapter_at(points, _chapters(spark, sf), ["event_id"]).select(
        "event_id", "book_id", "location", "chapter_id", "order", "start_location", "end_location", "location_in_chapter", "chapter_locations", "match"
    )


@query
def text_at_location(spark, sf):
    chapters = _chapters(spark, sf)
    state = progress_ops.progress_state(tables.progress_events(spark, sf), locations.book_totals(chapters))
    points = state.select("reader_id", "book_id", F.col("current_location").alias("location"))
    return locations.text_at(points, chapters, tables.chapter_texts(spark, sf), ["reader_id"]).select("reader_id", "book_id", "location", "chapter_id", "window")


@query
def location_conversions(spark, sf):
    """Percentage, boundary, clamp and scroll arithmetic for every reading event."""
    events = tables.read(spark, sf, "events").select(
        "event_id", "value", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("book_id")
    )
    rows = locations.lookup_join(events, tables.books(spark, sf).select("book_id", "total_locations"), ["book_id"])
    total, at, pct = F.col("total_locations"), F.floor("value").cast("int"), F.least(F.lit(100.0), F.col("value"))
    return rows.select(
        "event_id", r6(loc.percentage_of(at, total)).alias("percentage"), loc.location_of_percentage(pct, total).alias("rounded_location"),
        loc.truncated_location_of_percentage(pct, total).alias("truncated_location"), loc.boundary_of(at, total).alias("boundary"),
        loc.clamp_location(at, total).alias("clamped"), loc.location_of_scroll(F.lit(1), total, pct / 100.0).alias("scrolled"),
    )


@query
def new_library_rows(spark, sf):
    """Book rows with defaults built from uploaded chapters."""
    uploads = tables.chapters(spark, sf).select(
        "book_id", "chapter_id", F.lit(None).cast("string").alias("book_title"), F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("chapter_title"), "order", "n_chars", "n_locations",
    )
    books, _, start = library.new_rows(uploads)
    return books.join(start, "book_id").select("book_id", "title", "author", "total_chapters", "total_locations", "content_length", "current_location", "completion_percentage")


@query
def contents_order(spark, sf):
    """Page links as a contents table: targets linked more than once are known."""
    links = tables.read(spark, sf, "pages").select(F.col("page_id").alias("book_id"), F.posexplode(tx.hrefs(F.col("html"))).alias("idx", "href"))
    entries = links.select("book_id", (F.col("idx") % 3).alias("parent_order"), (F.col("idx") + 1).alias("n"), F.col("href").alias("title"), "href")
    manifest = links.select("book_id", "href", F.md5("href").alias("item_id")).distinct()
    spine = library.readable_spine(links.select("book_id", "idx", F.md5("href").alias("item_id")))
    return library.contents_order(entries, manifest, spine).select("book_id", "title", "order", "spine_index")


# --- chunks and summaries ---------------------------------------------------


@query
def chunks(spark, sf):
    return tables.chunks(spark, sf).drop("content_type")


@query
def chunks_stream_mode(spark, sf):
    return chunk_ops.cut_chunks(tables.chapter_texts(spark, sf), mode="stream").select("chapter_id", "chunk_no", "char_pos", "chunk")


@query
def chunk_locations_batch(spark, sf):
    rows = tables.chunks(spark, sf, "batch_interpolated")
    totals = tables.books(spark, sf)
    located = locations.with_percentage(rows, totals, ["chapter_id", "chunk_no"])
    return located.select("book_id", "chapter_id", "chunk_no", "location", r6("completion_percentage").alias("completion_percentage"))


@query
def summary_segments(spark, sf):
    return summaries.summary_segments(tables.chunks(spark, sf)).select("book_id", "location", "n_chunks", "chapter_title", "text")


# --- keyword search ---------------------------------------------------------


def _store(spark, sf):
    """Tables built from the documents, once for every state of their files."""
    return Store(spark, [f"{sf}/documents.parquet"], tables="chapters by source")


def _keyword_index(spark, sf):
    return ingest.keyword_index(lambda: tables.chapters(spark, sf), tables.chapter_texts(spark, sf), keep=_store(spark, sf).keep)


@query
def bm25_stats(spark, sf):
    index = _keyword_index(spark, sf)
    terms = keyword.with_idf(index.frequency, index.statistics)
    return terms.select("book_id", "term", "df", "n_chunks", r6("avg_tokens").alias("avg_tokens"), r6("idf").alias("idf"))


@query
def bm25_topk(spark, sf):
    index = _keyword_index(spark, sf)
    questions = materialise(tables.questions(spark, sf, locations.book_totals(index.chapters)), "questions")
    hits = keyword.keyword_search(questions, index.chunks, lists=index.postings, frequency=index.frequency, books=index.statistics)
    return hits.select("question_id", "rank_in_method", "chapter_order", "chunk_no", "location", r6("score").alias("score"))


# --- vector search ----------------------------------------------------------


def _vector_probes(spark, sf):
    """Every vector asks for its neighbours up to half of its book."""
    rows = tables.vectors(spark, sf)
    ends = rows.groupBy("book_id").agg(F.greatest(F.lit(1), F.floor(F.max("location") / 2)).cast("int").alias("boundary"))
    return rows, locations.lookup_join(rows.select(F.col("vec_id").alias("question_id"), "book_id", "vector"), ends, ["book_id"])


@query
def vector_topk(spark, sf):
    rows, probes = _vector_probes(spark, sf)
    hits = vector_ops.similar_vectors(
        probes, rows, ["question_id"], ["vec_id"], ["location"], limit=15, threshold=-1.0, exclude_key=F.col("question_id").cast("string")
    )
    return hits.select("question_id", "rank_in_method", "vec_id", "location", r6("score").alias("score"))


@query
def vector_threshold(spark, sf):
    rows, probes = _vector_probes(spark, sf)
    hits = vector_ops.similar_vectors(
        probes, rows, ["question_id"], ["vec_id"], ["location"], limit=15, threshold=0.15, exclude_key=F.col("question_id").cast("string")
    )
    return hits.select("question_id", "rank_in_method", "vec_id", r6("score").alias("score"))


@query
def summary_search(spark, sf):
    rows, probes = _vector_probes(spark, sf)
    hits = vector_ops.similar_vectors(
        probes, rows, ["question_id"], ["vec_id"], ["location"], limit=5, threshold=-1.0, conditions={"content_type": "summary"},
        exclude_key=F.col("question_id").cast("string"),
    )
    return hits.select("question_id", "rank_in_method", "vec_id", r6("score").alias("score"))


# --- hybrid retrieval -------------------------------------------------------


def _corpus(spark, sf):
    return ingest.build_corpus(lambda: tables.chapters(spark, sf), tables.chapter_texts(spark, sf), keep=_store(spark, sf).keep)


def _expansion_replies(questions):
    """Stand-in replies: both halves of the question as a numbered list."""
    flat = F.regexp_replace("question", r"\s+", " ")
    half = F.floor(F.length(flat) / 2).cast("int")
    listed = F.concat(F.lit("Here are 2 queries:\n1. "), F.substring(flat, F.lit(1), half), F.lit("\n 2. "), F.substring(flat, half + 1, F.length(flat)))
    return questions.select("question_id", listed.alias("reply"))


def _rating_replies(ranked):
    """Stand-in ratings of the first passages, made from their places."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]: "), ((F.col("location") + F.col("rank") * 7) % 12).cast("string"))
    return ranked.filter(F.col("rank") <= config.RERANK_HEAD).groupBy("question_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("reply")
    )


def _ranked(spark, sf):
    corpus = _corpus(spark, sf)
    questions = materialise(tables.questions(spark, sf, corpus.totals), "questions")
    ranked = retrieval.retrieve(questions, corpus, _expansion_replies(questions))
    return corpus, questions, ranked


def _final(spark, sf):
    corpus, questions, ranked = _ranked(spark, sf)
    ranked = materialise(ranked, "ranked_text")
    return corpus, questions, fusion.apply_ratings(ranked, questions, _rating_replies(ranked))


@query
def expanded_queries(spark, sf):
    replies = _expansion_replies(tables.questions(spark, sf))
    return replies.select("question_id", F.posexplode(parsing.numbered_items(F.col("reply"))).alias("probe_no", "expanded_query"))


@query
def hybrid_retrieval(spark, sf):
    _, _, ranked = _ranked(spark, sf)
    return ranked.select(
        "question_id", "rank", "search_method", "kind_no", "chapter_order", "chunk_no", "location", "chapter_title",
        r6("score").alias("score"), r6("original_score").alias("original_score"), F.md5("text").alias("text_md5"),
    )


@query
def rerank_apply(spark, sf):
    _, _, final = _final(spark, sf)
    return final.select("question_id", "final_rank", "rank", "rerank_score", F.bround("score", 2).alias("relevance_score"), "search_method", "location")


@query
def context_block(spark, sf):
    corpus, questions, final = _final(spark, sf)
    rows = retrieval.answer_contexts(final, questions, corpus.totals)
    return rows.select("question_id", "book_id", "location_boundary", "prompt", F.coalesce(F.size("context_used"), F.lit(0)).alias("n_context"), "response")


@query
def context_dedupe(spark, sf):
    _, _, final = _final(spark, sf)
    return passages.dedupe_context(final).select("question_id", "passage_no", "final_rank", F.md5("text").alias("text_md5"))


@query
def near_duplicates(spark, sf):
    """Documents with their class, links and earliest near-duplicate."""
    return similar_texts.near_duplicates(tables.read(spark, sf, "documents"))


@query
def relevance_bands(spark, sf):
    _, _, ranked = _ranked(spark, sf)
    return ranked.groupBy("search_method", scoring.relevance_band(F.round("score", 9)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


# --- reading progress -------------------------------------------------------


@query
def progress_state(spark, sf):
    rows = _progress(spark, sf)
    return ntz(rows, "last_read_at").withColumn("completion_percentage", r6("completion_percentage"))


@query
def progress_view(spark, sf):
    chapters = _chapters(spark, sf)
    rows = progress_ops.progress_view(_progress(spark, sf, chapters), chapters)
    return rows.select("reader_id", "book_id", "current_location", "chapter_id", "chapter_order", "chapter_title", "resolved_chapter_id")


def _positions(spark, sf):
    return tables.progress_events(spark, sf).filter(F.col("location").isNotNull())


@query
def progress_sessions(spark, sf):
    return ntz(progress_ops.debounced_positions(_positions(spark, sf), 7200), "ts")


@query
def progress_throttled(spark, sf):
    # clock alignment without a zone
    rows = progress_ops.throttled_positions(ntz(_positions(spark, sf), "ts"), "6 hours")
    return ntz(rows, "ts", "window_start")


@query
def location_changes(spark, sf):
    """Moves between stretches of twenty locations."""
    coarse = _positions(spark, sf).withColumn("location", F.floor(F.col("location") / 20).cast("int"))
    return ntz(progress_ops.changed_positions(coarse), "ts")


# --- answer evaluation ------------------------------------------------------


def _answers(spark, sf):
    return tables.answers(spark, sf)


@query
def answer_pairs(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", "model", "item_id", "question", "answer", "ground_truth")


@query
def bleu(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", r6(scoring.bleu4(F.col("answer"), F.col("ground_truth"))).alias("bleu"))


@query
def answer_grounding(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", scoring.factual_grounding(F.col("answer"), F.col("ground_truth")).alias("factual_grounding"))


@query
def retrieval_effectiveness(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", r6(scoring.retrieval_effectiveness(F.col("question"), F.col("answer"))).alias("retrieval_effectiveness"))


@query
def answer_complexity(spark, sf):
    answer = F.col("answer")
    return _answers(spark, sf).select(
        "conv_id", "turn", scoring.sentence_count(answer).alias("sentence_count"),
        r6(scoring.avg_sentence_length(answer)).alias("avg_sentence_length"), r6(scoring.unique_word_ratio(answer)).alias("unique_word_ratio"),
    )


def _edge_answers(rows):
    """Answers with failures mixed in by turn and conversation."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    answer = (
        F.when(kind == 1, F.lit("  \n"))
        .when(kind == 2, F.concat(F.lit("ERROR: "), F.col("answer")))
        .when(kind == 3, F.concat(F.col("answer"), F.lit(" The Information needed to answer is NOT available.")))
        .otherwise(F.col("answer"))
    )
    return rows.withColumns({"answer": answer, "error": F.when((F.col("conv_id") % 11) == 0, F.lit("timeout"))})


@query
def error_class(spark, sf):
    rows = _edge_answers(_answers(spark, sf))
    return rows.select("conv_id", "turn", scoring.classify_error(F.col("answer"), F.col("error")).alias("error_type"))


@query
def spoiler_flags(spark, sf):
    rules = tables.spoiler_rules(spark, sf).withColumn("rule_no", F.col("item_id"))
    rows = _answers(spark, sf).withColumn("progress_stage", (F.lit(25) + (F.col("conv_id") % 14) * 5).cast("int"))
    flagged = evaluation.spoiler_flags(rows, rules, ["item_id"], ["conv_id", "turn"], "rule_no")
    return flagged.select("conv_id", "turn", "percentage_of_book_read", "spoiler_prevention_flag")


@query
def answer_scores(spark, sf):
    """All scores of one evaluation row at once, failures included."""
    rows = _edge_answers(_answers(spark, sf)).withColumns(
        {"context": F.col("ground_truth"), "evaluation_type": F.when(F.col("turn") % 4 == 0, "regular").otherwise("spoiler")}
    )
    scored = evaluation.score_answers(rows)
    return scored.select(
        "conv_id", "turn", r6("bleu").alias("bleu"), "factual_grounding", r6("retrieval_effectiveness").alias("retrieval_effectiveness"),
        "sentence_count", r6("avg_sentence_length").alias("avg_sentence_length"), r6("unique_word_ratio").alias("unique_word_ratio"), "error_type",
    )


def _judge_replies(spark, sf):
    """Judge replies in the shapes models produce, built from the events."""
    e = F.col("event_id")
    score = lambda k: (1 + (e * k) % 5).cast("string")
    body = F.concat(
        F.lit('{"contextual_fidelity": '), score(1), F.lit(', "relevance": '), score(2), F.lit(', "helpfulness": '), score(3),
        F.lit(', "coherence": '), score(4), F.lit(', "instruction_following": '), (e % 2).cast("string"), F.lit("}"),
    )
    shape = e % 5
    reply = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("Scores follow. "), body, F.lit(" Done.")))
        .when(shape == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 3, F.lit("I cannot score this."))
        .otherwise(F.concat(F.lit('Note {"relevance": 9} then '), body))
    )
    verdict = F.concat(F.lit('{"contains_spoilers": '), F.when(e % 3 == 0, "true").otherwise("false"), F.lit(', "reasoning": "r"}'))
    spoiler = F.when(shape == 3, F.lit("unclear")).when(shape == 1, F.concat(F.lit("Verdict: "), verdict)).otherwise(verdict)
    return spread(tables.read(spark, sf, "events"), "event_id").select("event_id", "event_type", reply.alias("reply"), spoiler.alias("spoiler_reply"))


@query
def judge_requests(spark, sf):
    rows = _edge_answers(_answers(spark, sf)).withColumns(
        {
            "result_id": F.col("conv_id") * 1000 + F.col("turn"), "book_id": F.col("model"),
            "evaluation_type": F.when(F.col("turn") % 4 == 0, "regular").otherwise("spoiler"), "progress_stage": (F.lit(25) + (F.col("conv_id") % 14) * 5).cast("int"),
        }
    )
    ruled = rows.join(tables.spoiler_rules(spark, sf), "item_id")
    return evaluation.judge_requests(ruled).select("result_id", "kind", F.md5("prompt").alias("prompt_md5"))


@query
def judge_parse(spark, sf):
    rows = _judge_replies(spark, sf).withColumn("j", parsing.judge_scores(F.col("reply")))
    return rows.select("event_id", *[F.col(f"j.{k}").alias(k) for k in config.JUDGE_KEYS])


@query
def judge_spoilers(spark, sf):
    flag = parsing.judge_spoiler_flag(F.col("spoiler_reply"), F.col("event_type"), F.array(F.lit("ERR"), F.lit("sign")))
    return _judge_replies(spark, sf).select("event_id", flag.alias("spoiler_prevention_flag"))


@query
def judge_verdicts(spark, sf):
    """Verdicts joined back onto results by stable id."""
    replies = _judge_replies(spark, sf).withColumnRenamed("event_id", "result_id")
    results = tables.results(spark, sf).select("result_id", "model", "evaluation_type", "spoiler_prevention_flag").join(
        replies.select("result_id", F.col("event_type").alias("answer")), "result_id"
    ).withColumn("forbidden_keywords", F.array(F.lit("ERR"), F.lit("sign")))
    judged = maintenance.present_in(replies, results.filter(F.col("evaluation_type") == "spoiler"), ["result_id"])
    verdicts = replies.select("result_id", F.lit("qualitative").alias("kind"), "reply").unionByName(
        judged.select("result_id", F.lit("spoiler").alias("kind"), F.col("spoiler_reply").alias("reply"))
    )
    return evaluation.apply_verdicts(results, verdicts).select("result_id", "contextual_fidelity", "spoiler_prevention_flag", "paas_score")


@query
def evaluation_run(spark, sf):
    """A scored run over all answers, with timing from the text lengths."""
    rows = _edge_answers(_answers(spark, sf)).withColumns(
        {
            "result_id": F.col("conv_id") * 1000 + F.col("turn"), "context": F.col("ground_truth"),
            "evaluation_type": F.when(F.col("turn") % 4 == 0, "regular").otherwise("spoiler"),
            "progress_stage": (F.lit(25) + (F.col("conv_id") % 14) * 5).cast("int"),
            "response_time": F.length("question") / 100.0,
        }
    )
    scored = materialise(run_plan.evaluate(rows, tables.spoiler_rules(spark, sf)), "scored")
    timed = run_plan.with_timing(scored, 1800.0, 1200.0)
    return timed.select(
        "result_id", "model", r6("bleu").alias("bleu"), "error_type", "spoiler_prevention_flag", "paas_score", "model_avg_time",
        "model_speed_rank", r6("response_speed_percentile").alias("response_speed_percentile"), r6("queries_per_minute").alias("queries_per_minute"),
    )


@query
def evaluation_grid(spark, sf):
    queries = tables.questions(spark, sf).select(F.col("question_id").alias("query_id"), "book_id")
    return evaluation.evaluation_grid(queries, [f"m{i}" for i in range(5)])


@query
def query_sets(spark, sf):
    regular = tables.questions(spark, sf).select(F.col("question_id").alias("query_id"), "book_id", "question")
    spoiler = regular.join(tables.spoiler_rules(spark, sf).select(F.col("item_id").alias("query_id"), "percentage_of_book_read"), "query_id")
    return evaluation.query_sets(regular, spoiler).select("query_id", "book_id", "evaluation_type", "progress_stage")


@query
def query_sample(spark, sf):
    queries = tables.questions(spark, sf).select(F.col("question_id").alias("query_id"), "book_id")
    return evaluation.sample_per_book(queries)


@query
def resume_run(spark, sf):
    """Grid pairs without a finished answer."""
    queries = tables.questions(spark, sf).select(F.col("question_id").alias("query_id"))
    done = _answers(spark, sf).select("model", F.col("item_id").alias("query_id"))
    return maintenance.unfinished(evaluation.evaluation_grid(queries, [f"m{i}" for i in range(5)]), done)


# --- result analytics -------------------------------------------------------


def _results(spark, sf):
    return tables.results(spark, sf)


def _regular(spark, sf):
    return _results(spark, sf).filter(F.col("evaluation_type") == "regular")


@query
def model_stats(spark, sf):
    return analytics.model_stats(_results(spark, sf))


@query
def type_stats(spark, sf):
    return analytics.type_stats(_results(spark, sf))


@query
def relative_speed(spark, sf):
    rows = analytics.with_speed(_results(spark, sf))
    return rows.select("result_id", "model_query_count", "type_query_count", r6("model_efficiency_score").alias("model_efficiency_score"), r6("relative_speed_vs_avg").alias("relative_speed_vs_avg"))


@query
def speed_rank(spark, sf):
    return analytics.with_speed_rank(_results(spark, sf)).select("result_id", "model_avg_time", "model_speed_rank")


@query
def speed_percentile(spark, sf):
    rows = analytics.with_speed_percentile(_results(spark, sf))
    return rows.select("result_id", r6("response_speed_percentile").alias("response_speed_percentile"))


@query
def run_rates(spark, sf):
    rows = analytics.run_rates(_results(spark, sf), 3600.0)
    return rows.select("total_queries_in_run", r6("avg_time_per_query").alias("avg_time_per_query"), r6("queries_per_minute").alias("queries_per_minute"))


@query
def throughput(spark, sf):
    rows = analytics.throughput(_results(spark, sf))
    return rows.select("model", F.round("total_time", 4).alias("total_time"), r6("avg_time").alias("avg_time"), r6("queries_per_minute").alias("queries_per_minute"), "n_queries")


@query
def run_summary(spark, sf):
    rows = analytics.summary_line(_results(spark, sf))
    return rows.select("spoiler_safe", "n_results", *[r6(c).alias(c) for c in ("spoiler_safe_pct", "mean_f1", "mean_paas")])


@query
def model_summary(spark, sf):
    return analytics.model_summary(_results(spark, sf))


@query
def scaled_metrics(spark, sf):
    rows = analytics.scaled_columns(_results(spark, sf))
    return rows.select("result_id", *[r6(c).alias(c) for c in ("response_time_log", "retrieval_effectiveness_log", "bleu_scaled")])


@query
def error_crosstab(spark, sf):
    return analytics.error_counts(_regular(spark, sf))


@query
def error_share(spark, sf):
    return analytics.error_shares(_regular(spark, sf)).withColumn("share", r6("share"))


@query
def figure_precision_recall(spark, sf):
    rows = analytics.metric_means(_regular(spark, sf), ["model"], BERT)
    return rows.select("model", *[r6(c).alias(c) for c in BERT])


@query
def robustness_stages(spark, sf):
    rows = analytics.robustness(_regular(spark, sf), BERT)
    return rows.select("model", "stage", *[r6(c).alias(c) for c in BERT])


@query
def robustness_bins(spark, sf):
    rows = analytics.robustness(_regular(spark, sf).withColumn("progress_stage", F.lit(100)), BERT)
    return rows.select("model", "stage", *[r6(c).alias(c) for c in BERT])


@query
def radar_norm(spark, sf):
    metrics = ["contextual_fidelity", "factual_grounding", "instruction_following", "paas_score"]
    rows = analytics.min_max_normalised(analytics.metric_means(_regular(spark, sf), ["model"], metrics), metrics)
    return rows.select("model", *[r6(c).alias(c) for c in metrics])


@query
def pareto_frontier(spark, sf):
    rows = analytics.speed_quality(_regular(spark, sf))
    return rows.select("model", *[r6(c).alias(c) for c in ("response_time", "bert_f1", "context_count", "efficiency")], "on_frontier")


@query
def median_guides(spark, sf):
    return analytics.median_guides(_regular(spark, sf)).select(r6("median_time").alias("median_time"), r6("median_f1").alias("median_f1"))


# --- web pages --------------------------------------------------------------


def _pages(spark, sf):
    return spread(tables.read(spark, sf, "pages"), "page_id")


@query
def html_text(spark, sf):
    """Pages with a line of references and inline tags added."""
    html = F.concat("html", F.lit("\n<p>wo<b>r</b>d caf&eacute;&nbsp;&#8217;&#x41;&#146;&unknown; R&D</p>"))
    return _pages(spark, sf).select("page_id", tx.html_to_text(html).alias("text"))


@query
def html_normalised(spark, sf):
    """Pages with nested empty elements and an image added."""
    html = F.concat("html", F.lit("<ul><li> </li><li><b>&nbsp;</b></li></ul><hr/><p><br></p><p>x<img src='a/b.png'/></p>"))
    return _pages(spark, sf).select("page_id", tx.normalise_html(html).alias("html"))


@query
def html_links(spark, sf):
    """Links of the pages, with some in other quotes or none added."""
    html = F.concat("html", F.lit("<a class=x href='q.html'>1</a><a href=r>2</a><a data-href=\"no\" href=\"s?a=1&amp;b=2\">3</a>"))
    rows = _pages(spark, sf).select("page_id", F.posexplode(tx.hrefs(html)).alias("n", "href"))
    return rows.withColumn("is_internal", tx.is_internal_link(F.col("href")))


@query
def html_titles(spark, sf):
    """Titles of pages; two thirds of them without headings, half of these by a marked block alone."""
    html = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.regexp_replace("html", r"<(/?)h1>", "<$1b>"))
    marked = F.concat(F.lit("<section class='Chapter-1'> Part <i>"), F.col("page_id").cast("string"), F.lit("</i></section>"))
    return _pages(spark, sf).select(
        "page_id", tx.chapter_title(F.when(F.col("page_id") % 3 == 2, marked).otherwise(html), F.col("url"), F.lit(0)).alias("title")
    )


@query
def image_refs(spark, sf):
    """Image references added to every page, resolved through name variants."""
    page = F.col("page_id").cast("string")
    html = F.concat("html", F.lit('<p><img alt="f" src="../Images/Fig_'), page, F.lit('.PNG"/><img src=\'img/missing.png\'/></p>'))
    refs = _pages(spark, sf).select(F.col("page_id").alias("book_id"), F.explode(tx.image_sources(html)).alias("src"))
    requests = refs.select("book_id", tx.base_name(F.col("src")).alias("name"))
    files = _pages(spark, sf).select(F.col("page_id").alias("book_id"), F.lower(F.concat(F.lit("FIG_"), page, F.lit(".png"))).alias("file_name"))
    return library.find_images(requests, files)


@query
def publication_years(spark, sf):
    """Years of order dates in several notations."""
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(
        F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy/MM")
    ).otherwise(F.date_format(day, "yyyy"))
    return tables.read(spark, sf, "orders").select("o_orderkey", tx.publication_year(text).alias("year"))


# --- table maintenance ------------------------------------------------------


@query
def incremental_ingest(spark, sf):
    """Chapters of books not among the labelled ones."""
    chapters = tables.chapters(spark, sf)
    docs = tables.read(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("chapter_id"))
    existing = chapters.join(docs, "chapter_id", "left_semi")
    return ingest.new_chapters(chapters.select("book_id", "chapter_id", "order"), existing)


@query
def vector_upsert(spark, sf):
    """All vectors upserted by half of them with a newer version."""
    rows = tables.vectors(spark, sf).select("vec_id", "book_id", "location", F.lit(1).alias("version"))
    newer = rows.withColumns({"location": F.col("location") + 1000, "version": F.when(F.col("vec_id") % 3 == 0, 2).otherwise(0)})
    return maintenance.upsert(rows, newer, ["vec_id"], "version")


@query
def cascade_delete(spark, sf):
    """Rows left per table after books with a toxic chapter are deleted."""
    chapters = tables.chapters(spark, sf)
    toxic = tables.read(spark, sf, "labels").filter((F.col("toxic") == 1) & (F.col("quality") == 0)).select(F.col("doc_id").alias("chapter_id"))
    deleted = chapters.join(toxic, "chapter_id", "left_semi")
    parts = {"chapters": chapters, "books": locations.book_totals(chapters), "events": tables.progress_events(spark, sf)}
    left = maintenance.delete_books({k: v.select("book_id") for k, v in parts.items()}, deleted)
    counted = [t.groupBy("book_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(k)) for k, t in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def patch_merge(spark, sf):
    """Reader settings patched by their later events."""
    events = tables.read(spark, sf, "events")
    last = lambda kind, column: F.max_by(F.when(F.col("event_type") == kind, F.col(column)), F.when(F.col("event_type") == kind, F.col("event_id")))
    base = events.groupBy("user_id").agg(last("click", "value").alias("font_size"), last("view", "event_type").alias("theme"))
    patch = events.filter(F.col("event_type") == "purchase").groupBy("user_id").agg(F.max_by("value", "event_id").alias("font_size"))
    return maintenance.merge_patch(base, patch, "user_id", {"font_size": 16.0, "theme": "light"})


@query
def title_match(spark, sf):
    """Questions' books found by their titles with a .txt suffix."""
    titles = tables.books(spark, sf).select("book_id", F.concat(F.lit(" Book "), F.upper("book_id")).alias("title"), F.col("total_locations").alias("added_no"))
    wanted = titles.select(F.concat(F.lit("book "), F.col("book_id"), F.lit(".txt ")).alias("title"))
    return maintenance.match_titles(wanted, titles)


@query
def stream_replies(spark, sf):
    """Token lines put together in arrival order, broken lines ignored."""
    from folioscope.streaming.replies import joined_replies

    turns = tables.read(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("text").alias("response")))).alias("line")
    )
    return joined_replies(turns, ["conv_id"], "turn")
