"""The same queries as plain SQL, to check results with another engine.

Shared steps are named once in ``STEPS``; ``sql`` adds exactly the ones a query
needs as common table expressions.
"""

from __future__ import annotations

import re

STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\p{{Mn}}]+')"
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\p{{Mn}}]+|[^\p{{L}}\p{{N}}_\p{{Mn}}\s]')"
SPLIT = r"list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}]+'), lambda w: w <> '')"
BLANK = "(" + STRIP + " = '')"


def strip(x):
    return STRIP.format(x)


def words(x):
    return WORDS.format(x)


def tokens(x):
    return TOKENS.format(x)


def split(x):
    return SPLIT.format(x)


def blank(x):
    return BLANK.format(x)


def last_break(window, mark):
    return rf"length(regexp_extract({window}, '(?s)^(.*){mark}', 1))"


def cut(w):
    para = last_break(f"substr({w}, 201, 250)", r"\n\n")
    sent = last_break(f"substr({w}, 201, 230)", r"\. ")
    return f"CASE WHEN {para} > 0 THEN {para} + 202 WHEN {sent} > 0 THEN {sent} + 202 ELSE least(400, length({w})) END"


def bucket(term):
    return f"CAST('0x' || substr(md5({term}), 1, 6) AS BIGINT) % 64"


STEPS: dict[str, str] = {}

STEPS["ch1"] = """SELECT source AS book_id, doc_id AS chapter_id, length(text)::BIGINT AS n_chars,
  greatest(1, ceil(length(text) / 1000.0))::INT AS n_locations,
  (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS "order" FROM documents"""
STEPS["chapters"] = """SELECT *, 'Chapter ' || "order" AS title,
  (coalesce(sum(n_locations) OVER (PARTITION BY book_id ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::INT AS start_location,
  (sum(n_locations) OVER (PARTITION BY book_id ORDER BY "order" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INT AS end_location FROM ch1"""
STEPS["books"] = """SELECT book_id, count(*)::INT AS total_chapters, sum(n_locations)::INT AS total_locations,
  sum(n_chars)::BIGINT AS content_length FROM chapters GROUP BY book_id"""

STEPS["walk"] = f"""SELECT doc_id, 0 AS pos, {cut('substr(text, 1, 450)')} AS cut FROM documents
  UNION ALL
  SELECT n.doc_id, n.pos, {cut('substr(d.text, n.pos + 1, 450)')}
  FROM (SELECT doc_id, pos + greatest(cut - 50, 200) AS pos FROM walk) n JOIN documents d ON d.doc_id = n.doc_id WHERE n.pos < length(d.text)"""
STEPS["whole_pieces"] = f"""SELECT * FROM (SELECT w.doc_id, w.pos, {strip('substr(d.text, w.pos + 1, w.cut)')} AS chunk
  FROM walk w JOIN documents d ON d.doc_id = w.doc_id) WHERE length(chunk) > 0"""
STEPS["pieces"] = "SELECT * FROM whole_pieces UNION ALL SELECT doc_id, 0, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM whole_pieces)"
STEPS["swalk"] = f"""SELECT doc_id, 0 AS pos, CASE WHEN length(text) >= 600 THEN {cut('substr(text, 1, 450)')} ELSE length(text) END AS cut, length(text) >= 600 AS more
  FROM documents
  UNION ALL
  SELECT n.doc_id, n.pos, CASE WHEN length(d.text) - n.pos >= 600 THEN {cut('substr(d.text, n.pos + 1, 450)')} ELSE length(d.text) - n.pos END, length(d.text) - n.pos >= 600
  FROM (SELECT doc_id, pos + cut - 50 AS pos FROM swalk WHERE more) n JOIN documents d ON d.doc_id = n.doc_id"""
STEPS["swhole_pieces"] = f"""SELECT * FROM (SELECT w.doc_id, w.pos, {strip('substr(d.text, w.pos + 1, w.cut)')} AS chunk
  FROM swalk w JOIN documents d ON d.doc_id = w.doc_id) WHERE length(chunk) > 0"""
STEPS["spieces"] = "SELECT * FROM swhole_pieces UNION ALL SELECT doc_id, 0, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM swhole_pieces)"
STEPS["chunks"] = """SELECT c.book_id, c.chapter_id, c."order" AS chapter_order, c.title AS chapter_title,
  (row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos))::INT AS chunk_no, (count(*) OVER (PARTITION BY p.doc_id))::INT AS n_chunks,
  p.pos AS char_pos, greatest(c.start_location, least(c.end_location, c.start_location + p.pos // 1000))::INT AS location, p.chunk,
  c.start_location, c.end_location FROM pieces p JOIN chapters c ON c.chapter_id = p.doc_id"""

STEPS["tok"] = f"""SELECT book_id, chapter_order, chunk_no, location, len(t) AS dl, unnest(t) AS term
  FROM (SELECT *, {tokens('chunk')} AS t FROM chunks)"""
STEPS["tf"] = "SELECT book_id, chapter_order, chunk_no, location, dl, term, count(*) AS tf FROM tok GROUP BY ALL"
STEPS["df"] = "SELECT book_id, term, count(*) AS df FROM tf GROUP BY ALL"
STEPS["bst"] = f"SELECT book_id, count(*) AS n_chunks, sum(len({tokens('chunk')}))::DOUBLE / count(*) AS avg_tokens FROM chunks GROUP BY book_id"
STEPS["raw_idf"] = "SELECT d.*, b.n_chunks, b.avg_tokens, ln(b.n_chunks - d.df + 0.5) - ln(d.df + 0.5) AS x FROM df d JOIN bst b USING (book_id)"
STEPS["idf"] = """SELECT r.*, CASE WHEN x < 0 THEN 0.25 * m ELSE x END AS idf FROM raw_idf r
  JOIN (SELECT book_id, avg(x) AS m FROM raw_idf GROUP BY book_id) USING (book_id)"""

STEPS["questions"] = """SELECT item_id AS question_id, 'src' || (item_id % 20) AS book_id, text AS question, total_locations,
  greatest(1, total_locations // 2)::INT AS boundary FROM benchmark JOIN books ON books.book_id = 'src' || (item_id % 20)"""
STEPS["qtf"] = f"SELECT question_id, book_id, boundary, term, count(*) AS qtf FROM (SELECT *, unnest({tokens('question')}) AS term FROM questions) GROUP BY ALL"
STEPS["bm_scores"] = """SELECT q.question_id, q.book_id, tf.chapter_order, tf.chunk_no, tf.location,
  sum(q.qtf * i.idf * (tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.dl / i.avg_tokens)))) AS score
  FROM qtf q JOIN tf ON tf.book_id = q.book_id AND tf.term = q.term JOIN idf i ON i.book_id = q.book_id AND i.term = q.term
  WHERE tf.location <= q.boundary GROUP BY ALL"""
STEPS["bm_top"] = """SELECT *, score / max(score) OVER (PARTITION BY question_id) * 0.95 AS scaled FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chapter_order, chunk_no) AS rank_in_method
  FROM bm_scores WHERE score > 0) WHERE rank_in_method <= 10"""

STEPS["vec"] = """SELECT vec_id, label AS book_id, embedding::DOUBLE[] AS e, (row_number() OVER (PARTITION BY label ORDER BY vec_id))::INT AS location,
  CASE WHEN vec_id % 11 = 0 THEN 'summary' ELSE 'content' END AS content_type FROM embeddings"""
STEPS["vend"] = "SELECT book_id, greatest(1, max(location) // 2)::INT AS boundary FROM vec GROUP BY book_id"
STEPS["vpairs"] = """SELECT q.vec_id AS question_id, v.vec_id, v.location, v.content_type, list_cosine_similarity(q.e, v.e) AS score
  FROM vec q JOIN vend USING (book_id) JOIN vec v ON v.book_id = q.book_id AND v.location <= vend.boundary AND v.vec_id <> q.vec_id"""


def vtop(where, k):
    return f"""SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, vec_id))::INT AS rank_in_method,
  vec_id, location, round(score, 6) AS score FROM vpairs WHERE {where} QUALIFY rank_in_method <= {k}"""


# summary segments: replay chunk by chunk in book order
STEPS["cseq"] = "SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_order, chunk_no) AS rn FROM chunks"
STEPS["replay"] = """SELECT book_id, rn, CASE WHEN location >= 11 THEN location ELSE 0 END AS last, 0 AS seg, location >= 11 AS closed FROM cseq WHERE rn = 1
  UNION ALL
  SELECT c.book_id, c.rn, CASE WHEN c.location - r.last >= 11 THEN c.location ELSE r.last END, r.seg + CASE WHEN r.closed THEN 1 ELSE 0 END,
  c.location - r.last >= 11 FROM replay r JOIN cseq c ON c.book_id = r.book_id AND c.rn = r.rn + 1"""
STEPS["segments"] = """SELECT c.book_id, max(c.location) AS location, CASE WHEN bool_or(r.closed) THEN 0 ELSE 1 END AS segment_no, count(*) AS n_chunks,
  arg_max(c.chapter_title, c.rn) AS chapter_title, string_agg(c.chunk || ' ', '' ORDER BY c.rn) AS text
  FROM replay r JOIN cseq c ON c.book_id = r.book_id AND c.rn = r.rn GROUP BY c.book_id, r.seg"""

# all searchable items, their hashed token counts, and the probes
STEPS["items"] = """SELECT book_id, 0 AS kind_no, chapter_order, chunk_no, location, 'content' AS content_type, chapter_title, chunk AS text FROM chunks
  UNION ALL SELECT book_id, 1, location, segment_no, location, 'summary', chapter_title, text FROM segments"""
STEPS["iv"] = f"""SELECT book_id, kind_no, chapter_order, chunk_no, b, count(*) AS n FROM (
  SELECT book_id, kind_no, chapter_order, chunk_no, {bucket('term')} AS b FROM (SELECT *, unnest({tokens('text')}) AS term FROM items)) GROUP BY ALL"""
STEPS["inorm"] = "SELECT book_id, kind_no, chapter_order, chunk_no, sqrt(sum(n * n)::DOUBLE) AS len FROM iv GROUP BY ALL"
STEPS["expanded"] = r"""SELECT question_id, book_id, boundary, (row_number() OVER (PARTITION BY question_id ORDER BY part) - 1)::INT AS probe_no, t AS probe FROM (
  SELECT question_id, book_id, boundary, unnest([0, 1]) AS part, unnest([substr(f, 1, h), substr(f, h + 1)]) AS raw,
  regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t FROM (
  SELECT *, length(f) // 2 AS h FROM (SELECT *, regexp_replace(question, '\s+', ' ', 'g') AS f FROM questions))) WHERE length(t) > 5"""
STEPS["probes"] = """SELECT question_id, book_id, boundary, 0 AS probe_no, 'vector' AS search_method, 15 AS k, 0.6 AS threshold, NULL AS kind, question AS probe FROM questions
  UNION ALL SELECT question_id, book_id, boundary, 0, 'summary', 5, 0.65, 'summary', question FROM questions
  UNION ALL SELECT question_id, book_id, boundary, probe_no, 'expanded_vector', 5, 0.5, NULL, probe FROM expanded"""
STEPS["pv"] = f"""SELECT question_id, search_method, probe_no, b, count(*) AS n FROM (
  SELECT question_id, search_method, probe_no, {bucket('term')} AS b FROM (SELECT *, unnest({tokens('probe')}) AS term FROM probes)) GROUP BY ALL"""
STEPS["pnorm"] = "SELECT question_id, search_method, probe_no, sqrt(sum(n * n)::DOUBLE) AS len FROM pv GROUP BY ALL"
STEPS["dots"] = """SELECT p.question_id, p.search_method, p.probe_no, i.kind_no, i.chapter_order, i.chunk_no, i.book_id, sum(p.n * i.n)::DOUBLE AS d
  FROM pv p JOIN questions q USING (question_id) JOIN iv i ON i.book_id = q.book_id AND i.b = p.b GROUP BY ALL"""
STEPS["vec_hits"] = """SELECT * FROM (
  SELECT p.question_id, p.book_id, p.search_method, p.probe_no, p.k, d.kind_no, d.chapter_order, d.chunk_no, it.location,
  d.d / (pn.len * n.len) AS score,
  row_number() OVER (PARTITION BY p.question_id, p.search_method, p.probe_no ORDER BY round(d.d / (pn.len * n.len), 9) DESC, d.kind_no, d.chapter_order, d.chunk_no) AS rank_in_method
  FROM dots d JOIN probes p USING (question_id, search_method, probe_no) JOIN pnorm pn USING (question_id, search_method, probe_no)
  JOIN inorm n ON n.book_id = d.book_id AND n.kind_no = d.kind_no AND n.chapter_order = d.chapter_order AND n.chunk_no = d.chunk_no
  JOIN items it ON it.book_id = d.book_id AND it.kind_no = d.kind_no AND it.chapter_order = d.chapter_order AND it.chunk_no = d.chunk_no
  WHERE it.location <= p.boundary AND (p.kind IS NULL OR p.kind = it.content_type) AND round(d.d / (pn.len * n.len), 9) >= p.threshold
  ) WHERE rank_in_method <= k"""
STEPS["all_hits"] = """SELECT question_id, book_id, 'bm25' AS search_method, 0 AS m, 0 AS probe_no, rank_in_method, scaled AS score, 0 AS kind_no, chapter_order, chunk_no FROM bm_top
  UNION ALL SELECT question_id, book_id, search_method, CASE search_method WHEN 'vector' THEN 1 WHEN 'summary' THEN 2 ELSE 3 END, probe_no, rank_in_method, score, kind_no, chapter_order, chunk_no FROM vec_hits"""
STEPS["weighed"] = """SELECT *, CASE
    WHEN search_method = 'summary' THEN rel * 0.4::DOUBLE WHEN search_method = 'expanded_vector' THEN rel * 0.7::DOUBLE
    WHEN search_method = 'vector' AND both_present THEN rel * (1 - 0.4::DOUBLE) WHEN search_method = 'bm25' AND both_present THEN rel * 0.4::DOUBLE
    ELSE original_score END AS score FROM (
  SELECT * EXCLUDE (score), score AS original_score, score / max(score) OVER (PARTITION BY question_id, search_method) AS rel,
  bool_or(search_method = 'vector') OVER (PARTITION BY question_id) AND bool_or(search_method = 'bm25') OVER (PARTITION BY question_id) AS both_present FROM all_hits)"""
STEPS["ranked"] = """SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, m, probe_no, rank_in_method) AS rank,
  count(*) OVER (PARTITION BY question_id) AS n_unique FROM (
  SELECT w.*, i.text, i.location, i.chapter_title, i.content_type FROM weighed w
  JOIN items i ON i.book_id = w.book_id AND i.kind_no = w.kind_no AND i.chapter_order = w.chapter_order AND i.chunk_no = w.chunk_no
  QUALIFY row_number() OVER (PARTITION BY w.question_id, i.text ORDER BY round(w.score, 9) DESC, w.m, w.probe_no, w.rank_in_method) = 1)"""
STEPS["final"] = f"""SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC NULLS LAST, CASE WHEN rerank_score IS NOT NULL THEN round(score, 9) END DESC NULLS LAST, rank) AS final_rank
  FROM (SELECT r.*, q.question, q.boundary, q.total_locations, r.n_unique > 8 AND len({split('q.question')}) > 3 AS wants,
    CASE WHEN r.n_unique > 8 AND len({split('q.question')}) > 3 AND r.rank <= 15 THEN greatest(1, least(10, (r.location + r.rank * 7) % 12)) END AS rerank_score
    FROM ranked r JOIN questions q USING (question_id))
  QUALIFY final_rank <= CASE WHEN wants THEN 25 ELSE 10 END"""
STEPS["blocks"] = """SELECT question_id, any_value(boundary) AS boundary, any_value(book_id) AS book_id, any_value(total_locations) AS total_locations,
  any_value(question) AS question, count(*)::INT AS n_context,
  string_agg('SUMMARY (Chapter: ' || chapter_title || ', Loc: ' || location || '):' || chr(10) || text || chr(10), chr(10) ORDER BY final_rank) FILTER (search_method = 'summary') AS s,
  string_agg('PASSAGE ' || final_rank || ' ' || CASE search_method WHEN 'bm25' THEN '[KW] ' WHEN 'expanded_vector' THEN '[EX] ' ELSE '' END ||
    '(Chapter: ' || chapter_title || ', Loc: ' || location || '):' || chr(10) || text || chr(10), chr(10) ORDER BY final_rank) FILTER (search_method <> 'summary') AS p
  FROM final GROUP BY question_id"""
STEPS["kept"] = f"""SELECT question_id, 1::BIGINT AS n, [struct_pack(r := final_rank, t := {strip('text')})] AS kept FROM final WHERE final_rank = 1
  UNION ALL
  SELECT k.question_id, k.n + 1, CASE WHEN len(list_filter(k.kept, lambda x: x.t = {strip('f.text')} OR (length(x.t) > 50 AND length({strip('f.text')}) > 50 AND
    len(list_intersect(list_distinct({split('lower(x.t)')}), list_distinct({split('lower(' + strip('f.text') + ')')})))::DOUBLE /
    len(list_distinct(list_concat({split('lower(x.t)')}, {split('lower(' + strip('f.text') + ')')}))) > 0.7))) > 0
    THEN k.kept ELSE list_append(k.kept, struct_pack(r := f.final_rank, t := {strip('f.text')})) END
  FROM kept k JOIN final f ON f.question_id = k.question_id AND f.final_rank = k.n + 1"""

# reading progress: replay event by event
STEPS["pe"] = """SELECT user_id AS reader_id, 'src' || (user_id % 20) AS book_id, ts, event_id,
  CASE WHEN event_type IN ('click', 'view') THEN floor(value)::INT END AS location,
  CASE WHEN event_type = 'purchase' THEN value END AS pct, event_type = 'error' AS reset FROM events"""
STEPS["ps"] = """SELECT pe.*, b.total_locations AS total, CASE WHEN location IS NOT NULL THEN least(greatest(1, location), b.total_locations) END AS loc,
  CASE WHEN pct IS NOT NULL THEN greatest(0.0, least(100.0, pct)) END AS p, row_number() OVER (PARTITION BY reader_id, pe.book_id ORDER BY ts, event_id) AS rn FROM pe JOIN books b USING (book_id)"""
STEPS["pr"] = """SELECT reader_id, book_id, 0::BIGINT AS rn, 1 AS cur, 0.0::DOUBLE AS cp, NULL::INT AS held, NULL::TIMESTAMP AS last_read_at FROM (SELECT DISTINCT reader_id, book_id FROM ps)
  UNION ALL
  SELECT r.reader_id, r.book_id, e.rn,
    CASE WHEN e.reset THEN 1 WHEN e.loc IS NOT NULL THEN e.loc WHEN e.p IS NOT NULL AND r.cur <= 1 THEN greatest(1, least(e.total, trunc(e.p / 100.0 * e.total)::INT)) ELSE r.cur END,
    CASE WHEN e.reset THEN 0.0 WHEN e.loc IS NOT NULL THEN least(100.0, e.loc::DOUBLE / e.total * 100.0) WHEN e.p IS NOT NULL THEN e.p ELSE r.cp END,
    CASE WHEN e.reset THEN NULL WHEN e.loc IS NOT NULL THEN coalesce(r.held, e.loc) ELSE r.held END,
    CASE WHEN e.reset OR e.loc IS NOT NULL OR e.p IS NOT NULL THEN e.ts ELSE r.last_read_at END
  FROM pr r JOIN ps e ON e.reader_id = r.reader_id AND e.book_id = r.book_id AND e.rn = r.rn + 1"""
STEPS["state"] = """SELECT p.reader_id, p.book_id, p.cur::INT AS current_location, p.cp AS completion_percentage, p.last_read_at, c.chapter_id AS current_chapter_id
  FROM (SELECT * FROM pr QUALIFY rn = max(rn) OVER (PARTITION BY reader_id, book_id)) p
  LEFT JOIN chapters c ON c.book_id = p.book_id AND p.held BETWEEN c.start_location AND c.end_location"""

STEPS["ans"] = """SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, b.item_id, b.text AS ground_truth, 'm' || (u.conv_id % 5) AS model
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  JOIN benchmark b ON b.item_id = u.conv_id % (SELECT count(*) FROM benchmark) WHERE u.role = 'user'"""
STEPS["edge"] = """SELECT * REPLACE (CASE (conv_id + turn) % 5 WHEN 1 THEN '  ' || chr(10) WHEN 2 THEN 'ERROR: ' || answer
  WHEN 3 THEN answer || ' The Information needed to answer is NOT available.' ELSE answer END AS answer),
  CASE WHEN conv_id % 11 = 0 THEN 'timeout' END AS error FROM ans"""

STEPS["res"] = """SELECT *, contextual_fidelity * spoiler_prevention_flag AS paas_score FROM (
  SELECT event_id AS result_id, 'm' || (user_id % 5) AS model, CASE WHEN event_id % 2 = 0 THEN 'regular' ELSE 'spoiler' END AS evaluation_type,
  value AS response_time, CASE event_type WHEN 'error' THEN 'api_error' WHEN 'signup' THEN 'empty_response' ELSE 'none' END AS error_type,
  (event_id % 7)::INT AS context_count, (25 + (event_id % 14) * 5)::INT AS progress_stage, k / 100.0::DOUBLE AS bert_f1,
  (event_id % 97) / 97.0::DOUBLE AS bert_precision, (user_id % 89) / 89.0::DOUBLE AS bert_recall, (1 + event_id % 5)::INT AS contextual_fidelity,
  (event_id % 6)::INT AS factual_grounding, (user_id % 2)::INT AS instruction_following, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS spoiler_prevention_flag,
  (k % 11) / 10.0::DOUBLE AS retrieval_effectiveness, (k % 13) / 1000.0::DOUBLE AS bleu
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))"""
STEPS["reg"] = "SELECT * FROM res WHERE evaluation_type = 'regular'"
STEPS["mst"] = """SELECT model, count(*) AS model_query_count, round_even(sum(response_time), 2)::DOUBLE AS model_total_time,
  round_even(avg(response_time), 2)::DOUBLE AS model_avg_time, round_even(stddev_samp(response_time), 2)::DOUBLE AS model_time_stddev FROM res GROUP BY model"""
STEPS["tst"] = """SELECT evaluation_type, count(*) AS type_query_count, round_even(sum(response_time), 2)::DOUBLE AS type_total_time,
  round_even(avg(response_time), 2)::DOUBLE AS type_avg_time FROM res GROUP BY evaluation_type"""
STEPS["judge"] = """SELECT event_id, event_type, event_id % 5 AS shape,
  CASE WHEN event_id % 5 = 3 THEN 1 ELSE 1 + event_id % 5 END AS cf, CASE WHEN event_id % 5 = 3 THEN 1 ELSE 1 + (event_id * 2) % 5 END AS re,
  CASE WHEN event_id % 5 = 3 THEN 1 ELSE 1 + (event_id * 3) % 5 END AS he, CASE WHEN event_id % 5 = 3 THEN 1 ELSE 1 + (event_id * 4) % 5 END AS co,
  CASE WHEN event_id % 5 = 3 THEN 0 ELSE event_id % 2 END AS i,
  CASE WHEN event_id % 5 = 3 THEN CASE WHEN contains(lower(event_type), 'err') OR contains(lower(event_type), 'sign') THEN 0 ELSE 1 END
    WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS sf FROM events"""

ENTITIES = [("&nbsp;", chr(160)), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def decoded(x):
    for entity, char in ENTITIES:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def dropped(x, *patterns):
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


_SKELETON = (r"<\?xml[^>]+\?>|<!DOCTYPE[^>]+>", "(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?is)<head\b[^>]*>.*?</head\s*>")
_BARE = decoded(dropped("html", *_SKELETON, "(?s)</?[a-zA-Z][^>]*>"))

_N = "'[\\s\\p{Z}]+'"


def grams(x, n):
    return f"[array_to_string({x}[i:i + {n - 1}], ' ') for i in range(1, len({x}) - {n - 2})]"


def _bleu(source):
    steps = []
    for n in (1, 2, 3, 4):
        steps.append(
            f"SELECT conv_id, turn, {n} AS n, greatest(1, lh - {n - 1}) AS total, coalesce((SELECT sum(least(a.c, b.c)) FROM "
            f"(SELECT g, count(*) c FROM (SELECT unnest({grams('h', n)}) g) GROUP BY g) a JOIN (SELECT g, count(*) c FROM (SELECT unnest({grams('r', n)}) g) GROUP BY g) b USING (g)), 0) AS hits, lh, lr FROM hr"
        )
    return f"""hr AS (SELECT conv_id, turn, h, r, len(h) AS lh, len(r) AS lr FROM (SELECT conv_id, turn, {split('lower(answer)')} AS h, {split('lower(ground_truth)')} AS r FROM {source}
      WHERE NOT {blank('answer')} AND NOT contains(answer, 'ERROR:'))),
  ng AS ({' UNION ALL '.join(steps)}),
  bl AS (SELECT conv_id, turn, CASE WHEN max(hits) FILTER (n = 1) = 0 THEN 0.0 ELSE exp(avg(ln(CASE WHEN hits = 0 THEN 0.1 ELSE hits END / total)))
    * CASE WHEN any_value(lh) > any_value(lr) THEN 1.0 ELSE exp(1 - any_value(lr)::DOUBLE / any_value(lh)) END END AS bleu FROM ng GROUP BY conv_id, turn)"""


_STOP = "['a','an','the','is','it','in','on','of','for','to','and','but','was','were']"
_STOP2 = "['a','an','the','is','it','in','on','of','for','to','and','but','was','were','with','by']"


def share(wanted, present, stop):
    need = f"list_filter(list_distinct({words(wanted)}), lambda w: NOT list_contains({stop}, w))"
    return f"(len(list_intersect({need}, list_distinct({words(present)})))::DOUBLE / nullif(len({need}), 0))"


def grounding(a, t):
    s = share(t, a, _STOP)
    return (
        f"CASE WHEN {blank(a)} THEN 0 WHEN contains({a}, 'ERROR:') OR contains(lower({a}), 'information needed to answer is not available') THEN 5 "
        f"WHEN {s} IS NULL THEN 3 WHEN {s} >= 0.7 THEN 5 WHEN {s} >= 0.5 THEN 4 WHEN {s} >= 0.3 THEN 3 WHEN {s} >= 0.1 THEN 2 ELSE 1 END"
    )


def sentences(a):
    return rf"len(list_filter(regexp_split_to_array({strip(a)}, '[.!?]+'), lambda s: NOT {blank('s')}))"


def complexity(a):
    w = words(a)
    return (
        f"CASE WHEN {blank(a)} THEN 0 ELSE {sentences(a)} END::INT AS sentence_count, "
        f"CASE WHEN {blank(a)} THEN 0.0 ELSE round(coalesce(len({w})::DOUBLE / nullif({sentences(a)}, 0), 0.0), 6) END AS avg_sentence_length, "
        f"CASE WHEN {blank(a)} THEN 0.0 ELSE round(coalesce(len(list_distinct({w}))::DOUBLE / nullif(len({w}), 0), 0.0), 6) END AS unique_word_ratio"
    )


_ERRORS = f"""CASE WHEN error IS NOT NULL THEN 'api_error' WHEN {blank('answer')} THEN 'empty_response' WHEN contains(answer, 'ERROR:') THEN 'generation_error'
  WHEN contains(lower(answer), 'information needed to answer is not available') THEN 'insufficient_context' ELSE 'none' END"""

_MEANS = "round(avg(bert_precision), 6) AS bert_precision, round(avg(bert_recall), 6) AS bert_recall, round(avg(bert_f1), 6) AS bert_f1"

BODIES: dict[str, str] = {
    "book_locations": 'SELECT book_id, chapter_id, "order", title, n_chars, n_locations, start_location, end_location FROM chapters',
    "book_totals": "SELECT * FROM books",
    "library_listing": """SELECT b.book_id, s.reader_id, total_chapters, total_locations, coalesce(current_location, 0) AS current_location,
      round(coalesce(completion_percentage, 0.0), 6) AS completion_percentage, last_read_at FROM books b LEFT JOIN state s USING (book_id)""",
    "library_page": "SELECT * FROM books ORDER BY book_id LIMIT 10 OFFSET 10",
    "chapter_page": """SELECT book_id, "order", chapter_id, title, start_location, end_location FROM chapters
      ORDER BY book_id NULLS FIRST, "order" LIMIT 25 OFFSET 150""",
    "book_detail": """SELECT book_id, 0 AS page, any_value(total_chapters) AS total_chapters, any_value(total_locations) AS total_locations,
      to_json(list(struct_pack("order" := "order", chapter_id := chapter_id, title := title, start_location := start_location, end_location := end_location) ORDER BY "order"))::VARCHAR AS chapters
      FROM chapters JOIN books USING (book_id) GROUP BY book_id""",
    "book_content": 'SELECT c.book_id, c.chapter_id, c."order", c.title, d.text FROM chapters c JOIN documents d ON d.doc_id = c.chapter_id',
    "chapter_lookup": 'SELECT book_id, chapter_id, "order", title, start_location, end_location FROM chapters WHERE chapter_id IN (SELECT doc_id FROM labels)',
    "chapter_neighbours": """SELECT book_id, chapter_id, "order", lag(chapter_id) OVER w AS prev_chapter_id, lead(chapter_id) OVER w AS next_chapter_id
      FROM chapters WINDOW w AS (PARTITION BY book_id ORDER BY "order")""",
    "chapter_by_location": """SELECT event_id, x.book_id, location, c.chapter_id, c."order", c.start_location, c.end_location, location - c.start_location AS location_in_chapter,
      c.end_location - c.start_location + 1 AS chapter_locations, CASE WHEN location BETWEEN c.start_location AND c.end_location THEN 'containing'
      WHEN c.start_location <= location THEN 'preceding' ELSE 'first' END AS match
      FROM (SELECT event_id, book_id, location, (SELECT coalesce(
        max(chapter_id) FILTER (pe.location BETWEEN start_location AND end_location), arg_max(chapter_id, start_location) FILTER (start_location <= pe.location), arg_min(chapter_id, "order"))
        FROM chapters c WHERE c.book_id = pe.book_id) AS cid FROM pe WHERE location IS NOT NULL) x JOIN chapters c ON c.chapter_id = x.cid""",
    "text_at_location": """SELECT reader_id, s.book_id, current_location AS location, c.chapter_id,
      substr(d.text, greatest(0, pos - 100) + 1, least(length(d.text), pos + 100) - greatest(0, pos - 100)) AS "window"
      FROM state s JOIN chapters c ON c.book_id = s.book_id AND s.current_location BETWEEN c.start_location AND c.end_location JOIN documents d ON d.doc_id = c.chapter_id,
      LATERAL (SELECT least(length(d.text) - 1, (s.current_location - c.start_location) * 1000) AS pos)""",
    "location_conversions": """SELECT event_id, round(least(100.0, greatest(0.0, l::DOUBLE / t * 100.0)), 6) AS percentage,
      CASE WHEN p <= 0 THEN 1 WHEN p >= 100 THEN t ELSE greatest(1, least(t, round_even(p / 100.0 * t, 0)::INT)) END::INT AS rounded_location,
      greatest(1, least(t, trunc(p / 100.0 * t)::INT))::INT AS truncated_location, (CASE WHEN l <= 0 THEN 1 ELSE least(l, t) END)::INT AS boundary,
      least(greatest(1, l), t)::INT AS clamped, greatest(1, least(t, floor(1 + t * (p / 100.0))::INT))::INT AS scrolled
      FROM (SELECT event_id, floor(value)::INT AS l, least(100.0, value) AS p, total_locations AS t FROM events JOIN books ON books.book_id = 'src' || (user_id % 20))""",
    "new_library_rows": """SELECT book_id, 'Unknown Title' AS title, 'Unknown Author' AS author, total_chapters, total_locations, content_length, 1 AS current_location,
      0.0::DOUBLE AS completion_percentage FROM books""",
    "contents_order": r"""SELECT book_id, href AS title, (idx % 3) * 100 + idx + 1 AS "order", min(idx) OVER (PARTITION BY book_id, href) AS spine_index FROM (
      SELECT book_id, unnest(range(len(h)))::INT AS idx, unnest(h) AS href FROM (SELECT page_id AS book_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1) AS h FROM pages))""",
    "chunks": "SELECT book_id, chapter_id, chapter_order, chapter_title, chunk_no, n_chunks, char_pos::INT AS char_pos, location, chunk FROM chunks",
    "chunks_stream_mode": "SELECT doc_id AS chapter_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INT AS chunk_no, pos::INT AS char_pos, chunk FROM spieces",
    "chunk_locations_batch": """SELECT book_id, chapter_id, chunk_no, location, round(least(100.0, location::DOUBLE / total_locations * 100.0), 6) AS completion_percentage FROM (
      SELECT book_id, chapter_id, chunk_no, greatest(start_location, least(end_location,
      floor(start_location + (end_location - start_location)::DOUBLE / (least(120, n_chunks - (chunk_no - 1) // 120 * 120) + 1) * ((chunk_no - 1) % 120 + 1))))::INT AS location FROM chunks) JOIN books USING (book_id)""",
    "summary_segments": "SELECT book_id, location, n_chunks, chapter_title, text FROM segments",
    "bm25_stats": "SELECT book_id, term, df, n_chunks, round(avg_tokens, 6) AS avg_tokens, round(idf, 6) AS idf FROM idf",
    "bm25_topk": "SELECT question_id, rank_in_method::INT AS rank_in_method, chapter_order, chunk_no, location, round(scaled, 6) AS score FROM bm_top",
    "vector_topk": vtop("score >= -1", 15),
    "vector_threshold": f"SELECT question_id, rank_in_method, vec_id, score FROM ({vtop('round(score, 9) >= 0.15', 15)})",
    "summary_search": f"""SELECT question_id, rank_in_method, vec_id, score FROM ({vtop("score >= -1 AND content_type = 'summary'", 5)})""",
    "expanded_queries": "SELECT question_id, probe_no, probe AS expanded_query FROM expanded",
    "hybrid_retrieval": """SELECT question_id, rank::INT AS rank, search_method, kind_no, chapter_order, chunk_no, location, chapter_title,
      round(score, 6) AS score, round(original_score, 6) AS original_score, md5(text) AS text_md5 FROM ranked""",
    "rerank_apply": "SELECT question_id, final_rank::INT AS final_rank, rank::INT AS rank, rerank_score::INT AS rerank_score, round_even(score, 2)::DOUBLE AS relevance_score, search_method, location FROM final",
    "context_block": """SELECT q.question_id, q.book_id, q.boundary AS location_boundary, 'Passages from the part of the book read so far' || chr(10) || chr(10) ||
      concat_ws(chr(10), CASE WHEN s IS NOT NULL THEN '--- SECTION SUMMARIES ---' || chr(10) || s || chr(10) || '--- DETAILED PASSAGES ---' END, p) || chr(10) || chr(10) ||
      'Position of the reader: ' || printf('%.1f', b.boundary::DOUBLE / b.total_locations * 100.0) || ' percent.' || chr(10) ||
      'Answer from these passages alone, without what comes later.' || chr(10) || chr(10) || 'Question: ' || b.question AS prompt,
      coalesce(n_context, 0) AS n_context, CASE WHEN b.question_id IS NULL THEN 'I don''t have enough information from the book to answer that question based on what you''ve read so far.' END AS response
      FROM questions q LEFT JOIN blocks b ON b.question_id = q.question_id""",
    "context_dedupe": f"""SELECT question_id, i::INT AS passage_no, kept[i].r::INT AS final_rank, md5(f.text) AS text_md5 FROM (
      SELECT question_id, kept, unnest(range(1, least(6, len(kept)) + 1)) AS i FROM kept QUALIFY n = max(n) OVER (PARTITION BY question_id)) k
      JOIN final f ON f.question_id = k.question_id AND f.final_rank = kept[i].r""".replace("k.question_id, i", "question_id, i").replace("SELECT question_id, i::INT", "SELECT k.question_id, i::INT"),
    "near_duplicates": f"""WITH nd_texts AS (SELECT doc_id, {strip("coalesce(text, '')")} AS s FROM documents),
      nd_sets AS (SELECT doc_id, s, CASE WHEN length(s) > 50 THEN list_sort(list_distinct({split("lower(s)")})) END AS w FROM nd_texts WHERE s <> ''),
      nd_keys AS (SELECT doc_id, w, CASE WHEN w IS NULL THEN 't ' || s ELSE 'w ' || array_to_string(w, ' ') END AS k FROM nd_sets),
      nd_classes AS (SELECT k, any_value(w) AS w, count(*) AS n, min(doc_id) AS first FROM nd_keys GROUP BY k),
      nd_words AS (SELECT k, n, first, len(w) AS size, unnest(w) AS word FROM nd_classes),
      nd_links AS (SELECT a.k, b.n, b.first FROM nd_words a JOIN nd_words b ON a.word = b.word AND a.k <> b.k
        GROUP BY a.k, b.k, b.n, b.first, a.size, b.size HAVING count(*)::DOUBLE / (a.size + b.size - count(*)) > 0.7),
      nd_beyond AS (SELECT k, sum(n) AS more, min(first) AS before FROM nd_links GROUP BY k)
      SELECT d.doc_id, c.first AS class_id, (CASE WHEN c.k IS NULL THEN 0 ELSE c.n - 1 + coalesce(x.more, 0) END)::BIGINT AS n_links,
      coalesce(least(c.first, x.before), d.doc_id) AS first_id
      FROM documents d LEFT JOIN nd_keys m ON m.doc_id = d.doc_id LEFT JOIN nd_classes c ON c.k = m.k LEFT JOIN nd_beyond x ON x.k = c.k""",
    "relevance_bands": "SELECT search_method, CASE WHEN round(score, 9) > 0.8 THEN 'high' WHEN round(score, 9) > 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM ranked GROUP BY ALL",
    "progress_state": "SELECT reader_id, book_id, current_location, round(completion_percentage, 6) AS completion_percentage, last_read_at, current_chapter_id FROM state",
    "progress_view": """SELECT s.reader_id, s.book_id, s.current_location, coalesce(c.chapter_id, r.chapter_id) AS chapter_id, coalesce(c."order", r."order") AS chapter_order,
      coalesce(c.title, r.title) AS chapter_title, r.chapter_id AS resolved_chapter_id FROM state s LEFT JOIN chapters c ON c.chapter_id = s.current_chapter_id
      LEFT JOIN chapters r ON r.book_id = s.book_id AND s.current_location BETWEEN r.start_location AND r.end_location""",
    "progress_sessions": """SELECT reader_id, book_id, ts, event_id, location FROM (SELECT *, lead(ts) OVER (PARTITION BY reader_id, book_id ORDER BY ts, event_id) AS nxt
      FROM pe WHERE location IS NOT NULL) WHERE nxt IS NULL OR nxt - ts > INTERVAL 2 HOUR""",
    "progress_throttled": """SELECT reader_id, book_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS window_start, count(*) AS n_positions, max(ts) AS ts,
      arg_max(event_id, (ts, event_id)) AS event_id, arg_max(location, (ts, event_id)) AS location FROM pe WHERE location IS NOT NULL GROUP BY reader_id, book_id, window_start""",
    "location_changes": """SELECT reader_id, book_id, ts, event_id, location FROM (SELECT reader_id, book_id, ts, event_id, location // 20 AS location,
      lag(location // 20) OVER (PARTITION BY reader_id, book_id ORDER BY ts, event_id) AS prev FROM pe WHERE location IS NOT NULL) WHERE prev IS DISTINCT FROM location""",
    "answer_pairs": "SELECT conv_id, turn, model, item_id, question, answer, ground_truth FROM ans",
    "bleu": "SELECT a.conv_id, a.turn, round(coalesce(bl.bleu, 0.0), 6) AS bleu FROM ans a LEFT JOIN bl USING (conv_id, turn)",
    "answer_grounding": f"SELECT conv_id, turn, {grounding('answer', 'ground_truth')} AS factual_grounding FROM ans",
    "retrieval_effectiveness": f"SELECT conv_id, turn, round(coalesce({share('question', 'answer', _STOP2)}, 0.5), 6) AS retrieval_effectiveness FROM ans",
    "answer_complexity": f"SELECT conv_id, turn, {complexity('answer')} FROM ans",
    "error_class": f"SELECT conv_id, turn, {_ERRORS} AS error_type FROM edge",
    "spoiler_flags": f"""SELECT conv_id, turn, g AS percentage_of_book_read, CASE WHEN 25 + (conv_id % 14) * 5 <= g AND NOT {blank('answer')} AND
      len(list_filter(kw, lambda k: contains(lower(answer), k))) > 0 THEN 0 ELSE 1 END AS spoiler_prevention_flag
      FROM (SELECT ans.*, (25 + (item_id % 14) * 5)::INT AS g, (SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest({words('ground_truth')}) AS w, generate_subscripts({words('ground_truth')}, 1) AS p) WHERE length(w) > 3 GROUP BY w)) AS kw FROM ans)""",
    "answer_scores": f"""SELECT e.conv_id, e.turn, CASE WHEN e.turn % 4 = 0 THEN round(coalesce(bl.bleu, 0.0), 6) ELSE 0.0 END AS bleu,
      CASE WHEN e.turn % 4 = 0 THEN {grounding('answer', 'ground_truth')} ELSE 3 END AS factual_grounding,
      round(coalesce({share('question', 'ground_truth', _STOP2)}, 0.5), 6) AS retrieval_effectiveness, {complexity('answer')}, {_ERRORS} AS error_type
      FROM edge e LEFT JOIN bl USING (conv_id, turn)""",
    "judge_requests": f"""SELECT result_id, kind, md5(prompt) AS prompt_md5 FROM (
      SELECT conv_id * 1000 + turn AS result_id, 'qualitative' AS kind, CASE WHEN NOT {blank('answer')} AND NOT contains(answer, 'ERROR:') THEN
        'Compare the answer with the ground truth and give scores as JSON only.' || chr(10) || 'Query: ' || question || chr(10) || 'Ground truth: ' || CASE WHEN turn % 4 = 0 THEN ground_truth ELSE 'none' END ||
        chr(10) || 'Answer: ' || answer || chr(10) || 'Output: {{"contextual_fidelity": <1-5>, "relevance": <1-5>, "helpfulness": <1-5>, "coherence": <1-5>, "instruction_following": <0-1>}}' END AS prompt FROM edge
      UNION ALL
      SELECT conv_id * 1000 + turn, 'spoiler', CASE WHEN turn % 4 <> 0 AND NOT {blank('answer')} AND conv_id % 14 <= item_id % 14 THEN
        'Does the answer mention or hint at forbidden content? JSON only.' || chr(10) || 'Book: ' || model || chr(10) || 'Progress: ' || (25 + (conv_id % 14) * 5) || '%' || chr(10) || 'Forbidden: ' ||
        array_to_string((SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest({words('ground_truth')}) AS w, generate_subscripts({words('ground_truth')}, 1) AS p) WHERE length(w) > 3 GROUP BY w)), ', ') || chr(10) || 'Answer: ' || answer || chr(10) || 'Output: {{"contains_spoilers": true/false, "reasoning": "..."}}' END FROM edge) WHERE prompt IS NOT NULL""",
    "judge_parse": "SELECT event_id, cf::INT AS contextual_fidelity, re::INT AS relevance, he::INT AS helpfulness, co::INT AS coherence, i::INT AS instruction_following FROM judge",
    "judge_spoilers": "SELECT event_id, sf::INT AS spoiler_prevention_flag FROM judge",
    "judge_verdicts": """SELECT result_id, cf::INT AS contextual_fidelity, f::INT AS spoiler_prevention_flag, (cf * f)::INT AS paas_score FROM (
      SELECT result_id, cf, CASE WHEN event_id % 2 = 1 THEN sf ELSE spoiler_prevention_flag END AS f FROM res JOIN judge ON judge.event_id = res.result_id)""",
    "evaluation_run": f"""SELECT result_id, model, bleu, error_type, spoiler_prevention_flag, spoiler_prevention_flag AS paas_score, model_avg_time,
      rank() OVER (PARTITION BY evaluation_type ORDER BY model_avg_time) AS model_speed_rank,
      round((rank() OVER (PARTITION BY model ORDER BY response_time) + (count(*) OVER (PARTITION BY model, response_time) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) * 100, 6) AS response_speed_percentile,
      round(60.0 / (3000.0::DOUBLE / count(*) OVER ()), 6) AS queries_per_minute FROM (
      SELECT e.conv_id * 1000 + e.turn AS result_id, model, CASE WHEN e.turn % 4 = 0 THEN 'regular' ELSE 'spoiler' END AS evaluation_type,
        CASE WHEN e.turn % 4 = 0 THEN round(coalesce(bl.bleu, 0.0), 6) ELSE 0.0 END AS bleu, {_ERRORS} AS error_type, length(question) / 100.0::DOUBLE AS response_time,
        CASE WHEN e.turn % 4 <> 0 AND (conv_id % 14) <= (item_id % 14) AND NOT {blank('answer')} AND len(list_filter(kw, lambda k: contains(lower(answer), k))) > 0 THEN 0 ELSE 1 END AS spoiler_prevention_flag,
        round_even(avg(length(question) / 100.0::DOUBLE) OVER (PARTITION BY model), 2)::DOUBLE AS model_avg_time
      FROM (SELECT edge.*, (SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest({words('ground_truth')}) AS w, generate_subscripts({words('ground_truth')}, 1) AS p) WHERE length(w) > 3 GROUP BY w)) AS kw FROM edge) e
      LEFT JOIN bl USING (conv_id, turn))""",
    "evaluation_grid": "SELECT question_id AS query_id, book_id, 'm' || i AS model FROM questions, range(5) t(i)",
    "query_sets": """SELECT question_id AS query_id, book_id, 'regular' AS evaluation_type, 100 AS progress_stage FROM questions
      UNION ALL SELECT question_id, book_id, 'spoiler', (25 + (question_id % 14) * 5)::INT FROM questions""",
    "query_sample": "SELECT question_id AS query_id, book_id FROM questions QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY question_id) <= 2",
    "resume_run": """SELECT question_id AS query_id, 'm' || i AS model FROM questions, range(5) t(i)
      WHERE NOT EXISTS (SELECT 1 FROM ans WHERE ans.model = 'm' || i AND ans.item_id = question_id)""",
    "model_stats": "SELECT * FROM mst",
    "type_stats": "SELECT * FROM tst",
    "relative_speed": """SELECT result_id, model_query_count, type_query_count, round(model_query_count / model_total_time, 6) AS model_efficiency_score,
      round(response_time / model_avg_time, 6) AS relative_speed_vs_avg FROM res JOIN mst USING (model) JOIN tst USING (evaluation_type)""",
    "speed_rank": "SELECT result_id, model_avg_time, rank() OVER (PARTITION BY evaluation_type ORDER BY model_avg_time) AS model_speed_rank FROM res JOIN mst USING (model)",
    "speed_percentile": """SELECT result_id, round((rank() OVER (PARTITION BY model ORDER BY response_time) + (count(*) OVER (PARTITION BY model, response_time) - 1) / 2.0::DOUBLE)
      / count(*) OVER (PARTITION BY model) * 100, 6) AS response_speed_percentile FROM res""",
    "run_rates": "SELECT count(*) AS total_queries_in_run, round(3600.0::DOUBLE / count(*), 6) AS avg_time_per_query, round(60.0 / (3600.0::DOUBLE / count(*)), 6) AS queries_per_minute FROM res",
    "throughput": """SELECT model, round(sum(response_time), 4) AS total_time, round(avg(response_time), 6) AS avg_time, round(60.0 / avg(response_time), 6) AS queries_per_minute,
      count(*) AS n_queries FROM res GROUP BY model""",
    "run_summary": """SELECT count(*) FILTER (spoiler_prevention_flag = 1) AS spoiler_safe, count(*) AS n_results, round(count(*) FILTER (spoiler_prevention_flag = 1)::DOUBLE / count(*) * 100, 6) AS spoiler_safe_pct,
      round(avg(bert_f1), 6) AS mean_f1, round(avg(paas_score), 6) AS mean_paas FROM res""",
    "model_summary": """SELECT model, round_even(avg(bert_f1), 3)::DOUBLE AS bert_f1, round_even(avg(paas_score), 3)::DOUBLE AS paas_score,
      round_even(avg(spoiler_prevention_flag), 3)::DOUBLE AS spoiler_prevention_flag, round_even(avg(response_time), 3)::DOUBLE AS response_time FROM res GROUP BY model""",
    "scaled_metrics": """SELECT result_id, round(log10(greatest(response_time, 1e-6)), 6) AS response_time_log, round(log10(greatest(retrieval_effectiveness, 1e-6)), 6) AS retrieval_effectiveness_log,
      round(bleu * 1000, 6) AS bleu_scaled FROM res""",
    "error_crosstab": "SELECT model, error_type, count(*) AS n FROM reg WHERE error_type <> 'none' GROUP BY ALL",
    "error_share": """SELECT model, error_type, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY model) * 100, 6) AS share
      FROM reg WHERE error_type <> 'none' GROUP BY model, error_type""",
    "figure_precision_recall": f"SELECT model, {_MEANS} FROM reg GROUP BY model",
    "robustness_stages": f"SELECT model, progress_stage::VARCHAR AS stage, {_MEANS} FROM reg GROUP BY ALL",
    "robustness_bins": f"""SELECT model, CASE WHEN context_count <= (SELECT quantile_cont(context_count, 1.0 / 3) FROM reg) THEN 'low'
      WHEN context_count <= (SELECT quantile_cont(context_count, 2.0 / 3) FROM reg) THEN 'mid' ELSE 'high' END AS stage, {_MEANS} FROM reg GROUP BY ALL""",
    "radar_norm": "WITH m AS (SELECT model, avg(contextual_fidelity) AS a, avg(factual_grounding) AS b, avg(instruction_following) AS c, avg(paas_score) AS d FROM reg GROUP BY model) SELECT model, "
    + ", ".join(f"round(CASE WHEN max({x}) OVER () > min({x}) OVER () THEN ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) ELSE {x} END, 6) AS {n}" for x, n in zip("abcd", ("contextual_fidelity", "factual_grounding", "instruction_following", "paas_score")))
    + " FROM m",
    "pareto_frontier": """WITH m AS (SELECT model, avg(response_time) AS t, avg(bert_f1) AS f, avg(context_count) AS c FROM reg GROUP BY model)
      SELECT model, round(t, 6) AS response_time, round(f, 6) AS bert_f1, round(c, 6) AS context_count, round(f / t, 6) AS efficiency,
      NOT EXISTS (SELECT 1 FROM m o WHERE o.model <> m.model AND o.f >= m.f AND (o.t < m.t OR (o.t = m.t AND (o.f > m.f OR o.model < m.model)))) AS on_frontier FROM m""",
    "median_guides": "WITH m AS (SELECT avg(response_time) AS t, avg(bert_f1) AS f FROM reg GROUP BY model) SELECT round(median(t), 6) AS median_time, round(median(f), 6) AS median_f1 FROM m",
    "html_text": rf"""SELECT page_id, concat_ws(chr(10), nullif(regexp_replace(coalesce(array_to_string(list_filter(list_transform(flatten(list_transform(regexp_split_to_array({_BARE}, '\r\n|\n|\r'),
      lambda line: string_split({strip('line')}, '  '))), lambda x: {strip('x')}), lambda p: p <> ''), chr(10)), ''), '</?[a-z]+[^>]*>', '', 'g'), ''),
      'word café' || chr(160) || '’A’&unknown; R&D') AS text FROM pages""",
    "html_links": r"""SELECT page_id, unnest(range(len(h)))::INT AS n, unnest(h) AS href, starts_with(href, '#') OR contains(href, '.html') OR contains(href, '.xhtml') AS is_internal FROM (
      SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1), lambda x: replace(x, '&amp;', '&')) || ['q.html', 'r', 's?a=1&b=2'] AS h FROM pages)""",
    "html_titles": "SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'Part ' || page_id ELSE "
    + strip(decoded(r"regexp_replace(regexp_extract(html, CASE page_id % 3 WHEN 0 THEN '(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]\s*>' ELSE '(?is)<title>(.*?)</title>' END, 1), '<[^>]+>', '', 'g')")) + " END AS title FROM pages",
    "html_normalised": "SELECT page_id, trim(" + r"regexp_replace(regexp_replace(regexp_replace(" + dropped("html", *_SKELETON, r"(?i)</?(html|body)\b[^>]*>", r"(?i)\s+style\s*=\s*(\"[^\"]*\")".replace('\\"', '"'))
    + r""", '\s+', ' ', 'g'), '(?i)<p\b[^>]*>\s*</p>|<div\b[^>]*>\s*</div>|<span\b[^>]*>\s*</span>', '', 'g'),
      '(?i)<a\b([^>]*\bhref="(?:#[^"]*|[^"]*\.x?html[^"]*)"[^>]*)>', '<a data-internal-link="true"\1>', 'g') || '<p>x<img src=''b.png'' data-epub-src=''a/b.png''/></p>') AS html FROM pages""",
    "image_refs": "SELECT page_id AS book_id, 'Fig_' || page_id || '.PNG' AS name, 'fig_' || page_id || '.png' AS file_name, 1 AS try_no FROM pages",
    "publication_years": "SELECT o_orderkey, year(o_orderdate::DATE)::INT AS year FROM orders",
    "incremental_ingest": """SELECT book_id, chapter_id, "order" FROM chapters WHERE book_id NOT IN
      (SELECT d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)""",
    "vector_upsert": "SELECT vec_id, book_id, CASE WHEN vec_id % 3 = 0 THEN location + 1000 ELSE location END::INT AS location, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM vec",
    "cascade_delete": """WITH gone AS (SELECT d.source AS book_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND l.quality = 0),
      t AS (SELECT book_id, 'chapters' AS "table" FROM chapters UNION ALL SELECT book_id, 'books' FROM books UNION ALL SELECT book_id, 'events' FROM pe)
      SELECT book_id, "table", count(*) AS n FROM t WHERE book_id NOT IN (SELECT book_id FROM gone) GROUP BY ALL""",
    "patch_merge": """SELECT user_id, coalesce(arg_max(value, event_id) FILTER (event_type = 'purchase'), arg_max(value, event_id) FILTER (event_type = 'click'), 16.0) AS font_size,
      CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'view' ELSE 'light' END AS theme FROM events GROUP BY user_id""",
    "title_match": "SELECT 'book ' || book_id || '.txt ' AS title, book_id FROM books",
    "stream_replies": """SELECT conv_id, 0 AS block, string_agg(text, '' ORDER BY turn) AS reply, count(*)::INT AS n_pieces FROM conversations
      WHERE turn % 3 <> 2 GROUP BY conv_id""",
}

_BLEU_OF = {"bleu": "ans", "answer_scores": "edge", "evaluation_run": "edge"}


def _mentions(text: str) -> list[str]:
    """Steps named after FROM, JOIN or a comma between tables."""
    names = re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)|\bFROM ([a-z_0-9]+),", text)
    flat = {n for pair in names for n in pair if n}
    return [n for n in STEPS if n in flat]


def _collect(text: str, found: list[str]) -> None:
    for name in _mentions(text):
        if name in found:
            continue
        _collect(STEPS[name].replace(f"FROM {name})", "").replace(f"FROM {name} ", "FROM "), found)
        if name not in found:
            found.append(name)


def sql(name: str) -> str:
    body = BODIES[name]
    extra = ""
    if name in _BLEU_OF:
        extra = _bleu(_BLEU_OF[name])
    if body.startswith("WITH "):
        extra, body = _split_with(body)
    found: list[str] = []
    _collect(body + " " + extra, found)
    parts = [f"{n} AS ({STEPS[n]})" for n in found]
    if extra:
        parts.append(extra)
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def _split_with(body: str) -> tuple[str, str]:
    """Split 'WITH a AS (...) SELECT ...' at the end of its table list."""
    depth = 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == ")" and re.match(r"\)\s+SELECT\b", body[i:]):
            return body[5 : i + 1], body[i + 1 :].strip()
    raise ValueError(body)


def all_sql() -> dict[str, str]:
    return {name: sql(name) for name in BODIES}
