import random
import re
from html import unescape

import pytest
from pyspark.sql import Row, functions as F

from folioscope.functions import location as loc, parsing, scoring, text as tx
from folioscope.functions.hooks import register_chunk_udtf
from folioscope.operators.chunks import cut_chunks
from folioscope.operators.passages import keep_dissimilar


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_location_golden_values(spark):
    lit = F.lit
    got = one(
        spark, loc.percentage_of(lit(5), lit(10)), loc.location_of_percentage(lit(50.0), lit(10)), loc.boundary_of(lit(5), lit(10)),
        loc.boundary_of(lit(0), lit(10)), loc.boundary_of(lit(50), lit(10)), loc.boundary_of(lit(500), lit(None).cast("int")),
        loc.percentage_of(lit(3), lit(0)), loc.location_of_percentage(lit(25.0), lit(10)), loc.truncated_location_of_percentage(lit(27.0), lit(10)),
        loc.locations_of_length(lit(0)), loc.locations_of_length(lit(1001)), loc.clamp_location(lit(-3), lit(10)), loc.location_of_scroll(lit(11), lit(20), lit(1.0)),
    )
    assert tuple(got) == (50.0, 5, 5, 1, 10, 100, 0.0, 2, 2, 1, 2, 1, 20)


def slow_chunks(text, streaming=False):
    """Independent reading of the chunk rules, with regular expressions."""
    at, out = 0, []
    while at < len(text):
        rest = text[at:]
        if streaming and len(rest) < 600:
            out.append((at, rest.strip()))
            break
        paragraph = list(re.finditer(r"(?=\n\n)", rest[200:450]))
        sentence = list(re.finditer(r"(?=\. )", rest[200:430]))
        end = min(400, len(rest))
        if paragraph and paragraph[-1].start() > 0:
            end = 200 + paragraph[-1].start() + 2
        elif sentence and sentence[-1].start() > 0:
            end = 200 + sentence[-1].start() + 2
        out.append((at, rest[:end].strip()))
        at += end - 50 if streaming else max(end - 50, 200)
    return [(p, c) for p, c in out if c] or [(0, text.strip())]


def random_text(rng):
    parts = [rng.choice(["ab", "déf", "ghij klm", ". ", "\n\n", ".\n\n", "  ", "x" * rng.randint(1, 120)]) for _ in range(rng.randint(0, 400))]
    return "".join(parts)


@pytest.mark.parametrize("mode", ["document", "stream"])
def test_chunks_match_slow_reading(spark, mode):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(60)] + ["a" * n for n in (99, 100, 400, 449, 450, 451, 600, 601)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {}
    for r in cut_chunks(df, mode=mode).collect():
        got.setdefault(r["id"], []).append((r["chunk_no"], r["char_pos"], r["chunk"], r["n_chunks"]))
    for i, t in enumerate(texts):
        expected = slow_chunks(t, mode == "stream")
        rows = sorted(got.get(i, []))
        assert [(p, c) for _, p, c, _ in rows] == expected
        assert [n for n, *_ in rows] == list(range(1, len(expected) + 1))
        assert all(total == len(expected) for *_, total in rows)
        assert all(len(c) <= (600 if mode == "stream" else 450) for _, _, c, _ in rows)


def test_chunk_table_function_equals_columns(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, random_text(rng)) for i in range(20)], "id int, text string")
    df.createOrReplaceTempView("some_texts")
    register_chunk_udtf(spark)
    by_sql = spark.sql("SELECT id, c.char_pos, c.chunk FROM some_texts, LATERAL chunk_text(text, 400, 100, 100) c")
    by_columns = cut_chunks(df, min_chars=100).select("id", "char_pos", "chunk")
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, by_columns.collect()))


def test_html(spark):
    page = F.lit(
        '<?xml version="1.0"?><!DOCTYPE html><html><head><title>T &amp; U</title></head><body style="x"><script>a</p></script>'
        '<!-- c --><h2>One <b>Two</b></h2><p style="color:red">A&nbsp;B  C</p>\n\n<p> </p><a href="#n">n</a><a href="c2.xhtml">c</a>'
        '<a href="http://x/y">w</a><img alt="i" src="../Images/Pic One.jpg"/></body></html>'
    )
    text, hrefs, title, clean = one(spark, tx.html_to_text(page), tx.hrefs(page), tx.chapter_title(page, F.lit("f.xhtml"), F.lit(0)), tx.normalise_html(page))
    assert text == "One TwoA\xa0B\nC\nncw"
    assert hrefs == ["#n", "c2.xhtml", "http://x/y"]
    assert title == "One Two"
    assert 'data-epub-src="../Images/Pic One.jpg"' in clean and 'src="Pic One.jpg"' in clean
    assert clean.count("data-internal-link") == 2 and "style=" not in clean and "<p> </p>" not in clean and "<script" not in clean
    kinds = spark.createDataFrame([("#a",), ("b.html#c",), ("d.xhtml",), ("http://e/f",)], "h string").select(tx.is_internal_link(F.col("h"))).collect()
    assert [k[0] for k in kinds] == [True, True, True, False]


def test_references(spark):
    """Named, decimal and hexadecimal references mean what the standard library says; each is decoded once."""
    cases = ["", "a & b", "&amp;lt;", "&#8217;&eacute;&Eacute;", "&#x1F600;&#X41;", "&#146;&#x92;", "&zzzz;", "&#;&#x;&;", "&amp", "x&lt;y&gt;&amp;&amp;z", "&apos;&quot;\n&nbsp;"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", tx.decode_entities(F.col("t"))).collect())]
    assert got == [c if c == "&amp" else unescape(c) for c in cases]
    left = ["&#0;", "&#xD800;", "&#x110000;", "&#9999999;", "&#99999999;"]  # no character: they stay
    assert list(one(spark, *[tx.decode_entities(F.lit(x)) for x in left])) == left
    assert one(spark, tx.decode_entities(F.lit(None).cast("string")))[0] is None


def test_quotes(spark):
    page = F.lit("""<a href='x.html'>1</a><a\tHREF = y#z>2</a><a data-href="no">3</a><img src='a/b.png'><img alt='"' src="c.png"/>""")
    hrefs, images, clean = one(spark, tx.hrefs(page), tx.image_sources(page), tx.normalise_html(page))
    assert hrefs == ["x.html", "y#z"] and images == ["a/b.png", "c.png"]
    assert "<a data-internal-link=\"true\" href='x.html'>" in clean and "src='b.png' data-epub-src='a/b.png'" in clean


@pytest.mark.parametrize("html, left", [
    ("<ul><li></li></ul>", ""), ("<p>a</p><p> <br/> </p>b", "<p>a</p>b"), ("<p><img src='x'></p>", "<p><img src='x'></p>"),
    ("<div><p>x</p><div><i></i></div></div>", "<div><p>x</p></div>"), ("<p><b>x<br><p></p>", "<p><b>x<br>"), ("a</p>b", "a</p>b"),
    ("<td><a id=1></a>&nbsp;</td><hr>x", "x"), ("", ""), ("plain", "plain"), ("<p>", ""), ("<b><i>x</b></i>", "<b><i>x</b></i>"),
    ("<a/>x<a>y</a>", "x<a>y</a>"), ("<br>", "<br>"),
])
def test_empty_elements(html, left):
    assert tx.without_empty_elements(html) == left


def test_empty_elements_of_deep_pages_take_one_pass():
    deep = 200_000
    assert tx.without_empty_elements("<i>" * deep + "</i>" * deep) == ""
    full = "<i>" * deep + "x" + "</i>" * deep
    assert tx.without_empty_elements(full) == full


def test_titles_fall_through(spark):
    cases = [
        ("<title> Doc </title><p>x</p>", "a.xhtml", "Doc"),
        ('<div class="chapter-head">Three</div>', "a.xhtml", "Three"),
        ("<p>Chapter IV. It rained.</p>", "a.xhtml", "Chapter IV."),
        ("<p>Prologue: It rained. More.</p>", "a.xhtml", "Prologue: It rained."),
        ("<p>Words</p>", "Chapter_12.xhtml", "Chapter 12"),
        ("<p>See chapter 1. In Chapter 12: The Way. More.</p>", "chapter-12.xhtml", "Chapter 12: The Way"),
        ("<p>x</p><div id='main-Title'>Four</div>", "a.xhtml", "Four"),
        ("<p>Words</p>", "epilogue.xhtml", "Epilogue"),
        ("<p>Words</p>", "a.xhtml", "Section 4"),
    ]
    df = spark.createDataFrame([(i, h, f) for i, (h, f, _) in enumerate(cases)], "i int, h string, f string")
    got = [r[1] for r in sorted(df.select("i", tx.chapter_title(F.col("h"), F.col("f"), F.lit(3))).collect())]
    assert got == [t for *_, t in cases]


def test_windows_and_years(spark):
    text = F.lit("".join(chr(97 + i % 26) for i in range(2500)))
    got = one(
        spark, tx.window_at_location(text, F.lit(1), 5), tx.window_at_location(text, F.lit(3), 2), tx.window_at_location(text, F.lit(9), 3), tx.window_at_location(F.lit(""), F.lit(1)),
        tx.publication_year(F.lit("2001-05-03")), tx.publication_year(F.lit("1999/7")), tx.publication_year(F.lit("1984")), tx.publication_year(F.lit("soon")),
    )
    s = "".join(chr(97 + i % 26) for i in range(2500))
    assert tuple(got) == (s[0:5], s[1998:2002], s[2496:2500], "", 2001, 1999, 1984, None)


def test_reply_parsing(spark):
    reply = F.lit("Sure:\n 1. Who is Ahab?\n2.  tiny\n2. The white whale\n3. No")
    rated = parsing.ratings(F.lit("[1]: 7\n[2]: 99 [2]: 3, [9]: 4 [0]: 1 [3]:0"), F.lit(4))
    got = one(spark, parsing.numbered_items(reply), *[parsing.rating_of(rated, F.lit(i)) for i in (1, 2, 3, 4)])
    assert tuple(got) == (["Who is Ahab?", "The white whale"], 7, 3, 1, 1)


def test_tolerant_json(spark):
    good = '{"contextual_fidelity": 5, "relevance": 4, "helpfulness": 3, "coherence": 2, "instruction_following": 1}'
    replies = [good, f"text {good} more", f"```json\n{good}\n```", 'x {"relevance": 1} ' + good, "nothing", "{}", "", '{"relevance": 2}']
    df = spark.createDataFrame([Row(i=i, r=r) for i, r in enumerate(replies)])
    got = [tuple(r[1]) for r in sorted(df.select("i", parsing.judge_scores(F.col("r"))).collect())]
    full, default = (5, 4, 3, 2, 1), (1, 1, 1, 1, 0)
    assert got == [full, full, full, full, default, default, default, (None, 2, None, None, None)]
    flags = ['{"contains_spoilers": true}', 'so {"contains_spoilers": false} ok', "unclear", 'x {"other": 1}']
    df = spark.createDataFrame([Row(i=i, r=r) for i, r in enumerate(flags)])
    flag = parsing.judge_spoiler_flag(F.col("r"), F.lit("The Killer is named"), F.array(F.lit("killer")))
    assert [r[1] for r in sorted(df.select("i", flag).collect())] == [0, 1, 0, 0]


def test_scores(spark):
    s = F.lit
    got = one(
        spark, scoring.bleu4(s("the cat sat on the mat"), s("the cat sat on the mat")), scoring.bleu4(s("dog"), s("cat")), scoring.bleu4(s(" "), s("cat")),
        scoring.factual_grounding(s("whale sea"), s("the whale and the sea")), scoring.factual_grounding(s("x"), s("the of")), scoring.factual_grounding(s("ERROR: x"), s("y")),
        scoring.retrieval_effectiveness(s("where is the whale"), s("a whale here")), scoring.retrieval_effectiveness(s("the"), s("x")), scoring.retrieval_effectiveness(s("a"), s(None).cast("string")),
        scoring.sentence_count(s("One. Two! Three?? ")), scoring.classify_error(s("ok"), s("boom")), scoring.classify_error(s(" "), s(None).cast("string")),
        scoring.spoiler_flag(s("The KILLER"), F.array(s("killer"))), scoring.spoiler_flag(s(""), F.array(s("killer"))), scoring.cosine(F.array(s(1.0), s(0.0)), F.array(s(1.0), s(1.0))),
    )
    assert tuple(got)[:14] == (1.0, 0.0, 0.0, 5, 3, 5, 0.5, 0.5, 0.0, 3, "api_error", "empty_response", 0, 1)
    assert got[14] == pytest.approx(0.5**0.5)


def test_greedy_dedupe(spark):
    base = " ".join(f"word{i}" for i in range(20))
    near = base.replace("word19", "other")
    texts = [base, base, "  ", near, "short", "short one", "another " + base[::-1]]
    df = spark.createDataFrame([Row(p=[Row(n=i, text=t) for i, t in enumerate(texts)])], "p array<struct<n: int, text: string>>")
    assert [r["n"] for r in df.select(keep_dissimilar(F.col("p"), None)).first()[0]] == [0, 4, 5, 6]
    assert len(df.select(keep_dissimilar(F.col("p"), 2)).first()[0]) == 2


def test_text_counts_are_those_of_the_tokens(spark):
    """Split by bytes or by pattern: the same tokens, vectors and terms; rows with other characters in the same batch."""
    import pyarrow as pa

    from folioscope.functions import counting, hooks, text as tx
    from folioscope.operators import keyword

    chars = [chr(c) for c in [*range(1, 0x250), *range(0x2010, 0x2028)]]
    texts = [*(f"a{c}b {c}{c} É{c}" for c in chars), "", "  ", "x", "x x ß.,y", "漢字 a b", "ΑΣ Ω's áb", "\U0001f600 a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("k", tx.tokens(F.col("t")))
    rows = rows.withColumn("c", counting.text_counts(F.col("t"), 64)).withColumns({"v": hooks.hashed_embedding(F.col("k")), "p": keyword.term_counts(F.col("k"))})
    found = rows.select("*", F.lower("t").alias("l"), F.lower("t").rlike(counting.NOT_PLAIN).alias("other")).orderBy("i").collect()
    for r in found:
        assert (r["c"]["n_tokens"], r["c"]["vector"], sorted(r["c"]["terms"])) == (len(r["k"]), r["v"], sorted(r["p"])), r["t"]
    plain = [r for r in found if not r["other"]]
    sizes, words = counting.split_plain(pa.array([r["l"] for r in plain]))
    assert sizes.tolist() == [len(r["k"]) for r in plain] and words.to_pylist() == [w for r in plain for w in r["k"]]
    assert len(chars) - 30 < len(plain) < len(texts)


def test_chunks_do_not_carry_all_pieces_of_their_text(spark):
    from folioscope.operators import chunks

    rows = chunks.cut_chunks(spark.createDataFrame([(1, "One. " * 600)], "chapter_id long, text string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    project = next(line for line in plan.splitlines() if "Project" in line)
    assert "Generate" in plan and "_pieces" not in project  # their number is taken below the generator
    assert {r["n_chunks"] for r in rows.collect()} == {rows.count()}
