"""The near-duplicate join against all pairs, with words that many texts share."""

import random

import pytest

from folioscope.operators import similar_texts as st

SCHEMA = "doc_id long, text string, class string, words int, n long"


def brute(rows, limit, least):
    """Linked rows by comparing all of them."""
    texts = [(i, (t or "").strip()) for i, t in rows]
    out = []
    for at, (i, t) in enumerate(texts):
        links = []
        for other, (j, u) in enumerate(texts):
            if at == other or not t or not u:
                continue
            a, b = set(t.lower().split()), set(u.lower().split())
            if t == u or (len(t) > least and len(u) > least and len(a & b) / len(a | b) > limit):
                links.append(j)
        out.append((i, len(links), min([i, *links])))
    return sorted(out)


def near_copies(seed, n=120):
    rng = random.Random(seed)
    common, rare = [f"w{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            base = rng.choice(texts).split()
            base = [rng.choice(rare) if rng.random() < rng.choice((0.0, 0.1, 0.2)) else w for w in base]
        else:
            base = rng.choices(common, k=rng.randint(8, 30)) + rng.choices(rare, k=rng.randint(0, 12))
        rng.shuffle(base)
        texts.append(" ".join(base))
    return texts


EDGES = [None, "", " \t\n", "short", " short ", "Short", "x" * 60, "X" * 60, "w " * 40, "W " * 40, "ä ö " * 20]


@pytest.mark.parametrize("limit,tile,width,bits", [(0.7, 2000, 1 << 20, 1024), (0.7, 3, 1 << 20, 64), (0.5, 5, 4, 128), (0.9, 2000, 64, 64)])
def test_links_equal_all_pairs(spark, monkeypatch, limit, tile, width, bits):
    monkeypatch.setattr(st, "BITS", bits)
    monkeypatch.setattr(st, "SLICE", 7)
    monkeypatch.setattr(st, "TILE", tile)
    monkeypatch.setattr(st, "WIDTH", width)
    rows = list(enumerate([*EDGES, *near_copies(7), *EDGES]))
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    found = sorted((r.doc_id, r.n_links, r.first_id) for r in st.near_duplicates(docs, limit=limit).collect())
    assert found == brute(rows, limit, 50)


def test_class_is_the_smallest_text_of_equal_words(spark):
    long = "some words that stand in a text of more than fifty characters"
    rows = [(5, long), (3, " ".join(reversed(long.split()))), (9, "tiny"), (7, "tiny"), (1, None)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    found = {r.doc_id: (r.class_id, r.n_links, r.first_id) for r in st.near_duplicates(docs).collect()}
    assert found == {5: (3, 1, 3), 3: (3, 1, 3), 9: (7, 1, 7), 7: (7, 1, 7), 1: (None, 0, 1)}


def test_repeated_ids_and_null_ids_are_rows(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long), (1, long), (None, long + " thirteen"), (2, "other")]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    found = sorted(((r.doc_id, r.n_links, r.first_id) for r in st.near_duplicates(docs).collect()), key=repr)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)], key=repr)


def test_empty_table(spark):
    assert st.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_text_over_and_over(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat(concat('word', id % 2, ' other '), 20) AS text")
    rows = st.near_duplicates(docs).groupBy("class_id", "n_links", "first_id").count().collect()
    assert sorted(tuple(r) for r in rows) == [(0, 2499, 0, 2500), (1, 2499, 1, 2500)]


def test_pairs_are_ruled_out_where_they_meet(spark, monkeypatch):
    """Texts that share one word each with many others, and nothing else, are no candidates; near copies are."""
    monkeypatch.setattr(st, "TILE", 50)
    rng = random.Random(3)
    texts = [" ".join([f"hub{k % 2}", *(f"u{rng.randrange(4000)}" for _ in range(60))]) for k in range(300)]
    texts += [t.rsplit(" ", 2)[0] + " other end" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = st.text_classes(docs, "doc_id", "text", 50).cache()
    counters = spark.sparkContext.broadcast(st.rarity_table(classes))
    found = st.candidate_pairs(st.prefix_postings(classes, counters, 0.7), 0.7).collect()
    names = {bytes(r["class"]): r.id for r in classes.collect()}
    assert {(min(p), max(p)) for p in ((names[bytes(r.a)], names[bytes(r.b)]) for r in found)} >= {(k, 300 + k) for k in range(20)}
    assert len(found) < 100


def test_sets_meet_by_blocks(spark, monkeypatch):
    """Near copies of one text: each set is sent once to a cell of blocks, however many pairs it is in."""
    monkeypatch.setattr(st, "BLOCK", 16)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, f"x{k}", f"y{k}"])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = st.text_classes(docs, "doc_id", "text", 50).cache()
    links = st.class_links(classes)
    assert [links.count(), links.agg({"common": "min"}).first()[0], links.agg({"union": "max"}).first()[0]] == [780, 60, 64]
    assert st._homes(links).select("block").distinct().count() == 3


def test_white_space_and_case_of_words(spark):
    words = [f"Wörd{k}" for k in range(20)]
    rows = [(1, "\u3000".join(words)), (2, "\x85\u2009".join(w.lower() for w in words)), (3, "\x1c".join(words)), (4, "\t\r\n".join(words) + "\xa0")]
    found = {r.doc_id: (r.class_id, r.n_links) for r in st.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (1, 2)}


def test_small_blocks_equal_all_pairs(spark, monkeypatch):
    """Sets dealt to many blocks, also several of one size, with few meetings looked at together."""
    for name, value in {"BLOCK": 9, "WORDS": 150, "JOINED": 2, "PARTNERS": 3, "MEETINGS": 20, "TILE": 16, "ROWS": 5}.items():
        monkeypatch.setattr(st, name, value)
    rows = list(enumerate([*EDGES, *near_copies(11, 90), *(" ".join(f"s{(k + n) % 23}" for n in range(20)) for k in range(23))]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_links, r.first_id) for r in st.near_duplicates(docs).collect())
    assert found == brute(rows, 0.7, 50)


def test_stored_rows_grow_with_texts_and_links(spark, monkeypatch):
    """Nothing is stored per word, or per pair that only shares words."""
    stored = []

    def kept(df, name, *args, **options):
        found = materialise(df, name, *args, **options)
        stored.append((name, found.count()))
        return found

    materialise = st.materialise
    monkeypatch.setattr(st, "materialise", kept)
    rng = random.Random(5)
    texts = [" ".join([f"hub{k % 2}", *(f"u{rng.randrange(900)}" for _ in range(60))]) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(r.n_links for r in st.near_duplicates(docs).collect()) == 0
    assert max(n for _, n in stored) <= len(texts), stored


def test_long_sets_are_told_apart_by_sketches(spark):
    """Unrelated sets of more words than a sketch once had bits are no candidates, though they share rare words."""
    rng = random.Random(9)
    texts = [" ".join({f"u{rng.randrange(9000)}" for _ in range(3000)}) for _ in range(24)]
    texts.append(texts[0].rsplit(" ", 40)[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = st.text_classes(docs, "doc_id", "text", 50).cache()
    counters = spark.sparkContext.broadcast(st.rarity_table(classes))
    found = st.candidate_pairs(st.prefix_postings(classes, counters, 0.7), 0.7).collect()
    names = {bytes(r["class"]): r.id for r in classes.collect()}
    assert [tuple(sorted((names[bytes(r.a)], names[bytes(r.b)]))) for r in found] == [(0, 24)]
