"""Archives, url filters, substring dedup, top-k search, SimHash, personal data and the pipeline."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import catalog, decontaminate, lines, passages, pii, quality, simhash, topk, urls, warc
from folioscope.llm.common import connected_components, read
from tests.llm.data import SMALL, awkward, documents, prose, rows_of


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    pick = random.Random(5)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(64)] + [(2000, 2001 + k) for k in range(50)] + [(7, 7)]
    edges = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    want = components_of({n for a, b in links if a != b for n in (a, b)}, [x for x in links if x[0] != x[1]])
    assert rows_of(connected_components(edges)) == sorted(want.items(), key=repr)
    assert connected_components(edges.where("false")).count() == 0


# --- archives -----------------------------------------------------------------------


def pages(spark):
    big, other = "é" * 700, "<p>" + prose(1, 400)
    rows = [
        (1, "http://a.b.org/x", big), (5, "http://A.b.org/x", big), (3, None, big), (4, "", None), (6, "no scheme\there", "short"), (7, "http://z.com/?q\nr", "short"),
        (8, "http://a.b.org/x", other), (9, "http://a.b.org/x", other), (9, "http://a.b.org/x", other), (None, "http://c.de", "x"),
    ] + [(100 + k, "http://many.net/", f"page {k}") for k in range(60)]
    return spark.createDataFrame([(*r, "key", 1) for r in rows], "page_id long, url string, html string, `key` string, at int")


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = pages(spark)
    folder = warc.archive_folder(spark)
    captures = warc.write_archives(rows, folder)
    directory = warc.build_index(captures, folder, part_size=20)
    assert directory.count() >= 10 and directory.select("part").distinct().count() > 1
    found = warc.read_records(warc.lookup(captures.select("key"), directory))
    want = []
    data = rows.collect()
    for r in data:
        body = (r["html"] or "").encode()
        holder = max((x["page_id"] for x in data if (x["html"] or "").encode() == body and x["page_id"] is not None), default=None)
        revisit = len(body) >= 1000 and r["page_id"] != holder
        want.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", holder if revisit else None, None if revisit else bytearray(body)))
    assert rows_of(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload") == sorted(want, key=repr)
    asked = spark.createDataFrame([(warc.url_key("http://many.net/"),), ("absent",), (warc.url_key("http://c.de"),)], "key string")
    assert warc.lookup(asked, directory).count() == 61
    none = warc.write_archives(rows.where("false"), warc.archive_folder(spark))
    assert warc.read_records(warc.lookup(none.select("key"), warc.build_index(none, warc.archive_folder(spark)))).count() == 0


def test_records_are_standard():
    raw = warc.record_bytes(3, "http://x.org/", b"body", 4, "d", None)
    fields, payload = warc.parse_record(raw)
    assert raw.startswith(b"WARC/1.1\r\n") and payload == b"body" and fields["Content-Length"] == "4" and warc.url_key("http://www.X.org/a?b") == "org,x,www)/a?b"
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-1])


# --- url filters ---------------------------------------------------------------------


def plain_rule(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for v, r in urls.RULES if (host == r[: r.find("/")] or host.endswith("." + r[: r.find("/")])) and path.startswith(r[r.find("/") :])]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_rules_equal_brute_force(spark):
    odd = [None, "", "x", "://", "http://", "HTTP://ORG/", "http://Example.ORG/es/x", "http://a.example.org/en/12", "http://a.example.org/en/2", "http://xorg/", "http://org", "http://org?/", "ftp://b.com/de/#x",
           "http://b.com:80/de/", "http://c.com/fr/?a=b&c=d", "http://É.Org/é", "a://b://c/d", "http://n.net/" + "p/" * 5000, "http://n.net/\nx"]
    rows = read(spark, SMALL, "pages").select("page_id", "url").union(spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(odd)] + [(None, "http://q.net/")], "page_id long, url string"))
    rows = rows.withColumns({"host": F.lit(3), "score": F.lit("x"), "rule": F.lit(1)})
    found = urls.judge(rows, urls.fit(urls.rule_labels(rows)))
    data = {r["page_id"]: r["url"] for r in rows.collect()}
    for r in found.collect():
        host, path, rule, verdict = plain_rule(data[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0.5 else "allow"))
    assert found.count() == len(data)


def test_trees_learn_and_equal_a_plain_walk(spark):
    pick = random.Random(2)
    rows = []
    for _ in range(1500):
        bad = pick.random() < 0.4
        host = f"{'win-' * pick.randint(1, 3) if bad else ''}{prose(pick.randrange(10**6), 1)}.{pick.choice(['com', 'net'])}"
        rows.append((f"http://{host}/{'9' * pick.randint(4, 9) if bad else prose(pick.randrange(10**6), 1)}", int(bad)))
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    learned, held = labelled.where("crc32(url) % 4 > 0"), labelled.where("crc32(url) % 4 = 0")
    model = urls.fit(learned, trees=4)
    out = model.binned(model.with_rates(urls.lexical(held))).withColumn("margin", model.margin()).collect()
    assert np.mean([(r["margin"] > 0) == (r["blocked"] == 1) for r in out]) > 0.9

    def walk(tree, row):
        return tree if isinstance(tree, float) else walk(tree[2] if row[f"bin_{tree[0]}"] <= tree[1] else tree[3], row)

    for r in out[:50]:
        assert all(r[f"bin_{f}"] == sum(r[f] > c for c in model.cuts[f]) for f in urls.FEATURES)
        assert abs(r["margin"] - model.start - sum(walk(t, r) for t in model.trees)) < 1e-9
        u = r["url"]
        share = [u.count(c) / len(u) for c in set(u)]
        assert abs(r["entropy"] + sum(p * math.log2(p) for p in share)) < 1e-9
        assert r["digit_ratio"] == sum(c.isdigit() for c in u) / len(u) and r["hyphens"] == u.count("-")


def test_best_split_is_the_best():
    pick = random.Random(9)
    sums = {(f, b): (pick.uniform(-5, 5), pick.uniform(0.1, 3)) for f in urls.FEATURES[:3] for b in range(6)}
    for f in urls.FEATURES[1:3]:  # the same rows seen through each feature: equal totals
        shift = sum(sums[urls.FEATURES[0], b][0] for b in range(6)) - sum(sums[f, b][0] for b in range(6))
        sums[f, 0] = (sums[f, 0][0] + shift, sums[f, 0][1])
    score = lambda part: sum(g for g, _ in part) ** 2 / (sum(h for _, h in part) + urls.RIDGE)
    gains = {}
    for f in urls.FEATURES[:3]:
        bins = [sums[f, b] for b in range(6)]
        for b in range(5):
            gains[f, b] = score(bins[: b + 1]) + score(bins[b + 1 :]) - score(bins)
    assert urls.best_split(sums)[:2] == max(gains, key=gains.get)


def test_urls_with_one_class_or_none(spark):
    rows = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    blocked = spark.createDataFrame([("http://b.net/", 1)], "url string, blocked int")
    assert urls.judge(rows, urls.fit(blocked)).first()["verdict"] == "block"
    assert urls.judge(rows, urls.fit(blocked.where("false"))).first()["verdict"] == "allow"
    assert urls.judge(rows.where("false"), urls.fit(blocked)).count() == 0


# --- substring dedup -------------------------------------------------------------------


def test_passages_across_documents(spark):
    passage = prose(70, 60).split()
    texts = [f"{prose(100 + k, 40 + 9 * k)} {' '.join(passage)} {prose(200 + k, 30)}" for k in range(6)]
    rows = [(10 + k, t) for k, t in enumerate(texts)] + [(40, prose(400, 200)), (41, prose(401, 9)), (42, (prose(402, 60) + " ") * 2)]
    for k in range(10):  # near copies of 100 words, one changed
        near = prose(500 + k, 100).split()
        rows += [(1000 + 2 * k, prose(600 + k, 50) + " " + " ".join(near)), (1001 + 2 * k, " ".join(near[:50] + ["changed"] + near[51:]) + " " + prose(700 + k, 70))]
    docs = documents(spark, rows)
    for tile in (500, 2):
        found = {r["doc_id"]: r["c"] for r in passages.repeated(docs, tile).groupBy("doc_id").agg(F.min("kept_doc").alias("c")).collect()}
        assert {i for i in found if i < 1000} == set(range(10, 16)) and all(found[k] == 10 for k in range(10, 16))
        assert sum(found.get(1001 + 2 * k) == 1000 + 2 * k for k in range(10)) == 10
    out = {r["doc_id"]: r["text"] for r in passages.dedup_substrings(docs).collect()}
    assert out[10] == texts[0] and out[40] == rows[6][1] and len(out[13].split()) < len(texts[3].split()) - 15


def test_passages_equal_brute_force_components(spark):
    """Every pair of paragraphs with a shared key is compared here; classes must agree."""
    docs = read(spark, SMALL, "documents").select("doc_id", "text")
    data = docs.collect()
    places, sets, keys = {}, {}, {}
    for r in data:
        hashes = passages.word_hashes(passages.spaced(r["text"].lower()))[2]
        for key, content, first, last in zip(*(x.tolist() for x in passages.paragraphs(r["text"]))):
            places.setdefault(content, set()).add((r["doc_id"], first, last))
            sets[content] = set(passages.shingle_hashes(hashes[first:last], 5).tolist())
            keys.setdefault(key, {}).setdefault(content, set()).add(r["doc_id"])
    links = []
    for own in keys.values():
        names = list(own)
        if len({d for x in own.values() for d in x}) > 1:
            links += [(a, b) for i, a in enumerate(names) for b in names[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = components_of(places, links)
    classes = {}
    for content, own in places.items():
        classes.setdefault(root[content], set()).update(own)
    want = {(d, f, l, min(c)[0]) for c in classes.values() if len({x[0] for x in c}) > 1 for d, f, l in c}
    shared = {c for own in keys.values() if len({d for x in own.values() for d in x}) > 1 for c in own}
    want = {w for w in want if any(w[:3] in places[c] for c in shared)}
    assert set(map(tuple, passages.repeated(docs).select("doc_id", "first", "last", "kept_doc").collect())) == want and want


def test_passages_awkward_rows(spark):
    docs = awkward(spark)
    found = passages.repeats(docs)
    assert {r["doc_id"] for r in found.collect()} >= {1, 2, 8, 9} and found.where("doc_id is null or doc_id in (3, 4, 5, 6, 10, 12)").count() == 0
    assert passages.dedup_substrings(docs).columns == docs.columns and passages.dedup_substrings(docs).count() == docs.count()
    assert passages.repeats(docs.where("false")).count() == 0


def test_texts_of_one_id_keep_their_own_words(spark):
    """Spans belong to a text: of two texts with one doc_id only the one that holds the repeat loses words."""
    passage, other = prose(70, 90), prose(71, 300)
    rows = [(1, passage + " " + prose(72, 30)), (2, other), (2, prose(73, 40) + " " + passage)]
    docs = documents(spark, rows).withColumn("__id", F.lit(1)).withColumn("__spans", F.lit("x")).withColumn("spans", F.lit("y")).withColumn("row", F.lit(0))
    out = passages.dedup_substrings(docs)
    texts = [r["text"] for r in out.where("doc_id = 2").collect()]
    assert out.columns == docs.columns and other in texts and min(len(t.split()) for t in texts) < 100
    assert passages.repeats(docs.withColumn("doc_id", F.lit("no number"))).count() == 0


# --- top-k -----------------------------------------------------------------------------


def test_top_k_awkward_rows(spark):
    pick = random.Random(4)
    rows = [(i, [pick.choice([-1.0, 0.5, 0.25, 0.0]) for _ in range(4)]) for i in range(150)]
    rows += [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [1.0, float("nan"), 0.0, 0.0]), (350, [1.0, float("inf"), 0.0, 0.0]), (400, [1.0, 2.0]), (401, [0.5, 0.5]), (None, [1.0] * 4), (450, [2.0**20, 1.0, 1.0, 1.0]), (451, [2.0**18] * 4)]
    rows += [(50, [1.0, 1.0, 0.5, 0.5]), (50, [1.0, 1.0, 0.5, 0.5]), (7, rows[7][1])]  # rows of one id are candidates of each other
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, v int, rank int")
    whole = topk.quantised(vectors)
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, own) in enumerate(usable):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for m, (i, v) in enumerate(usable) if m != n and len(v) == len(own))
            want += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scores[:5])]
    for tile in (8192, 2):
        assert rows_of(topk.top_k(whole.where("vec_id % 50 = 0"), whole, 5, tile)) == sorted(want, key=repr)
    assert topk.top_k(whole.where("false"), whole).count() == 0 and topk.top_k(whole, whole.where("false")).count() == 0


def test_scores_beyond_64_bits():
    rng = np.random.default_rng(3)
    left, right = (rng.integers(-300, 300, (9, 6)) for _ in range(2))
    left[2], right[4, 1], right[5] = 2**62, -(2**63), 2**40
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in right] for x in left]
    top = 2**63 - 1
    assert topk.products(left, right).tolist() == [[max(-top, min(top, x)) for x in line] for line in exact]


# --- SimHash -----------------------------------------------------------------------------


def plain_fingerprint(text, n=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    docs = awkward(spark)
    found = rows_of(simhash.fingerprints(docs, 4), "doc_id", "fp")
    assert found == sorted(((r["doc_id"], int(np.array(plain_fingerprint(r["text"]), np.uint64).view(np.int64))) for r in docs.collect()), key=repr)
    value = simhash.fingerprints(spark.createDataFrame([(1, "Some words to hash here")], "doc_id long, text string"), 4)
    hashed = value.sparkSession.sql("SELECT xxhash64('some words to hash') a, xxhash64('words to hash here') b").first()
    assert value.first()["fp"] == hashed["a"] & hashed["b"]  # both of two hashes must have the bit


def crowded(seed: int) -> list[int]:
    """Fingerprints in tight groups, chains and at random."""
    pick, out = random.Random(seed), set()
    for _ in range(6):
        centre = pick.getrandbits(64)
        for _ in range(60):
            out.add(centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 7))))
    step = pick.getrandbits(64)
    for _ in range(30):
        step ^= sum(1 << b for b in pick.sample(range(64), 4))
        out.add(step)
    return sorted(out | {pick.getrandbits(64) for _ in range(200)})


@pytest.mark.parametrize("shard", [2000, 20, 3])
def test_links_connect_what_brute_force_connects(spark, shard):
    values = crowded(shard)
    signed = [int(np.array(v, np.uint64).view(np.int64)) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, 5, shard).collect()
    pairs = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    back = dict(zip(signed, values))
    assert all((back[r["a"]] ^ back[r["b"]]).bit_count() <= 4 for r in links)
    assert components_of(values, [(back[r["a"]], back[r["b"]]) for r in links]) == components_of(values, pairs)
    assert len(links) < 8 * 5 * len(values)


def test_simhash_groups(spark):
    docs = awkward(spark)
    found = {(r["doc_id"], r["component_id"]) for r in simhash.components(docs, 4).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 3), (None, 3), (7, 7)} <= found
    kept = simhash.keep_one(docs.union(docs.where("doc_id = 7")), 4)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 7, 8, 9, 10, 11, 12]
    assert kept.where("doc_id is null").count() == 2 and simhash.components(docs.where("false"), 4).count() == 0


def test_simhash_query_equals_brute_force(spark):
    data = {r["doc_id"]: plain_fingerprint(r["text"]) for r in read(spark, SMALL, "documents").collect()}
    ids = sorted(data)
    root = components_of(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (data[a] ^ data[b]).bit_count() <= 4])
    assert rows_of(catalog.QUERIES["op7_simhash"](spark, SMALL)) == sorted(((i, f"{data[i]:016x}", root[i]) for i in ids), key=repr)


# --- personal data ---------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {"email": True, "ip": all(int(p) <= 255 for p in found.split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


def test_base_spans_equal_the_plain_patterns():
    pick = random.Random(8)
    pieces = ["a@b.c", "x.y+z@d-e.f.g", "@", "%x@d.e", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4041894974608795", "4041 8949-7460 8795", "+1 (988) 555-2485", "+", "+12", "é", " ", "0", "-", "abc", "\n", "+1 2", "001.2.3.4"]
    for _ in range(3000):
        text = "".join(pick.choice(pieces) for _ in range(pick.randint(1, 9)))
        assert pii.base_spans(text) == plain_base(text), text
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" * 50_000, "1." * 50_000, None, ""):
        assert pii.base_spans(text) is not None


def test_terms_that_give_an_entity_away(spark):
    rows = [(k, f"{prose(k, 30)} the Zorblatt person wrote to zor.blatt@mail.com today {prose(50 + k, 40)}") for k in range(4)] + [(10 + k, f"the {prose(500 + k, 60)} person wrote") for k in range(400)]
    rows += [(900, None), (901, ""), (None, "ip 10.0.0.1"), (902, rows[0][1]), (902, rows[0][1])]
    docs = documents(spark, rows)
    found = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    spans = {i: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for i, r in found.items()}
    for k in range(4):
        named = [rows[k][1][a:b] for kind, a, b in spans[k] if kind == "term"]
        assert "Zorblatt" in named and "the" not in named and "person" not in named and "wrote" not in named
        assert "[EMAIL]" in found[k]["clean"] and "Zorblatt" not in found[k]["clean"] and "zor.blatt" not in found[k]["clean"]
        assert spans[k][0][0] == "email" and found[k]["n_email"] == 1
    assert spans[900] == [] and spans[901] == [] and found[10]["clean"] is None and found[None]["n_ip"] == 1 and spans[902] == spans[0]
    assert pii.sanitise(docs).where("doc_id = 902").count() == 2 and pii.sanitise(docs.where("false")).count() == 0


def test_pii_query(spark):
    data = {r["doc_id"]: r["text"] for r in read(spark, SMALL, "documents").collect()}
    for r in catalog.QUERIES["op8_pii"](spark, SMALL).collect():
        base = plain_base(data[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["spans"].startswith(text)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]


def test_terms_equal_brute_force(spark):
    """Thresholds over all documents, counted here from the patterns' definition; most of the spans are terms."""
    folder = "/root/testdata/sf0.01"
    data = {r["doc_id"]: r["text"] for r in read(spark, folder, "documents").collect()}
    terms = {i: [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", t or "")] for i, t in data.items()}
    n, together, owners, windows = {}, {}, {}, {}
    for i, text in data.items():
        for term in {t for _, _, t in terms[i]}:
            n[term] = n.get(term, 0) + 1  # all terms count, also those inside entities
        base = plain_base(text)
        free = [t for t in terms[i] if not any(t[0] < b and a < t[1] for _, a, b in base)]
        for kind, a, b in base:
            entity = pii.entity_name(kind, text[a:b])
            near = [t for t in free if t[0] < a][-pii.WINDOW :] + [t for t in free if t[0] >= b][: pii.WINDOW]
            owners.setdefault(entity, set()).add(i)
            windows.setdefault(i, []).append((entity, [t for t in near if t[1] - t[0] >= 3]))
            for t in windows[i][-1][1]:
                together.setdefault((entity, t[2]), set()).add(i)
    told = set()
    for (entity, term), docs in together.items():
        share = len(owners[entity]) / len(data)
        posterior = (len(docs) + 0.5 * share) / (n[term] + 0.5)
        if posterior >= 0.5 and math.log2(posterior / share) >= 4:
            told.add((entity, term))
    want = {i: sorted({(a, b) for entity, near in own for a, b, t in near if (entity, t) in told}) for i, own in windows.items()}
    got = {}
    for r in pii.sanitise(read(spark, folder, "documents")).collect():
        found = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term"]
        if r["base"]:
            got[r["doc_id"]] = found
        else:
            assert not found and r["clean"] is None
    assert got == want and sum(map(len, want.values())) > 100


def test_many_at_signs_take_linear_time():
    def seconds(n):
        started = time.perf_counter()
        assert pii.base_spans("x @ y" * n) == []
        return time.perf_counter() - started

    assert seconds(400_000) < 10 * max(seconds(100_000), 0.01)


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against brute force or the tested operator."""
    docs = read(spark, SMALL, "documents").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage[names[0]](spark, docs, SMALL).cache()
    model = quality.fit(docs, read(spark, SMALL, "labels"))
    assert rows_of(good) == rows_of(quality.scores(docs, model).where("quality_score >= 0.7").select(*docs.columns)) and 0 < good.count() < docs.count()
    left = stage[names[1]](spark, good, SMALL).cache()
    out = {r["doc_id"]: r for r in left.collect()}
    assert left.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in out.values())
    want = {r["doc_id"]: r["text"] for r in lines.dedup_lines(good).where("not (removed_lines > 0 and text = '')").collect()}
    assert {i: r["text"] for i, r in out.items()} == want
    single = stage[names[2]](spark, left, SMALL).cache()
    prints = {i: plain_fingerprint(r["text"]) for i, r in out.items()}
    root = components_of(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert rows_of(single) == sorted((tuple(r) for i, r in out.items() if root[i] == i), key=repr)
    clean = stage[names[3]](spark, single, SMALL).cache()
    bad = {r["doc_id"] for r in decontaminate.leaks(single, read(spark, SMALL, "benchmark")).collect()}
    assert rows_of(clean) == sorted((tuple(r) for r in single.collect() if r["doc_id"] not in bad), key=repr)
    mixed = stage[names[4]](spark, clean, SMALL)
    assert set(docs.columns) < set(mixed.columns) and {r["doc_id"] for r in mixed.collect()} < {r["doc_id"] for r in clean.collect()}
    assert rows_of(corpus_pipeline.run(spark, SMALL)) == rows_of(mixed)


def test_pipeline_on_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), awkward(spark).where("false")):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL).cache()
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() <= docs.count()


def test_every_equal_window_of_twenty_words_is_found(spark):
    """Stretches of 20 to 60 equal words inside different texts, against a search of all windows at all positions."""
    rows = []
    for k in range(40):
        passage = prose(5000 + k, 20 + k)
        rows += [(2 * k, f"{prose(6000 + k, 35 + k)} {passage} {prose(7000 + k, 60)}"), (2 * k + 1, f"{prose(8000 + k, 90 - k)} {passage} {prose(9000 + k, 25)}")]
    rows.append((90, rows[3][1] + " " + rows[3][1]))
    docs = documents(spark, rows)
    places = {}
    for doc, text in rows:
        words = text.split()
        for at in range(len(words) - 19):
            places.setdefault(tuple(words[at : at + 20]), []).append((doc, at))
    shared = [sorted(p) for p in places.values() if len({d for d, _ in p}) > 1]
    want = {(d, at, at + 20, *p[0]) for p in shared for d, at in p}
    got = passages.repeated_windows(docs)
    assert set(map(tuple, got.select("doc_id", "first", "last", "kept_doc", "kept_first").collect())) == want
    whole = {(r["doc_id"], r["last"] - r["first"]) for r in passages.stretches(got).collect()}
    assert all((2 * k, 20 + k) in whole and (2 * k + 1, 20 + k) in whole for k in range(40) if k != 1)
    found = {r["doc_id"]: r for r in passages.repeats(docs).collect()}
    covered = {}
    for d, first, last, kept, _ in want:
        covered.setdefault(d, set()).update(range(first, last) if kept != d else ())
    assert set(found) >= set(range(80))
    for d in range(80):  # similar paragraphs may take more words along
        taken = {w for s in found[d]["spans"].split(",") if s for w in range(*map(int, s.split(":")))}
        assert taken >= covered[d] and found[d]["removed_words"] == len(taken)


def test_texts_are_hashed_together(monkeypatch):
    """Texts are hashed by stretches, not one by one, with the paragraphs and windows that each has alone."""
    texts = [None, "", "One", "a b  c\x1cd", " \t", "é " * 30, *(" ".join(f"w{k * i % 97}" for k in range(i)) for i in range(1, 120))]
    alone = [[x.tolist() for x in passages.paragraphs(t)] for t in texts]
    single = [next(passages.windows([t])).tolist() for t in texts]
    calls, plain = [], passages.word_hashes
    monkeypatch.setattr(passages, "word_hashes", lambda data: calls.append(1) or plain(data))
    assert [w.tolist() for w in passages.windows(texts)] == single
    at, found = 0, [[[], [], [], []] for _ in texts]
    for hashes, edges in passages.hashed(texts):
        for number, *row in zip(*(x.tolist() for x in passages.paragraphs_of(hashes, edges))):
            for column, value in zip(found[at + number], row):
                column.append(value)
        at += len(edges) - 1
    assert found == alone
    assert len(calls) <= 4


def test_shingles_of_places_are_taken_by_stretches(spark, monkeypatch):
    """The places of many texts get the sets that each has alone, from texts hashed together; another text of the id gives none."""
    texts = ["one two three", "w x y z v", *(prose(800 + k, 3 + 7 * k) for k in range(40)), "é a b c d e f"]
    places, want = [], {}
    for doc, text in enumerate(texts):
        hashes = passages.word_hashes(passages.spaced(text.lower()))[2]
        for _, content, first, last in zip(*(x.tolist() for x in passages.paragraphs(text))):
            places.append((content, doc, first, last))
            want[content] = np.sort(passages.shingle_hashes(hashes[first:last], 5)).tobytes()
    docs = documents(spark, [*enumerate(texts), (0, "one two four more"), (1, "w")]).coalesce(1)
    got = passages.content_shingles(docs, spark.createDataFrame(places, "content long, doc_id long, first int, last int"))
    assert {r["content"]: bytes(r["shingles"]) for r in got.collect()} == want
    calls, plain = [], passages.contents_of
    monkeypatch.setattr(passages, "contents_of", lambda *a: calls.append(1) or plain(*a))
    by_text = [[p for p in places if p[1] == doc] for doc in range(len(texts))]
    content, first, last = (np.array([p[i] for own in by_text for p in own]) for i in (0, 2, 3))
    sizes, seen, at, found = np.array([len(own) for own in by_text]), 0, 0, {}
    for hashes, edges in passages.hashed(texts):
        own = sizes[at : at + len(edges) - 1]
        part = slice(seen, seen + own.sum())
        for contents, sets in passages.shingles_at(hashes, edges, own, content[part], first[part], last[part]):
            found |= {c: row.tobytes() for c, row in zip(contents.tolist(), sets)}
        at, seen = at + len(own), part.stop
    assert found == want and len(calls) < 5


def test_anchors_are_looked_for_together():
    rng = np.random.default_rng(7)
    for top in (5, 1 << 40):
        counts = np.array([1, 2, 30, 31, 32, 61, 62, 500, 3, 31, 90])
        starts = np.cumsum(counts + 4) - counts
        order = rng.integers(0, top, starts[-1] + counts[-1] + 9).astype(np.uint64)
        for pick in (slice(None), slice(0, 1), slice(0, 3)):
            want = [passages.anchors(order[a : a + n]) + a for a, n in zip(starts[pick], counts[pick])]
            assert passages.anchors_of(order, starts[pick], counts[pick]).tolist() == np.concatenate(want).tolist()
