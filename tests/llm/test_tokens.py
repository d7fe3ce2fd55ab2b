"""Token counts and alignment against the libraries, text by text."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from folioscope.llm import alignment, counts, pretokens

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SOURCE = counts.tokenizer_source(A_PATH)
KNOWN = [pretokens.ByteLevel(SOURCE, False, ranked) for ranked in (False, True)]
LONG = " ".join(f"word{i} naïve  über, {i * 7919}!\n\tx" for i in range(30_000))
TEXTS = [
    None, "", " ", "a", "  two  spaces  ", "don't stop'S", "tail \n\n  ", "<|endoftext|>", "a<|endoftext|> b<|endo", "<s> </s> <unk> <0x41>",
    "▁ mark", "héllo Ωmega жук 漢字 ひらがな 한국어", "emoji 😀👩‍👩‍👧 \x1c\x1f\x85᠎​", "nul\x00byte", "1234567890" * 30, "é" * 500, "same text", "same text", LONG, "x" * 5000,
]


@pytest.fixture(scope="module")
def libraries():
    default, plain = Tokenizer.from_file(A_PATH), Tokenizer.from_file(A_PATH)
    plain.encode_special_tokens = True
    return default, plain, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, "x", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, `a b` int").repartition(3)


def test_merging_by_rank_is_checked():
    assert pretokens.merges_are_ranks(SOURCE)
    assert not pretokens.merges_are_ranks(SOURCE.replace('"ignore_merges":false', '"ignore_merges":true').replace('"ignore_merges": false', '"ignore_merges": true'))


def test_settled_characters_are_cut_alike(libraries):
    known = pretokens.ByteLevel(SOURCE, True, True)
    settled = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and re.match(f"[{pretokens.SETTLED}]", c)]
    assert len(settled) > 30_000
    for at in range(0, len(settled), 400):
        text = "".join(f"a{c}1{c} {c}! {c}\t{c}{c}\n" for c in settled[at : at + 400])
        assert known.encode(text).tolist() == libraries[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabcé1.<|>endoftx▁"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_are_the_librarys(text):
    for known in KNOWN:
        library = known.library
        assert [i for words in known.pieces(text) for w in words for i in known.ids(w)] == library.encode(text, add_special_tokens=False).ids


def test_stretches_change_nothing(libraries):
    parts = list(pretokens.stretches(LONG, 1000))
    assert "".join(parts) == LONG and max(map(len, parts)) < 1100 and len(LONG) > 2 * pretokens.STRETCH
    assert pretokens.ByteLevel(SOURCE, True, True).encode(" " + LONG).tolist() == libraries[1].encode(" " + LONG, add_special_tokens=False).ids
    with open(B_PATH, "rb") as file:
        assert pretokens.SpaceMarked(file.read()).encode(LONG).tolist() == libraries[2].encode(LONG)


def test_a_worker_keeps_a_bounded_number_of_pieces():
    known = pretokens.Pieces(len, {"given": 5}, kept=10)
    assert [known[f"p{i}"] for i in range(100)] == [len(f"p{i}") for i in range(100)]
    assert len(known) <= 11 and known["given"] == 5
    known["y" * 1000]
    assert "y" * 1000 not in dict(known)


@pytest.mark.parametrize("table", [0, 5, counts.TABLE])
def test_counts_with_any_table(docs, libraries, table):
    found = counts.token_counts(docs, A_PATH, table=table)
    assert found.columns == ["doc_id", "text", "a b", "n_bytes", "n_tokens", "over_limit"]
    expected = Counter()
    for i, text in enumerate(TEXTS):
        n = len(libraries[0].encode(text or "", add_special_tokens=False).ids)
        expected[i or None, len((text or "").encode()), n, n > 512] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == expected


def test_frequent_table_is_bounded(docs):
    assert len(counts.frequent(docs, SOURCE, 7)) == 7
    assert counts.unpacked(counts.packed([("the", 1), (" é", 2)])) == {"the": 1, " é": 2}


def aligned_by_hand(text, plain, pieces):
    """(ids of A, ids of B, groups, links) of one text."""
    if not text:
        return [], [], "", []
    shown = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown.values())}
    whole = (" " + text).encode()
    a = plain.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    a_bytes = [bytes(shown[c] for c in plain.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], "", []

    def edges(parts):
        at, found = 0, []
        for part in parts:
            at += len(part)
            found.append(at)
        return found

    a_ends, b_ends = edges(a_bytes), edges(b_bytes)
    place = {e: j for j, e in enumerate(b_ends)}
    links = [(i, place[e]) for i, e in enumerate(a_ends) if e in place]
    groups, p, q = [], 0, 0
    for i, j in links:
        groups.append(",".join(map(str, a[p : i + 1])) + "|" + ",".join(map(str, b[q : j + 1])))
        p, q = i + 1, j + 1
    return a, b, ";".join(groups), [(a[i], b[j]) for i, j in links]


def expected_rows(texts, libraries):
    told = [aligned(t, libraries) for t in texts]
    counted = Counter(p for *_, links in told for p in links)
    highest = defaultdict(int)
    for (_, b), n in counted.items():
        highest[b] = max(highest[b], n)
    return [
        (len(a), len(b), len(links), len(links), sum(counted[p] == highest[p[1]] for p in links), sum(counted[p] for p in links),
         hashlib.sha256(groups.encode()).hexdigest() if links else "")
        for a, b, groups, links in told
    ]


def aligned(text, libraries):
    return aligned_by_hand(text, *libraries[1:])


@pytest.mark.parametrize("hot", [0, 40, alignment.HOT])
def test_alignment_against_brute_force(docs, libraries, hot):
    found = alignment.scored(alignment.align(docs, A_PATH, B_PATH, digests=True), hot).collect()
    expected = Counter((i or None, *row) for i, row in enumerate(expected_rows(TEXTS, libraries)))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found) == expected


def test_alignment_gives_the_groups(docs, libraries):
    found = alignment.align(docs, A_PATH, B_PATH, keep=["text", "a b", "n_a"])
    assert found.columns == ["text", "a b", "n_a", "n_b", "n_groups", "groups", "link_a", "link_b"]
    for row in found.collect():
        a, b, groups, links = aligned(row.text, libraries)
        assert (row.n_a, row.n_b, row.groups, list(zip(row.link_a, row.link_b))) == (len(a), len(b), groups, links)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert counts.token_counts(none, A_PATH).collect() == []
    assert alignment.scored(alignment.align(none, A_PATH, B_PATH)).collect() == []


def test_many_different_pairs_leave_a_task_in_parts(docs, monkeypatch):
    monkeypatch.setattr(alignment, "PARTIAL", 50)
    aligned_docs = alignment.align(docs, A_PATH, B_PATH).persist()
    total = aligned_docs.selectExpr("sum(n_groups)").first()[0]
    counted = alignment.pair_counts(aligned_docs)
    assert counted.selectExpr("sum(n)").first()[0] == total and counted.count() == counted.select("a", "b").distinct().count()
