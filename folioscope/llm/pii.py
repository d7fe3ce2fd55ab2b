"""Information-theoretic sanitisation of personal data.

Base entities (emails, addresses, card and phone numbers) are found by fixed patterns. The corpus then tells which other
terms give an entity away: of the n documents with a term, it stands within ``WINDOW`` terms of an entity in k. Its
posterior of the entity is (k + PRIOR * p) / (n + PRIOR), where p is the share of documents with the entity, so that few
documents tell less than many; its disclosure is log2(posterior / p). Terms above both thresholds are sanitised where they
stand near the entity: removed from ``REMOVE`` on, else generalised to a placeholder. A term seen in one document alone,
beside an entity, is generalised; one seen in five or more and always beside it is removed.

Terms are runs of letters (ASCII letters and all characters beyond ASCII), lower-cased. Document counts of terms cover
all documents; each task counts its own documents first. Pairs of term and entity come from bounded windows, so a
document gives at most ``2 * WINDOW`` pairs per entity mention, and are aggregated before the shuffle.

Defined cases: a null or empty text has no spans; whole texts are searched, in time linear in their length; equal rows
get equal spans and count as documents each; null doc_ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.words import word_hashes
from folioscope.sources.storage import materialise

WINDOW = 20
SHORTEST = 3
POSTERIOR, BITS, REMOVE = 0.5, 4.0, 0.9
#: How many documents the corpus-wide share of the entity weighs in a term's posterior.
PRIOR = 0.5
#: Hashes a task holds before it counts them.
HELD = 1 << 22

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base entities. Possessive repeats and the look-behind match the same spans as plain
# repeats would, without trying shorter ones that cannot match.
_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_NO_TERM = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def _emails(text: str):
    """Leftmost matches of local part, @ and domain: all starts before one @ share its domain, so the first one decides.

    A local part holds no @, so each search back ends at the one before and the time is linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return found


def entity_name(kind: str, text: str) -> str:
    """Mentions of one entity share a name."""
    return f"{kind}:{text.lower() if kind == 'email' else re.sub('[^0-9.]', '', text) if kind == 'ip' else re.sub('[^0-9]', '', text)}"


def _hash(names: list[str]) -> np.ndarray:
    """One signed 64-bit number per name; names hold no space."""
    return word_hashes(np.frombuffer((" " + " ".join(names) + " ").encode(), np.uint8))[2].view(np.int64) if names else np.empty(0, np.int64)


def term_spans(text: str, base: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the terms of a text outside its base spans."""
    spans = [m.span() for m in _TERM.finditer(text)]
    hashes = _hash([text[a:b].lower() for a, b in spans])
    starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
    free = np.ones(len(starts), bool)
    for _, a, b in base:
        free[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = False
    return starts[free], ends[free], hashes[free]


def near_terms(text: str, base: list[tuple[str, int, int]], window: int = WINDOW):
    """(entity hash, term starts, ends, hashes) per mention: the terms of at least ``SHORTEST`` letters near it."""
    starts, ends, hashes = term_spans(text, base)
    names = _hash([entity_name(kind, text[a:b]) for kind, a, b in base])
    for entity, (_, a, b) in zip(names, base):
        low, high = np.searchsorted(starts, a), np.searchsorted(starts, b)
        near = np.arange(max(0, low - window), min(len(starts), high + window))
        near = near[ends[near] - starts[near] >= SHORTEST]
        yield int(entity), starts[near], ends[near], hashes[near]


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, end), and text where there is a span (else null)."""
    import pyarrow as pa

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [base_spans(t) for t in texts]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]
            kept = [t if x else None for t, x in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, span), pa.array(kept, pa.string())], names=["doc_id", "base", "text"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, base array<struct<kind: string, start: int, end: int>>, text string")


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n): how many documents hold each of the ``wanted`` terms (column term), counted over all documents."""
    import pyarrow as pa

    def run(batches):
        held, size = [], 0

        def counted():
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    data = np.frombuffer(b" " + text.lower().encode().translate(_NO_TERM) + b" ", np.uint8)
                    held.append(np.unique(word_hashes(data)[2]))
                    size += len(held[-1])
            if size > HELD:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "term long, n long").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_key, terms): per document with entities, the (entity, term, posterior) above the thresholds in it.

    ``known``: doc_id, text_key, base, text of the documents with base spans.
    """
    import pyarrow as pa

    def cut(batches):
        for batch in batches:
            found = []
            for doc_id, key, text, base in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "base"))):
                seen: dict[int, set] = {}
                for entity, _, _, hashes in near_terms(text, [(s["kind"], s["start"], s["end"]) for s in base]):
                    seen.setdefault(entity, set()).update(hashes.tolist())
                found += [(doc_id, key, entity, term) for entity, terms in seen.items() for term in terms or [None]]
            types = [batch.column("doc_id").type, pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text_key", "entity", "term"])

    kind = known.schema["doc_id"].dataType.simpleString()
    pairs = materialise(known.select("doc_id", "text_key", "text", "base").mapInArrow(cut, f"doc_id {kind}, text_key string, entity long, term long"), "pairs")
    # rows of pairs are one per document, entity and term; equal rows of documents count as documents each
    near = pairs.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("together"))
    near = materialise(near, "near")
    mentions = pairs.select("doc_id", "text_key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("documents"))
    total = docs.agg(F.count("*").cast("double")).scalar()
    counts = term_counts(docs, near.select("term").distinct())
    share = F.col("documents") / total
    posterior = (F.col("together") + PRIOR * share) / (F.col("n") + PRIOR)
    told = near.join(counts, "term").join(mentions, "entity").select("entity", "term", posterior.alias("posterior"), F.log2(posterior / share).alias("bits"))
    told = told.where((F.col("posterior") >= POSTERIOR) & (F.col("bits") >= BITS)).drop("bits")
    return pairs.join(told, ["entity", "term"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("entity", "term", "posterior")).alias("terms"))


def all_spans(text: str | None, base: list, terms: list) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, removed): base spans as listed, then the disclosing terms near their entity."""
    spans = [(k, a, b, True) for k, a, b in base]
    if terms:
        level = {(t["entity"], t["term"]): t["posterior"] for t in terms}
        found: dict[tuple[int, int], float] = {}
        for entity, starts, ends, hashes in near_terms(text, base):
            for a, b, h in zip(starts.tolist(), ends.tolist(), hashes.tolist()):
                if (entity, h) in level:
                    found[a, b] = max(found.get((a, b), 0.0), level[entity, h])
        spans += [("term", a, b, found[a, b] >= REMOVE) for a, b in sorted(found)]
    return spans


def sanitised_text(text: str | None, spans: list) -> str | None:
    """``text`` with base entities replaced by their kind, disclosing terms removed or generalised; overlaps go as one."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, removed in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "" if kind == "term" and removed else "[WORD]" if kind == "term" else f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, spans (kind, start, end), clean (the sanitised text; null where nothing changes)."""
    import pyarrow as pa

    found = materialise(with_base(docs).withColumn("text_key", F.md5(F.col("text").cast("binary"))), "base-spans")
    known = found.where("text is not null")
    terms = disclosing(docs, known).alias("t")
    joined = known.alias("k").join(terms, F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.text_key") == F.col("t.text_key")), "left")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            spans, clean = [], []
            for text, base, own in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "terms"))):
                here = all_spans(text, [(s["kind"], s["start"], s["end"]) for s in base], own)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in here])
                clean.append(sanitised_text(text, here))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(spans, span), pa.array(clean, pa.string())], names=["doc_id", "base", "spans", "clean"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = "array<struct<kind: string, start: int, end: int>>"
    changed = joined.select("k.doc_id", "k.base", "k.text", "t.terms").mapInArrow(run, f"doc_id {kind}, base {shape}, spans {shape}, clean string")
    rest = found.where("text is null").select("doc_id", "base", F.col("base").alias("spans"), F.lit(None).cast("string").alias("clean"))
    both = changed.union(rest)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return both.select("doc_id", *map(count, KINDS), "base", "spans", "clean")


def listed(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


