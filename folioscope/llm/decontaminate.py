"""Benchmark decontamination: a BM25 inverted index of the test items, asked by every training passage with block-max WAND.

A passage is a window of words, twice as long as the longest test item and moved by half its length, so that each stretch
as long as an item lies whole in one. The BM25 impacts of an item are divided by their sum: an item's score is the share
of its own BM25 weight that the passage holds, and one threshold fits all items. Items above the threshold are verified
on five-word shingles: at least ``OVERLAP`` of those within the question (all but the item's last sentence), and of those
that touch the answer (the last sentence), must occur in the passage.

Test items are few by nature; still, the index is cut into parts of at most ``PART`` postings, each broadcast in turn for
one pass over the documents, with statistics over all items, so the broadcast is bounded and results do not depend on it.

Defined cases: words are lower-cased, ASCII punctuation parts them; null or empty texts and items without words match
nothing; an item of one sentence is all question; items of fewer than five words are one shingle; equal items with one id,
and equal rows, count once; null ids are kept; whole texts are searched; empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioscope.sources.storage import materialise

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE, OVERLAP = 5, 0.8
BLOCK = 16
PART = 200_000
#: Ranges of items whose bounds are summed for all windows of a document at once.
RANGES = 64
_SPLIT = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split() if text else []


def shingles(words: list, n: int = SHINGLE) -> list[tuple]:
    n = min(n, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def question_length(text: str) -> int:
    """How many words stand before the last sentence; all words if there is one sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(p)]
    return sum(len(words_of(p)) for p in parts[: max(1, len(parts) - 1)])


def postings(items: DataFrame) -> DataFrame:
    """(item_key, item_id, text, n_words, term, impact): impacts of an item sum to 1."""
    rows = items.select("item_id", "text").where("text is not null").distinct().withColumn("item_key", F.xxhash64("item_id", "text"))

    def cut(batches):
        for batch in batches:
            found = []
            for key, text in zip(batch["item_key"], batch["text"]):
                words = words_of(text)
                for term, n in pd.Series(words, dtype=object).value_counts().items():
                    found.append((key, len(words), term, float(n)))
            yield pd.DataFrame(found, columns=["item_key", "n_words", "term", "n"])

    terms = materialise(rows.select("item_key", "text").mapInPandas(cut, "item_key long, n_words int, term binary, n double"), "terms")
    size = terms.select("item_key", "n_words").distinct()
    n_items, mean = size.agg(F.count("*").cast("double")).scalar(), size.agg(F.avg("n_words")).scalar()
    spread = terms.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (n_items - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = weight * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("n_words") / mean))
    scored = terms.join(spread, "term").withColumn("raw", raw)
    sums = scored.groupBy("item_key").agg(F.sum("raw").alias("total"))
    return scored.join(sums, "item_key").join(rows, "item_key").select("item_key", "item_id", "text", "n_words", "term", (F.col("raw") / F.col("total")).alias("impact"))


@dataclass
class Index:
    """One part of the inverted index. Posting lists are sorted by item number and cut into blocks of ``BLOCK``."""

    ids: list
    longest: int
    vocabulary: dict
    lists: list  # per term: item numbers, impacts, last item and highest impact of each block, highest impact
    edges: np.ndarray  # item numbers at which the ranges begin, and the end
    bounds: np.ndarray  # per term and range: the highest impact
    question: list
    answer: list

    @classmethod
    def build(cls, part: pd.DataFrame) -> Index:
        # items that share their most common terms stand together, which keeps the bounds of ranges and blocks tight
        part = part.assign(df=part.groupby("term")["item_key"].transform("count"))
        common = part.sort_values(["df", "term"], ascending=False).groupby("item_key")["term"].agg(lambda x: b" ".join(map(bytes, x[:3])))
        items = part.drop_duplicates("item_key").assign(common=lambda x: x["item_key"].map(common)).sort_values(["common", "n_words", "item_key"])
        number = {k: i for i, k in enumerate(items["item_key"])}
        vocabulary, lists = {}, []
        part = part.assign(item=part["item_key"].map(number)).sort_values(["term", "item"])
        for term, group in part.groupby("term", sort=True):
            at, impact = group["item"].tolist(), group["impact"].tolist()
            blocks = range(0, len(at), BLOCK)
            vocabulary[bytes(term)] = len(lists)
            lists.append((at, impact, [at[min(i + BLOCK, len(at)) - 1] for i in blocks], [max(impact[i : i + BLOCK]) for i in blocks], max(impact)))
        question, answer = [], []
        for text in items["text"]:
            words, cut = words_of(text), question_length(text)
            every = shingles(words)
            inside = max(1, cut - SHINGLE + 1) if cut else 0  # an item shorter than a shingle is all question
            question.append(set(every[:inside]))
            answer.append(set(every[inside:]) if cut < len(words) else set())
        edges = np.unique(np.linspace(0, len(items), min(RANGES, len(items)) + 1).astype(np.int64))
        bounds = np.zeros((len(lists), len(edges) - 1), np.float32)
        for t, (at, impact, *_) in enumerate(lists):
            np.maximum.at(bounds[t], np.searchsorted(edges, at, "right") - 1, np.array(impact, np.float32))
        return cls(items["item_id"].tolist(), int(items["n_words"].max()), vocabulary, lists, edges, bounds, question, answer)

    def search(self, terms: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """All items from ``low`` up to ``high`` whose score over ``terms`` reaches ``threshold``, by block-max WAND."""
        high = len(self.ids) if high is None else high
        cursors = []
        for t in terms:
            items = self.lists[t][0]
            at = bisect_left(items, low)
            if at < len(items) and items[at] < high:
                cursors.append([items[at], at, t])
        found, slack = [], threshold - 1e-9
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                total += self.lists[t][4]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that would hold the pivot item bound its score more tightly than whole lists
            total, reach = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else high
            for now, at, t in cursors[: pivot + 1]:
                last, highest = self.lists[t][2], self.lists[t][3]
                block = at // BLOCK
                while block < len(last) and last[block] < item:
                    block += 1
                if block < len(last):
                    total += highest[block]
                    reach = min(reach, last[block] + 1)
            if total < slack:
                target = max(reach, item + 1)
            elif cursors[0][0] == item:
                score = sum(self.lists[t][1][at] for now, at, t in cursors[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            moved = []
            for now, at, t in cursors[: pivot + 1]:
                items = self.lists[t][0]
                while at < len(items) and items[at] < target:
                    block = at // BLOCK
                    at = (block + 1) * BLOCK if self.lists[t][2][block] < target else at + 1
                if at < len(items) and items[at] < high:
                    moved.append([items[at], at, t])
            cursors = moved + cursors[pivot + 1 :]
        return found

    def leaks(self, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple]:
        """item number -> (score, question overlap, answer overlap, first word of the passage) of verified items."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        places = np.flatnonzero(ids >= 0)
        if not len(places):
            return {}
        # the distinct terms of each window, and what they can add up to in each range of items
        width, half = len(self.lists), places // self.longest
        pairs = np.unique(np.concatenate([half * width, np.maximum(half - 1, 0) * width]) + np.tile(ids[places], 2))
        window, term = pairs // width, pairs % width
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        stops = np.append(starts[1:], len(window))
        found: dict[int, tuple] = {}
        asked: list[tuple[int, int]] = []
        for at in range(0, len(starts), 512):
            first = starts[at]
            sums = np.add.reduceat(self.bounds[term[first : stops[min(at + 512, len(starts)) - 1]]], starts[at : at + 512] - first, axis=0)
            asked += [(at + int(w), int(r)) for w, r in np.argwhere(sums >= threshold - 1e-4)]
        for n, r in asked:
            w = window[starts[n]]
            hits = self.search(term[starts[n] : stops[n]].tolist(), threshold, int(self.edges[r]), int(self.edges[r + 1]))
            if not hits:
                continue
            start = int(w) * self.longest
            passage = words[start : start + 2 * self.longest]
            present = {n: set(shingles(passage, n)) for n in range(1, SHINGLE + 1)}
            for item, score in hits:
                shares = []
                for wanted in (self.question[item], self.answer[item]):
                    shares.append(sum(s in present[len(s)] for s in wanted) / len(wanted) if wanted else 1.0)
                if min(shares) >= overlap and (item not in found or (shares[0] + shares[1], score) > (sum(found[item][1:3]), found[item][0])):
                    found[item] = (score, shares[0], shares[1], start)
        return found


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(item_id, doc_id, score, question_overlap, answer_overlap, first_word) for each item found in each document."""
    spark = docs.sparkSession
    whole = materialise(postings(items), "postings")
    parts = max(1, -(-whole.count() // PART))
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "item_id": items.schema["item_id"].dataType.simpleString()}
    schema = f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score double, question_overlap double, answer_overlap double, first_word int"
    found = None
    for part in range(parts):
        rows = whole.where(F.pmod(F.xxhash64("item_key"), F.lit(parts)) == part).toArrow().to_pandas(integer_object_nulls=True)  # about PART postings
        if not len(rows):
            continue
        index = spark.sparkContext.broadcast(Index.build(rows))

        def run(batches, index=index):
            import pyarrow as pa

            for batch in batches:
                told = index.value
                ids, out = batch.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                    out += [(told.ids[i], doc_id, *rest) for i, rest in told.leaks(text, threshold, overlap).items()]
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromDDL(schema))
        here = docs.select("doc_id", "text").where("text is not null").mapInArrow(run, schema)
        found = here if found is None else found.union(here)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.distinct()


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a test item. A null doc_id is matched like any other id."""
    bad = leaks(docs, items).select("doc_id").distinct().alias("b")
    return docs.alias("d").join(bad, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left_anti")
