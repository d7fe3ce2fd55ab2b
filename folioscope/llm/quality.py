"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, numpy SGD.

The features of a word are its own hash and those of its 3- and 4-grams of bytes (with word marks); a document also has
one feature per word that repeats the word 1 to ``LAGS`` places earlier, so that repetition of unseen words is visible.
A document's vector is the mean of its feature vectors. Because the softmax of two classes is linear in that mean, scoring
needs one number per feature: the fitted vectors are folded into it once. Features of a text are numbered by array operations.

Defined cases: a null or empty text has no features and gets the score of the bias alone; texts are used whole; repeated
rows get equal scores; an empty table gives no rows; if the labels hold fewer than two classes, every score is the share
of label 1 (1.0 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.words import SPACE, spaced, word_hashes

BITS = 15
DIM = 16
LAGS = 8
FEATURES = (1 << BITS) + LAGS
#: At most so many labelled documents of each class are used for fitting, those with the smallest hash of their id.
PER_CLASS = 800
ACCEPT = 0.7


def feature_numbers(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The feature number of every word and character n-gram of a text, and how often words repeat at each lag.

    N-grams of the text's bytes may begin or end with the space that marks a word's ends, but never run across one.
    """
    data = spaced(text)
    _, _, hashes = word_hashes(data)
    wide = data.astype(np.uint32)
    inner = data != SPACE
    three = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[inner[1:-1]]
    four = (wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:])[inner[1:-2] & inner[2:-1]]
    found = np.concatenate([
        (hashes >> np.uint64(64 - BITS)).astype(np.uint32),
        three * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), (four ^ four >> 15) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS),
    ])
    lags = [np.count_nonzero(hashes[lag:] == hashes[:-lag]) for lag in range(1, LAGS + 1)]
    return found, np.array(lags, np.float64)


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, label) to (label, feature numbers, counts): never longer than ``FEATURES``, however long the text."""
    for batch in batches:
        rows = []
        for text, label in zip(batch["text"], batch["label"]):
            found, lags = feature_numbers(text)
            count = np.concatenate([np.bincount(found, minlength=1 << BITS), lags])
            used = np.flatnonzero(count)
            rows.append((label, used.astype(np.int32).tobytes(), count[used].astype(np.float32).tobytes()))
        yield pd.DataFrame(rows, columns=["label", "features", "counts"])


@dataclass(frozen=True)
class QualityModel:
    """``weight`` of each feature (its vector folded with the softmax), ``bias``; ``constant`` if no fit was possible."""

    weight: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, total: float, n: float) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-(self.bias + (total / n if n else 0.0)))))


def train(rows: list, prior: float, epochs: int = 5, least_steps: int = 600, rate: float = 2.0, batch: int = 32, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent on vectors and softmax; ``rows`` are (label, feature numbers, counts).

    Both classes are drawn equally often, for at least ``least_steps`` batches; the bias is then moved to the ``prior``
    share of label 1.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (FEATURES, DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.1, (2, DIM)), np.zeros(2)
    data = [(int(y), b, (c / c.sum()).astype(np.float32)) for y, b, c in rows if len(b)]
    classes = [np.array([i for i, d in enumerate(data) if d[0] == y]) for y in (0, 1)]
    steps = max(least_steps, epochs * len(data) // batch)
    for step in range(steps):
        part = [data[i] for own in classes for i in rng.choice(own, batch // 2)]
        means = np.stack([share @ vectors[used] for _, used, share in part])
        logits = means @ softmax.T + bias
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(len(part)), [y for y, _, _ in part]] -= 1
        now = rate * (1 - step / steps)
        back = chance @ softmax
        softmax -= now / len(part) * chance.T @ means
        bias -= now / len(part) * chance.sum(axis=0)
        for (_, used, share), slope in zip(part, back):
            vectors[used] -= np.outer(share, now * slope)
    shift = np.log(prior / (1 - prior))
    fold = vectors @ (softmax[1] - softmax[0])
    return QualityModel(fold.astype(np.float64), float(bias[1] - bias[0] + shift))


def held_out(doc_id):
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); held-out rows take no part.

    The sample is bounded by ``per_class``; only its feature counts reach the driver. A document labelled twice counts
    with its lower label.
    """
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
        .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    share = known.groupBy("label").count().collect()
    total = sum(r["count"] for r in share)
    if len(share) < 2:
        constant = (share[0]["label"] if share else 1) * 1.0
        return QualityModel(np.zeros(FEATURES), 0.0, constant)
    sample = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # bounded by 2 * per_class ids
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample[0].union(sample[1])), "doc_id").select("text", "label")
    rows = [(r["label"], np.frombuffer(r["features"], np.int32), np.frombuffer(r["counts"], np.float32))
            for r in chosen.mapInPandas(features, "label int, features binary, counts binary").collect()]
    if len({y for y, b, _ in rows if len(b)}) < 2:
        return QualityModel(np.zeros(FEATURES), 0.0, sum(r["count"] for r in share if r["label"]) / total)
    prior = sum(r["count"] for r in share if r["label"]) / total
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # the same fit whatever the row order
    return train(rows, prior)


def scores(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, name: str = "quality_score") -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and the score as ``name``; any column of that name is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    folded = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers

    def run(batches):
        import pyarrow as pa

        told = folded.value
        for batch in batches:
            result = []
            for text in batch.column("text").to_pylist():
                found, lags = feature_numbers(text)
                total = told.weight[found].sum() + told.weight[-LAGS:] @ lags
                result.append(told.score(total, len(found) + lags.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(result, pa.float64())], names=[*keep, name]
            )

    needed = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return needed.mapInArrow(run, f"{kinds}`{name}` double")


def filter_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents whose score reaches ``accept``, with their own columns."""
    scored = scores(docs, fit(docs, labels), name="__quality_score")
    return scored.where(F.col("__quality_score") >= accept).select(*docs.columns)
