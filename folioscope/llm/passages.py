"""Substring dedup: MinHash banding of passages, verified by exact Jaccard, removals clustered by components.

Repeated passages need not begin or end with a line, so the paragraphs compared are placed by content: under each of
``BANDS`` random orders, the smallest five-word shingle of every ``REACH`` consecutive ones, their MinHash, begins a
paragraph of ``PASSAGE`` words. Equal text of ``PASSAGE + REACH - 1`` words (50) has a paragraph in common whatever
surrounds it, and paragraphs of similarity s share a band with probability about 1 - (1 - s)**BANDS: bands of one row each,
for high recall. Paragraphs that share a band are joined; those with other words are linked if the Jaccard similarity of
their shingles is at least ``SIMILAR``. Equal paragraphs are one node, so copies are never paired. In every component the
paragraph of the smallest (doc_id, place) stays, the others are removed.

Equal stretches are found at every position: all windows of ``PASSAGE`` words meet by their hash, packed in ``BUCKETS``
buckets, and windows that follow one another in the document and in the one that keeps them are one stretch. So an equal
stretch of ``PASSAGE`` words or more is found whole wherever it stands; the paragraphs add the similar ones.

Only hashes are shuffled; a key of very many different paragraphs is compared in tiles of ``TILE``, each pair of tiles in
its own group, which returns no more links than hold its parts together.

Defined cases: words are lower-cased and parted by white space; a text of fewer than ``PASSAGE`` words is one paragraph,
one of fewer than five words one shingle; null and empty texts and rows whose doc_id is no 64-bit integer take no part;
rows of one doc_id are one document, and each of its texts loses only words that stand in it; a passage repeated within
one document alone stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from folioscope.llm.common import connected_components
from folioscope.llm.words import _power_tables, mix, shingle_hashes, spaced, word_hashes
from folioscope.sources.storage import materialise

SHINGLE, SIMILAR = 5, 0.8
PASSAGE = 20
REACH = 31
BANDS = 2
TILE = 5000
#: Windows are dealt to so many buckets by their hash; a task sorts one bucket at a time, and packs so many windows at once.
BUCKETS = 4096
PACK = 1 << 20
#: Classes of shingles by their hash. Paragraphs hold at most 16 shingles, and two sets of at most 16 with similarity 0.8 or
#: more differ in at most (16 + 16) / 9, so in 3; of 5 classes at least two are equal. Pairs of equal classes are looked up.
CLASSES = 5
_FIRST, _SECOND = np.triu_indices(CLASSES, 1)
#: Texts are hashed together up to about so many bytes.
STRETCH = 1 << 15
#: Every byte, with the white space of ASCII as a space.
_SPACED = np.array([ord(" ") if chr(c).isspace() and c < 128 else c for c in range(256)], np.uint8)
_SALTS = [np.uint64(0xD6E8FEB86659FD93 * (band + 1) % (1 << 64)) for band in range(BANDS)]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` consecutive values, in log(width) steps."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(order: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Positions that are the smallest of some ``reach`` consecutive values (of all, if there are fewer)."""
    reach = min(reach, len(order))
    low = _sliding(order, reach, np.minimum)
    pad = np.zeros(reach - 1, order.dtype)
    return np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), reach, np.maximum) == order)


def anchors_of(order: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``anchors`` of every stretch of ``counts`` values (one or more) from ``starts``, in order, all looked for together."""
    owner = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    values = order[starts[owner] + at]
    edges = np.cumsum(counts) - counts
    found = values == np.minimum.reduceat(values, edges)[owner]  # all there is to see in a short one
    if len(values) >= REACH:
        low = _sliding(values, REACH, np.minimum)
        low[(at > counts[owner] - REACH)[: len(low)]] = 0  # would reach into the next one
        pad = np.zeros(REACH - 1, order.dtype)
        found |= _sliding(np.concatenate([pad, low, pad]), REACH, np.maximum) == values
    return starts[owner[found]] + at[found]


def hashed(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, edges of each text in them) of the texts in order, in stretches of about ``STRETCH`` bytes."""

    def together():
        starts, _, hashes = word_hashes(np.concatenate(held))
        return hashes, np.searchsorted(starts, np.cumsum([0, *map(len, held)]))

    held, size = [], 0
    for text in texts:
        lower = (text or "").lower()
        held.append(_SPACED[np.frombuffer(f" {lower} ".encode(), np.uint8)] if lower.isascii() else spaced(lower))
        size += len(held[-1])
        if size >= STRETCH:
            yield together()
            held, size = [], 0
    if held:
        yield together()


def paragraphs(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, contents, first words, ends) of a text's paragraphs, one per key and content."""
    return paragraphs_of(*next(hashed([text])))[1:]


def paragraphs_of(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, key, content, first word, end) of the paragraphs of texts, one per text, key and content."""
    sizes = np.diff(edges)
    if not len(hashes):
        return (np.empty(0, np.int64),) * 5
    shingles = np.zeros(len(hashes), np.uint64)
    whole = shingle_hashes(hashes, SHINGLE)
    shingles[: len(whole)] = whole  # those that reach into the next text are not used
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        shingles[edges[i]] = shingle_hashes(hashes[edges[i] : edges[i + 1]], SHINGLE)[0]
    counts = np.where(sizes > 0, np.maximum(1, sizes - SHINGLE + 1), 0)
    forward, backward = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * forward[: len(hashes)], out=sums[1:])
    filled = np.flatnonzero(counts)
    out = []
    for band in range(BANDS):
        order = mix(shingles + _SALTS[band])
        at = anchors_of(order, edges[filled], counts[filled])
        owner = np.searchsorted(edges, at, "right") - 1
        span = np.minimum(PASSAGE, sizes)[owner]
        start = np.minimum(at, edges[owner + 1] - span)
        content = mix((sums[start + span] - sums[start]) * backward[start])
        key = mix(order[at] ^ np.uint64(band))
        pair = key ^ mix(content)
        by = np.lexsort((pair, owner))
        new = np.append(True, (pair[by][1:] != pair[by][:-1]) | (owner[by][1:] != owner[by][:-1]))
        first = by[new]
        start, span, owner = start[first], span[first], owner[first]
        out.append((owner, key[first].view(np.int64), content[first].view(np.int64), start - edges[owner], start - edges[owner] + span))
    return tuple(np.concatenate(x) for x in zip(*out))


def contents_of(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The content numbers that ``paragraphs`` gives to the words from ``first`` to ``last`` (excluded), each in the text."""
    forward, backward = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * forward[: len(hashes)], out=sums[1:])
    return mix((sums[last] - sums[first]) * backward[first]).view(np.int64)


def located(docs: DataFrame) -> DataFrame:
    """(key, content, doc_id, first, last) of every paragraph."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, at = batch.column("doc_id").to_numpy(), 0
            parts = []
            for hashes, edges in hashed(batch.column("text").to_pylist()):
                number, *rest = paragraphs_of(hashes, edges)
                parts.append((ids[at + number], *rest))
                at += len(edges) - 1
            owner, keys, contents, first, last = (np.concatenate([np.empty(0, np.int64), *(p[i] for p in parts)]) for i in range(5))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(contents), pa.array(owner), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=["key", "content", "doc_id", "first", "last"],
            )

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "key long, content long, doc_id long, first int, last int")


def _stems(sets: list[bytes], shards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for every row and pair of classes a number, equal where the shard and both classes are equal; the rows' sets in one,
    and where each begins and ends)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets])
    flat = np.frombuffer(b"".join(sets), np.uint64)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])  # a shingle that a paragraph repeats counts once
    flat, owner = flat[new], owner[new]
    slot = owner * CLASSES + (flat % np.uint64(CLASSES)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat[order]), out=sums[1:])
    ends = np.searchsorted(slot[order], np.arange(len(sets) * CLASSES + 1))
    numbers = (sums[ends[1:]] - sums[ends[:-1]]).reshape(-1, CLASSES)
    numbers = mix(numbers + mix(shards.view(np.uint64))[:, None] + np.arange(CLASSES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    numbers = mix(numbers[:, _FIRST] + mix(numbers[:, _SECOND]))
    return numbers, flat, np.searchsorted(owner, np.arange(len(sets) + 1))


def similar_links(batches):
    """Rows (shard, guest, content, shingles) sorted by shard to links (a, b) that keep each shard's similar contents
    together; similarities are exact, and only pairs that share two classes of shingles and are not yet together are compared.
    Rows that share no two classes with another one of their shard are left out before."""
    import pandas as pd

    def linked(rows):
        """``rows``: (content, guest, set, numbers of the pairs of classes that it shares) of one shard."""
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        alike: dict[int, dict[int, list[int]]] = {}  # contents with two classes of shingles in common, by their part
        for j, (content, guest, own, numbers) in enumerate(rows):
            for number in numbers:
                parts = alike.setdefault(number, {})
                for old in [r for r in parts if root(r) != r]:
                    parts.setdefault(root(old), []).extend(parts.pop(old))
                for part, others in parts.items():
                    if root(part) == root(j):
                        continue
                    for i in others:
                        if rows[i][1] and guest:
                            continue  # guests meet where they live
                        common = len(rows[i][2] & own)
                        if common >= SIMILAR * (len(rows[i][2]) + len(own) - common):
                            a, b = root(i), root(j)
                            parent[max(a, b)] = min(a, b)
                            yield rows[i][0], content
                            break
                parts.setdefault(root(j), []).append(j)

    def of_shards(shards, guests, contents, sets):
        """Links of whole shards, given as columns."""
        if not len(shards):
            return
        numbers, flat, bounds = _stems(sets, shards)
        _, where, times = np.unique(numbers, return_inverse=True, return_counts=True)
        shared = times[where.reshape(numbers.shape)] > 1
        at, rows = None, []
        for i in np.flatnonzero(shared.any(axis=1)):
            if shards[i] != at:
                yield from linked(rows)
                at, rows = shards[i], []
            rows.append((int(contents[i]), bool(guests[i]), frozenset(flat[bounds[i] : bounds[i + 1]].tolist()), numbers[i][shared[i]].tolist()))
        yield from linked(rows)

    held: list = [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), []]  # the last shard may go on
    for batch in batches:
        columns = [batch["shard"].to_numpy(), batch["guest"].to_numpy(), batch["content"].to_numpy()]
        now = [np.concatenate([h, c]) for h, c in zip(held, columns)] + [held[3] + list(batch["shingles"])]
        cut = len(now[0]) - _tail(now[0])
        held = [c[cut:] for c in now]
        yield pd.DataFrame(list(of_shards(*(c[:cut] for c in now))), columns=["a", "b"]).astype("int64")
    yield pd.DataFrame(list(of_shards(*held)), columns=["a", "b"]).astype("int64")


def _tail(values: np.ndarray) -> int:
    """How many values at the end equal the last one."""
    other = np.flatnonzero(values != values[-1]) if len(values) else values
    return len(values) - int(other[-1]) - 1 if len(other) else len(values)


def content_shingles(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(content, shingles): the sorted shingle hashes, repeats included, of the paragraphs at ``places`` (content, doc_id, first, last)."""
    import pyarrow as pa

    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("content", "first", "last")).alias("wanted"))

    def run(batches):
        for batch in batches:
            lists, at, seen = batch.column("wanted"), 0, 0
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            columns = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
            for hashes, edges in hashed(batch.column("text").to_pylist()):
                own = sizes[at : at + len(edges) - 1]
                now = seen + int(own.sum())
                for found, sets in shingles_at(hashes, edges, own, *(c[seen:now] for c in columns)):
                    width = sets.shape[1] * sets.itemsize
                    ends = pa.py_buffer(np.arange(0, (len(sets) + 1) * width, width, dtype=np.int32))
                    binary = pa.Array.from_buffers(pa.binary(), len(sets), [None, ends, pa.py_buffer(sets)])
                    yield pa.RecordBatch.from_arrays([pa.array(found), binary], names=["content", "shingles"])
                at, seen = at + len(own), now

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("text is not null").join(wanted, "doc_id").select("text", "wanted")
    return rows.mapInArrow(run, "content long, shingles binary").dropDuplicates(["content"])


def shingles_at(
    hashes: np.ndarray, edges: np.ndarray, sizes: np.ndarray, content: np.ndarray, first: np.ndarray, last: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contents, their sorted shingle hashes, a row each) of the places of texts, ``sizes`` of each, by their number of words;
    without those that hold other words, as another text of the id is meant."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    here = np.flatnonzero(last <= np.diff(edges)[owner])
    first, last, content = first[here] + edges[owner[here]], last[here] + edges[owner[here]], content[here]
    same = contents_of(hashes, first, last) == content
    first, last, content = first[same], last[same], content[same]
    shingles = shingle_hashes(hashes, SHINGLE)
    for length in np.unique(last - first):
        chosen = last - first == length
        if length < SHINGLE:
            yield content[chosen], np.stack([shingle_hashes(hashes[a : a + length], SHINGLE) for a in first[chosen]])
        else:
            yield content[chosen], np.sort(shingles[first[chosen][:, None] + np.arange(length - SHINGLE + 1)], axis=1)


def repeated(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, first, last, content, component, kept_doc, kept_first): every paragraph that also stands in another document;
    ``component`` is the number of its class, the other two tell where the one that stays is."""
    spark = docs.sparkSession
    rows = materialise(located(docs), "paragraphs")
    shared = rows.groupBy("key").agg(
        F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("content").alias("c0"), F.max("content").alias("c1")
    ).where("d0 <> d1").select("key", (F.col("c0") != F.col("c1")).alias("several"))
    hits = materialise(rows.join(shared, "key"), "shared-paragraphs")
    contents = hits.where("several").groupBy("key", "content").agg(F.min(F.struct("doc_id", "first", "last")).alias("place"))
    contents = materialise(contents.select("key", "content", "place.*"), "contents")
    shingled = content_shingles(docs, contents.groupBy("content").agg(F.min(F.struct("doc_id", "first", "last")).alias("place")).select("content", "place.*"))
    members = contents.select("key", "content").join(shingled, "content")
    sizes = contents.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = members.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("content"), F.col("tiles")).cast("int")).select(
        "content", "shingles",
        F.explode(F.expr("transform(sequence(0, tiles - 1), u -> struct(xxhash64(key, least(tile, u), greatest(tile, u)) as shard, u < tile as guest))")).alias("p"),
    ).select("p.shard", "p.guest", "content", "shingles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "guest", "content").mapInPandas(similar_links, "a long, b long")
    classes = connected_components(links).withColumnRenamed("node", "content")
    placed = hits.select("content", "doc_id", "first", "last").join(classes, "content", "left").withColumn("component", F.coalesce("component", "content"))
    kept = placed.groupBy("component").agg(F.min(F.struct("doc_id", "first")).alias("kept"), F.max("doc_id").alias("last_doc")).where("kept.doc_id <> last_doc")
    return placed.join(kept.select("component", F.col("kept.doc_id").alias("kept_doc"), F.col("kept.first").alias("kept_first")), "component").select(
        "doc_id", "first", "last", "content", "component", "kept_doc", "kept_first"
    )


def windows(texts) -> Iterator[np.ndarray]:
    """For each text, the contents of the ``PASSAGE`` words from every position; none of a shorter text, which is a paragraph."""
    for hashes, edges in hashed(texts):
        first = np.arange(max(0, len(hashes) - PASSAGE + 1))
        found = contents_of(hashes, first, first + PASSAGE) if len(first) else np.empty(0, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield found[a : max(a, b - PASSAGE + 1)]


def packed_windows(docs: DataFrame) -> DataFrame:
    """(bucket, content, base, owner, place): the windows whose content falls to the bucket, by document, as bytes; documents
    as steps from the one before (the first from ``base``), steps and places in two bytes where they fit."""
    import pyarrow as pa

    def pack(held):
        held.sort(key=lambda h: h[0])
        sizes = [len(c) for _, c in held]
        content = np.concatenate([c for _, c in held])
        order = np.argsort((content.view(np.uint64) % np.uint64(BUCKETS)).astype(np.uint16), kind="stable")
        content = content[order]
        owner = np.repeat(np.array([d for d, _ in held], np.int64), sizes)[order]
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])[order]
        found, at = np.unique(content.view(np.uint64) % np.uint64(BUCKETS), return_index=True)
        base = owner[at]
        step = np.diff(owner, prepend=owner[:1])
        step[at] = 0
        narrow = lambda x, kind: x.astype(np.uint16) if x.max() < 1 << 16 and x.min() >= 0 else x.astype(kind)
        ends = np.append(at, len(order))
        binary = lambda x: pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        columns = [pa.array(found.astype(np.int32)), binary(content), pa.array(base), binary(narrow(step, np.int64)), binary(narrow(place, np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "content", "base", "owner", "place"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), windows(batch.column("text").to_pylist())):
                if len(content):
                    held.append((doc_id, content))
                    n += len(content)
                if n >= PACK:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "bucket int, content binary, base long, owner binary, place binary")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, content, kept_doc, kept_first): every window whose words also stand in another document; the
    one of the smallest (doc_id, place) stays."""
    import pyarrow as pa

    names = ["doc_id", "first", "last", "content", "kept_doc", "kept_first"]

    def of_bucket(rows):
        content = np.frombuffer(b"".join(r[0] for r in rows), np.int64)
        unpack = lambda data, n, wide: np.frombuffer(data, np.uint16 if len(data) == 2 * n else wide).astype(wide)
        owner = np.concatenate([base + np.cumsum(unpack(step, len(own) // 8, np.int64)) for own, base, step, _ in rows])
        place = np.concatenate([unpack(place, len(own) // 8, np.int32) for own, _, _, place in rows])
        order = np.argsort(content, kind="stable")
        same = content[order][1:] == content[order][:-1]
        several = np.zeros(len(order), bool)
        several[1:] |= same
        several[:-1] |= same
        order = order[several]  # only these need an order inside their content
        order = order[np.lexsort((place[order], owner[order], content[order]))]
        content, owner, place = content[order], owner[order], place[order]
        starts = np.flatnonzero(np.append(True, content[1:] != content[:-1])) if len(order) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(order)))
        across = np.repeat(owner[starts] != owner[starts + sizes - 1], sizes)
        kept_doc, kept_first = np.repeat(owner[starts], sizes), np.repeat(place[starts], sizes)
        columns = [x[across] for x in (owner, place, place + np.int32(PASSAGE), content, kept_doc, kept_first)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if bucket != at:
                    if rows:
                        yield of_bucket(rows)
                    at, rows = bucket, []
                rows.append(row)
        if rows:
            yield of_bucket(rows)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed_windows(docs).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc_id long, first int, last int, content long, kept_doc long, kept_first int")


def stretches(found: DataFrame) -> DataFrame:
    """(doc_id, first, last, kept_doc, kept_first): windows that follow one another here and where they stay, as one."""
    shift = F.col("kept_first") - F.col("first")
    along = W.partitionBy("doc_id", "kept_doc", "shift").orderBy("first")
    rows = found.select("doc_id", "first", "kept_doc", shift.alias("shift"))
    runs = rows.withColumn("run", F.col("first") - F.dense_rank().over(along)).groupBy("doc_id", "kept_doc", "shift", "run")
    return runs.agg(F.min("first").alias("first"), (F.max("first") + PASSAGE).alias("last")).select(
        "doc_id", "first", "last", "kept_doc", (F.col("first") + F.col("shift")).alias("kept_first")
    )


def repeats(docs: DataFrame) -> DataFrame:
    """One row per document that shares a passage: doc_id, component_id (the smallest document it shares one with, itself
    included), kept_docs (the documents that keep its passages), passages, removed_words, spans (first:end, word numbers)."""
    own = ["doc_id", "first", "last", "kept_doc"]
    equal = materialise(stretches(repeated_windows(docs)), "stretches")  # first, so that its shuffles are gone before the next
    found = repeated(docs).select(*own).unionByName(equal.select(*own))
    gone = F.col("kept_doc") != F.col("doc_id")
    rows = found.groupBy("doc_id").agg(
        F.min("kept_doc").alias("component_id"), F.array_sort(F.collect_set("kept_doc")).alias("kept_docs"),
        F.count_distinct("first", "last").alias("passages"), F.array_sort(F.collect_set(F.when(gone, F.struct("first", "last")))).alias("gone"),
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    words = F.aggregate(  # spans in order of their first words may overlap or hold one another
        "gone", none,
        lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], x["reach"]))).alias("n"), F.greatest(x["reach"], s["last"]).alias("reach")),
        lambda x: x["n"],
    )
    spans = F.array_join(F.transform("gone", lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return rows.select("doc_id", "component_id", "kept_docs", "passages", words.cast("long").alias("removed_words"), spans.alias("spans"))


def without_repeats(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """``text`` without the words of those ``spans`` (first, last, content) that stand in it; lines stay lines, as far as
    they keep words."""
    if not text or not spans:
        return text
    hashes = word_hashes(spaced(text.lower()))[2]
    first, last, content = (np.array(c) for c in zip(*spans))
    here = np.flatnonzero(last <= len(hashes))
    here = here[contents_of(hashes, first[here], last[here]) == content[here]]
    if not len(here):
        return text
    gone = np.zeros(len(hashes), bool)
    for a, b in zip(first[here], last[here]):
        gone[a:b] = True
    at, lines = 0, []
    for line in text.split("\n"):
        words = line.split()
        kept = [w for i, w in enumerate(words, at) if not gone[i]]
        at += len(words)
        lines += [line] if len(kept) == len(words) else [" ".join(kept)] if kept else []
    return "\n".join(lines)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with removed passages taken out of ``text``."""
    import pyarrow as pa

    every = ["doc_id", "first", "last", "content", "kept_doc"]
    found = repeated(docs).select(*every).unionByName(repeated_windows(docs).select(*every))
    gone = found.where("kept_doc <> doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("first", "last", "content")).alias("spans"))
    rows = docs.select(F.struct("*").alias("row")).alias("d")
    joined = rows.join(gone.alias("g"), F.col("d.row.doc_id").try_cast("long") == F.col("g.doc_id"), "left").select("row", "spans")
    names = docs.columns

    def run(batches):
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten()))
            spans = [[(s["first"], s["last"], s["content"]) for s in own or []] for own in batch.column("spans").to_pylist()]
            text = [without_repeats(t, s) for t, s in zip(columns["text"].to_pylist(), spans)]
            columns["text"] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(run, docs.schema)
