"""Alignment of two tokenizers by the bytes that their tokens cover.

A text is encoded twice: with a space in front by a byte-level tokenizer (A), as it is by a space-marked one (B), which adds
that space. Every slice of a batch is worked on as Arrow columns: the lists of ids are flattened with their parent indices,
byte lengths are summed up by segments to the ends of the tokens, and a hash join on (document, end) finds the places where
tokens of both end. These places cut the tokens into groups, and each is a link of one token of A and one of B.

Links are stored as two lists of ids a document. Pair counts come from ``Table.group_by`` inside the tasks, merged by one
aggregation. Documents then read their counts in two ways, by frequency: the at most ``HOT`` most frequent pairs are
broadcast, a bound that does not grow with the input; links of rarer pairs are joined by a shuffle, in which no key has more
rows than the least frequent broadcast pair. Both ways are taken at every size.

Defined cases: documents that are null or empty, or whose tokens of A or B do not spell the text with its space, have no
tokens: zeros and an empty ``groups``; special strings are plain text; long texts are encoded in stretches cut where neither
tokenizer merges; equal rows and null ids get a row each; an empty table gives no rows; of further columns those in ``keep``
stay, others and the ones named like a result are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.counts import tokenizer_source
from folioscope.llm.pretokens import ByteLevel, SpaceMarked, merges_are_ranks, slices
from folioscope.sources.storage import materialise

#: About as many bytes of text are worked on at once, and as many links.
SLICE, LINKS = 1 << 19, 1 << 18
HOT = 1 << 19
PARTIAL = 1 << 20
ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "link_a", "link_b")


class Side:
    """The entries of one tokenizer as Arrow columns."""

    def __init__(self, entries: list[bytes]):
        import pyarrow as pa

        self.bytes = pa.array(entries, pa.binary())
        self.lengths = pa.array([len(e) for e in entries], pa.int64())
        self.names = pa.array([str(i) for i in range(len(entries))], pa.string())


def lists(ids: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32, copy=False)))


def spelled(tokens, side: Side):
    """The bytes that the tokens of each document spell."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join(pa.ListArray.from_arrays(tokens.offsets, side.bytes.take(tokens.values)), pa.scalar(b"", pa.binary()))


def ends(tokens, side: Side, name: str):
    """(doc, end, place) of every token: segmented sums of the byte lengths."""
    import pyarrow as pa
    import pyarrow.compute as pc

    doc, flat = pc.list_parent_indices(tokens), tokens.flatten()
    total = pc.cumulative_sum(side.lengths.take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(tokens.offsets[:-1])
    return pa.table({"doc": doc, "end": pc.subtract(total, before.take(doc)), name: pa.array(np.arange(len(flat)))})


def aligned_slice(texts, first: ByteLevel, second: SpaceMarked, a: Side, b: Side):
    """(tokens of A, tokens of B, offsets of links by document, places of the links in A and in B) of an Arrow column of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    given = [t or "" for t in texts.to_pylist()]
    none = np.empty(0, np.int32)
    left = lists([first.encode(" " + t) if t else none for t in given])
    right = lists([second.encode(t) if t else none for t in given])
    wanted = pa.array([(" " + t).encode() if t else b"" for t in given], pa.binary())
    fits = pc.and_(pc.equal(spelled(left, a), wanted), pc.equal(spelled(right, b), wanted))
    if not pc.all(fits).as_py():
        kept = fits.to_numpy(zero_copy_only=False)
        left, right = (lists([row.values.to_numpy() if k else none for row, k in zip(side, kept)]) for side in (left, right))
    met = ends(left, a, "i").join(ends(right, b, "j"), ["doc", "end"], join_type="inner", use_threads=False)
    order = np.argsort(met.column("i").to_numpy())
    doc, i, j = (met.column(c).to_numpy()[order] for c in ("doc", "i", "j"))
    offsets = np.zeros(len(given) + 1, np.int32)
    np.cumsum(np.bincount(doc, minlength=len(given)), out=offsets[1:])
    return left, right, offsets, i, j


def group_texts(left, right, offsets, i, j, a: Side, b: Side):
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def joined(tokens, side, places):
        edges = pa.array(np.concatenate([[0], places + 1]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(edges, side.names.take(tokens.values)), ",")

    groups = pc.binary_join_element_wise(joined(left, a, i), joined(right, b, j), "|")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), groups), ";")


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``keep`` (default: doc_id) of ``docs`` (text, ...) with n_a, n_b, n_groups, groups and the ids linked, link_a and link_b.

    ``groups`` is the text of the groups or, with ``digests``, its SHA-256 (empty without tokens).
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ADDED]
    source = tokenizer_source(a_path)
    with open(b_path, "rb") as file:
        model = file.read()
    if not all(ByteLevel(source, True).entry_bytes()) or not all(SpaceMarked(model).entry_bytes()):
        raise ValueError("tokenizers with entries of no bytes are not supported")
    told = docs.sparkSession.sparkContext.broadcast((source, merges_are_ranks(source), model))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        source, ranked, model = told.value
        first, second = ByteLevel(source, True, ranked), SpaceMarked(model)
        a, b = Side(first.entry_bytes()), Side(second.entry_bytes())
        for batch in batches:
            for part in slices(batch, SLICE, "__text"):
                left, right, offsets, i, j = aligned_slice(part.column("__text"), first, second, a, b)
                groups = group_texts(left, right, offsets, i, j, a, b)
                if digests:
                    groups = pa.array([hashlib.sha256(g.as_buffer()).hexdigest() if n else "" for g, n in zip(groups, np.diff(offsets))], pa.string())
                at = pa.array(offsets)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f"__{k}") for k in range(len(keep))), pc.list_value_length(left).cast("int64"), pc.list_value_length(right).cast("int64"),
                     pa.array(np.diff(offsets).astype(np.int64)), groups, pa.ListArray.from_arrays(at, left.values.take(pa.array(i))),
                     pa.ListArray.from_arrays(at, right.values.take(pa.array(j)))],
                    names=names,
                )

    results = ["n_a", "n_b", "n_groups", "groups", "link_a", "link_b"]
    names = [*(f"__{k}" for k in range(len(keep))), *results]
    needed = docs.select(*(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep)), F.col("text").alias("__text"))
    kinds = "".join(f"`__{k}` {needed.schema[f'__{k}'].dataType.simpleString()}, " for k in range(len(keep)))
    found = needed.mapInArrow(run, f"{kinds}n_a long, n_b long, n_groups long, groups string, link_a array<int>, link_b array<int>")
    return found.select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(keep)), *results)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n): how many links hold each pair of ids; ``links`` has link_a and link_b."""

    def partial(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

        def merged(tables):
            summed = pa.concat_tables(tables).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            return summed.select(["a", "b", "n_sum"]).rename_columns(["a", "b", "n"])

        held, size = [], 0
        for batch in (part for batch in batches for part in slices(batch, LINKS, "link_a")):
            pairs = pa.table({"a": batch.column("link_a").flatten(), "b": batch.column("link_b").flatten()})
            counted = pairs.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
            held.append(counted.select(["a", "b", "count_all"]).rename_columns(["a", "b", "n"]).cast(schema))
            size += held[-1].num_rows
            if size > PARTIAL:
                held = [merged(held)]
                size = held[0].num_rows
                if size > PARTIAL // 2:  # too many different pairs to go on merging them here
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, size = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=1 << 16)

    found = links.select("link_a", "link_b").mapInArrow(partial, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def known_pairs(counts: DataFrame) -> DataFrame:
    """(pair, n, best): a pair as one number, its count, and whether none of its B id has a higher one."""
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    return counts.join(highest, "b").select(pair.alias("pair"), "n", (F.col("n") == F.col("highest")).alias("best"))


def frequent_from(known: DataFrame, hot: int) -> int:
    """The least count from which pairs are broadcast: at most ``hot`` pairs have it."""
    step = F.floor(F.log2("n") * 16).cast("int")
    edges = known.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()  # some hundreds
    held, least = 0, None
    for row in edges:
        held += row["pairs"]
        if held > hot:
            break
        least = row["n"]
    return least if least is not None else (edges[0]["n"] + (1 << 62) if edges else 1)


def scored(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum instead of the lists of links."""
    spark = aligned.sparkSession
    keep = [c for c in aligned.columns if c not in ADDED]
    plain = [F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep)]
    rows = materialise(aligned.select(*plain, "n_a", "n_b", "n_groups", "groups", "link_a", "link_b").withColumn("row", F.monotonically_increasing_id()), "aligned")
    known = materialise(known_pairs(materialise(pair_counts(rows), "pairs")), "known-pairs")
    least = frequent_from(known, hot)
    top = known.where(F.col("n") >= least).toPandas().sort_values("pair")  # at most ``hot`` pairs
    told = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    carried = [*(f"__{k}" for k in range(len(keep))), "n_a", "n_b", "n_groups", "groups", "row"]

    def read(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pairs, counts, best = told.value
        for batch in (part for batch in batches for part in slices(batch, LINKS, "link_a")):
            a, b = batch.column("link_a"), batch.column("link_b")
            key = (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
            hit = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(a).to_numpy())]).astype(np.int32)

            def totals(values):
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets]))

            n = np.where(hit, counts[at], 0) if len(pairs) else np.zeros(len(key), np.int64)
            top = hit & best[at] if len(pairs) else hit
            rest = np.concatenate([[0], np.cumsum(~hit)])[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(np.diff(offsets).astype(np.int64)), totals(top), totals(n),
                 pa.ListArray.from_arrays(pa.array(rest), pa.array(key[~hit]))],
                names=[*carried, "n_links", "n_best", "count_sum", "rest"],
            )

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carried)
    begun = materialise(rows.mapInArrow(read, f"{kinds}n_links long, n_best long, count_sum long, rest array<long>"), "counted")
    rare = begun.select("row", F.explode("rest").alias("pair")).join(known.where(F.col("n") < least), "pair")
    added = rare.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more_sum"))
    return begun.join(added, "row", "left").select(
        *(F.col(f"__{k}").alias(c) for k, c in enumerate(keep)), "n_a", "n_b", "n_groups", "groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
