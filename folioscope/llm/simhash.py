"""SimHash near-duplicates found with vantage-point trees.

Fingerprints of 64 bits are the bit majorities of the XXH64 values of a text's word shingles. Distinct fingerprints alone
are searched. Distances between unrelated fingerprints gather around 32, where a triangle bound of 4 prunes next to
nothing, so the search is a forest: the bits are cut into ``BLOCKS`` blocks, and as two fingerprints at most ``RADIUS`` <
``BLOCKS`` bits apart agree in at least one block, the root of each tree parts them by block value. Below the roots:

* a shard above ``SHARD`` members is parted by Hamming distance to a vantage point, its smallest member, into bands one
  bit wider than ``RADIUS``: by the triangle bound, linked members are in the same or in neighbouring bands, so each
  member also visits the next band. The innermost band is linked to the vantage point itself and needs no search inside;
* bands still above ``SHARD`` are searched block by block of ``SHARD`` members, each pair of blocks in its own task;
* within a shard, members go from vantage point to vantage point: those within ``RADIUS`` are linked to it, and only
  the ones the bound leaves are compared.

A shard returns links that keep its connected parts together (at most a few per member), never all pairs of a group.
Components come from distributed star rounds over those links.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts are used whole; equal rows share
fingerprint and component; rows with a null doc_id get the smallest doc_id of their component, null if it has none; other
columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import connected_components
from folioscope.sources.storage import materialise

BLOCKS = 5
RADIUS = 4
SHINGLE = 4  # the contract of this operator; other operators on shingles take five words
SHARD = 2000


def fingerprint(text: str | None, shingle: int) -> int:
    """The signed 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space parts words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    span = min(shingle, len(words))
    starts = np.concatenate([[0], ends])[: len(words) - span + 1].tolist()
    stops = (ends[span - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])]
        values = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(values, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) of every row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _distance(values: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(values ^ point)


def links_within(values: np.ndarray, visitors: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect every resident within ``radius`` of another resident or of a visitor (visitors among
    themselves are searched where they live). Both are distinct uint64 arrays."""
    found = []

    def link(a, others):
        found.extend((int(a), int(b)) for b in others)

    rest, guests = values, visitors
    while len(rest):
        point = rest[0]
        away = _distance(rest, point)
        near = rest[away <= radius]
        link(point, near[near != point])
        if len(guests):
            link(point, guests[_distance(guests, point) <= radius])
        inner = near[near != point]
        if len(inner):  # by the triangle bound, who links to the inner ball lies at most 2 * radius from the vantage point
            shell = rest[(away > radius) & (away <= 2 * radius)]
            pool = np.concatenate([shell, guests[_distance(guests, point) <= 2 * radius]])
            for at in range(0, len(pool), 256):
                part = pool[at : at + 256]
                hit = _distance(part[:, None], inner[None, :]) <= radius
                first = hit.argmax(axis=1)  # one link each is enough: the inner ball is linked to the vantage point
                rows = np.flatnonzero(hit[np.arange(len(part)), first])
                found.extend((int(inner[first[r]]), int(part[r])) for r in rows)
        rest = rest[away > radius]
    return found


def _sparse_links(values: np.ndarray, cells: np.ndarray, radius: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within small cells (sorted by cell) by comparing each row with the 1st, 2nd, ... row after it; and the
    mask of rows in cells above ``limit``, which are left to ``links_within``."""
    _, start, size = np.unique(cells, return_index=True, return_counts=True)
    small = np.repeat(size <= limit, size)
    a, b = [], []
    index = np.flatnonzero(small)
    for step in range(1, limit):
        index = index[index + step < len(cells)]
        index = index[cells[index] == cells[index + step]]
        if not len(index):
            break
        hit = index[_distance(values[index], values[index + step]) <= radius]
        a.append(values[hit])
        b.append(values[hit + step])
    none = values[:0]
    return np.concatenate([none, *a]), np.concatenate([none, *b]), ~small


def _search(batches: Iterator, radius: int, small: int = 48) -> Iterator:
    """Rows (shard, guest, fp), sorted by shard, to links; a shard cut by a batch end is kept until it is whole."""
    import pyarrow as pa

    held: list = []

    def emit(table):
        shard = table.column("shard").to_numpy()
        guest = table.column("guest").to_numpy(zero_copy_only=False)
        values = table.column("fp").to_numpy().view(np.uint64)
        edge = np.flatnonzero(np.diff(shard)) + 1
        starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(shard)]])
        cells = np.repeat(np.arange(len(starts)), stops - starts)
        visited = np.unique(cells[guest])
        plain = ~np.isin(cells, visited)
        a, b, large = _sparse_links(values[plain], cells[plain], radius, small)
        pairs = []
        for cell in np.concatenate([np.unique(cells[plain][large]), visited]):
            own = slice(starts[cell], stops[cell])
            here, away = values[own], guest[own]
            pairs += links_within(here[~away], here[away], radius)
        more = np.array(pairs, np.uint64).reshape(-1, 2)
        a, b = np.concatenate([a, more[:, 0]]), np.concatenate([b, more[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        last = int(np.searchsorted(shard != shard[-1], False)) if shard[0] == shard[-1] else len(shard) - int(np.argmax(shard[::-1] != shard[-1]))
        if last == 0:
            held.append(batch)
            continue
        yield emit(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0])
        held = [batch.slice(last)]
    if held:
        yield emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct`` (column fp) at most ``radius`` bits apart."""
    assert radius < blocks
    width = [64 * k // blocks for k in range(blocks + 1)]
    value = [F.expr(f"shiftrightunsigned(fp, {lo}) & {(1 << (hi - lo)) - 1}L") for lo, hi in zip(width, width[1:])]
    members = distinct.select("fp", F.posexplode(F.array(*value)).alias("block", "value"))
    shards = members.groupBy("block", "value").agg(F.count("*").alias("n"), F.min("fp").alias("point")).where(F.col("n") > shard)
    joined = members.join(shards, ["block", "value"], "left")
    # small shards as they are; large ones by distance to their vantage point, each member also in the next band
    band = F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.col("point"))) / (radius + 1)).cast("int")
    placed = joined.select(
        "fp", "point", F.col("n").isNotNull().alias("large"),
        F.explode(
            F.when(F.col("n").isNull(), F.array(F.struct(F.xxhash64("block", "value").alias("shard"), F.lit(0).alias("band"), F.lit(False).alias("guest"))))
            .otherwise(F.array(
                F.struct(F.xxhash64("block", "value", band).alias("shard"), band.alias("band"), F.lit(False).alias("guest")),
                F.struct(F.xxhash64("block", "value", band + 1).alias("shard"), (band + 1).alias("band"), F.lit(True).alias("guest")),
            ))
        ).alias("p"),
    ).select("fp", "point", "large", "p.shard", "p.band", "p.guest")
    star = placed.where("large and band = 0 and fp <> point").select(F.col("point").alias("a"), F.col("fp").alias("b"))
    # the innermost band is linked to its vantage point: only its guests elsewhere remain to be searched
    searched = placed.where("not (large and band = 0)")
    plain = searched.where("not large").select("shard", "guest", "fp")
    banded = searched.where("large").select("shard", "guest", "fp")
    sizes = banded.groupBy("shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("tiles"), F.max(~F.col("guest")).alias("lived")).where("lived")
    cut = banded.join(sizes.select("shard", "tiles"), "shard").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # every tile of residents meets itself, the other tiles of residents and the tiles of guests, each pair in one shard
    meetings = """transform(sequence(0, tiles - 1), u -> if(guest,
        struct(if(tiles = 1, xxhash64(shard, 0, 0), xxhash64(shard, u, tile, 1)) as shard, true as guest),
        struct(xxhash64(shard, least(tile, u), greatest(tile, u)) as shard, u < tile as guest)))"""
    hosts = cut.where("not guest and tiles > 1").select(
        F.explode(F.expr("transform(sequence(0, tiles - 1), u -> xxhash64(shard, tile, u, 1))")).alias("shard"), F.lit(False).alias("guest"), "fp"
    )
    meet = cut.select("fp", F.explode(F.expr(meetings)).alias("p")).select("p.shard", "p.guest", "fp")
    rows = plain.union(meet).union(hosts)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(lambda it: _search(it, radius), "a long, b long")
    return star.union(found)


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the smallest doc_id reachable over links."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = connected_components(fingerprint_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = distinct.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    membership = placed.join(named, "component").select("fp", "component_id")
    return prints.join(membership, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` without those that have a near-duplicate of a smaller doc_id; equal rows become one. Rows without doc_id stay."""
    known = docs.where("doc_id is not null")
    kept = components(known, shingle, radius).where("doc_id = component_id").select("doc_id").distinct()
    rows = known.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.select(*docs.columns).union(docs.where("doc_id is null"))
