"""Near-duplicate self-join over a whole corpus: word sets that overlap by more than a limit.

Texts of equal word sets form a class, and classes are compared, so copies are never paired with one another. Candidates
come from prefix filtering: the words of a class are ordered from rare to common, and two sets above the limit share one of
their first few words. In the word that a pair shares first, all words before it are different, so few differences are left for
those after it: sizes, places and sketches of the words after it rule most pairs out where they meet, in numpy. Longer sketches
rule out most others there; the rest is verified on the whole sets. Nothing is left out: order and filters decide about cost only.

Sets are stored once, in blocks of about ``WORDS`` words and of similar sizes. A task reads the blocks
that it joins from the shared storage, lets them meet by their prefix words, verifies the pairs that are left and sums up what each class is
linked to. So the disk holds every set once and a row per class and task, never a posting, a pair, or a set for each of its pairs.

Rarity is read from a table of ``WIDTH`` counters by word hash, a fixed size whatever the vocabulary. A counter of one proves
that a word occurs in one text only, so it finds no partner.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from folioscope import config
from folioscope.functions.hashing import word_hashes
from folioscope.functions.text import SPACE_CHARS
from folioscope.operators.skew import lookup_join
from folioscope.sources.storage import materialise

#: Counters of the rarity table, a power of two.
WIDTH = 1 << 20
#: Pairs that a task compares at a time.
TILE = 1 << 17
#: Fewest bits of a sketch, a power of two of 64 or more, and sketches of that size that a task makes at a time.
BITS = 1024
SLICE = 1000
#: Classes and words of one block, blocks that a task holds at a time, and those it then joins with them one by one.
BLOCK = 1 << 15
WORDS = 3 << 19
JOINED = 3
PARTNERS = 8
#: Meetings of which a task makes pairs at a time, beyond those of one set.
MEETINGS = 1 << 21
#: Counters that a task gives, and pairs that it verifies, at once.
ROWS = 1 << 16
#: Steps of slack in the key of a posting, which has 16 bits for them.
STEPS = 65_000
#: Hashed words repeat in a block, though in far more than the usual megabyte of values.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(1 << 24)}
#: White space beyond ASCII, and every byte with that of ASCII as a space.
_WIDE_SPACE = re.compile(f"[{SPACE_CHARS[6:]}]")
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[ord(c) for c in SPACE_CHARS[:6]]] = ord(" ")
#: Keeps bounds on the safe side of rounding.
SLACK = 1e-9


def text_classes(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """``id``, ``class`` and, for texts that can be near-duplicates, the ``words`` as sorted 64-bit hashes and their ``size``.

    Texts longer than ``min_chars`` belong to the class of their word set, shorter ones to that of their own characters.
    Null and blank texts have no class.
    """

    def words(lower: str) -> np.ndarray:
        if not lower.isascii():
            lower = _WIDE_SPACE.sub(" ", lower)
        found = np.sort(word_hashes(_SPACED[np.frombuffer(f" {lower} ".encode(), np.uint8)])[2].view(np.int64))
        return found[np.append(True, found[1:] != found[:-1])] if len(found) else found

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            names, sets = [], []
            for text, lower in zip(batch.column("text").to_pylist(), batch.column("lower").to_pylist()):
                text = (text or "").strip(SPACE_CHARS)
                own = words(lower) if len(text) > min_chars else None
                named = b"t " + text.encode() if own is None else b"w " + own.tobytes()
                names.append(hashlib.md5(named).digest() if text else None)
                sets.append(own)
            sizes = [None if own is None else len(own) for own in sets]
            ends = pa.array(np.cumsum([0, *(n or 0 for n in sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *(own for own in sets if own is not None)]))
            lists = pa.ListArray.from_arrays(ends, flat, mask=pa.array([own is None for own in sets], pa.bool_()))
            columns = [batch.column("id"), pa.array(names, pa.binary()), lists, pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "class", "words", "size"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.lower(text_column).alias("lower"))
    return rows.mapInArrow(classes, f"id {rows.schema['id'].dataType.simpleString()}, class binary, words array<bigint>, size int")


def rarity_table(classes: DataFrame) -> np.ndarray:
    """Texts per counter; a word's counter is never below the number of texts that hold the word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(WIDTH, np.int64)
        for batch in batches:
            tokens = batch.column("words").flatten().to_numpy(zero_copy_only=False)
            own += np.bincount(tokens & (WIDTH - 1), minlength=WIDTH)
        slots = np.flatnonzero(own)
        for at in range(0, len(slots), ROWS):
            part = slots[at : at + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own[part])], ["slot", "n"])

    slots = classes.select("words").mapInArrow(counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = slots.toArrow()  # at most WIDTH rows
    counters = np.zeros(WIDTH, np.int64)
    counters[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counters


def size_blocks(classes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of classes by size: smallest size of each range, number of its first block, and blocks that classes of the
    range are dealt to. A range holds about ``WORDS`` words or ``BLOCK`` classes; a size with more of them is a range of its own."""
    sizes = classes.where("words IS NOT NULL").groupBy("class").agg(F.any_value("size").alias("size"))
    ranges, held = [], None  # least size, blocks
    for size, n in sorted(tuple(r) for r in sizes.groupBy("size").count().collect()):  # fewer sizes than the root of twice the words
        blocks = max(size * n / WORDS, n / BLOCK)
        if held is None or held + blocks > 1:
            ranges.append([size, 0.0])
            held = 0.0
        held += blocks
        ranges[-1][1] = held
    least = np.array([r[0] for r in ranges] or [0], np.int64)
    parts = np.ceil([max(r[1], 1e-9) for r in ranges] or [1]).astype(np.int64)
    return least, np.cumsum(parts) - parts, parts


def prefix_postings(classes: DataFrame, counters, limit: float) -> DataFrame:
    """A row per class, stored by ``block``: ``class``, ``size``, its ``words`` from rare to common, how many of them are those of its
    ``prefix``, how many come first that no other text has (``lone``), its texts (``n``) and their smallest id (``first``). A task gives the
    words of each class once, however many copies it reads."""
    least, lowest, parts = size_blocks(classes)
    kind = classes.schema["id"].dataType.simpleString()
    slice_size = SLICE

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[bytes, int] = {}
        for batch in batches:
            own = batch.column("class").to_pylist()
            new, copies = [], []
            for i, c in enumerate(own):
                (copies if c in told else new).append(i)
                told.setdefault(c, -1)
            for at in range(0, len(new), slice_size):
                part = batch.take(pa.array(new[at : at + slice_size]))
                sets = part.column("words")
                sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = sets.flatten().to_numpy(zero_copy_only=False)
                seen = np.minimum(counters.value[tokens & (WIDTH - 1)], (1 << 31) - 1)
                row = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(row << 31 | seen, kind="stable")  # words of a set are sorted, so equal counts leave them in that order
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(tokens[order]))
                prefix = sizes - np.ceil(limit * sizes - SLACK).astype(np.int64) + 1
                lone = np.bincount(row, seen <= 1, len(sizes)).astype(np.int64)
                band = np.searchsorted(least, sizes, side="right") - 1
                halves = np.frombuffer(b"".join(part.column("class").to_pylist()), "<u8").reshape(-1, 2)
                block = lowest[band] + (halves[:, 0] % parts[band].astype(np.uint64)).astype(np.int64)
                numbers = [pa.array(x.astype(np.int32)) for x in (sizes, prefix, lone, block)]
                told.update(zip(part.column("class").to_pylist(), block.tolist()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("class"), lists, *numbers], names)
            if copies:
                part = batch.take(pa.array(copies))
                blocks = pa.array([told[own[i]] for i in copies], pa.int32())
                nulls = [pa.nulls(len(copies), t) for t in (pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("class"), *nulls, blocks], names)

    names = ["id", "class", "words", "size", "prefix", "lone", "block"]
    held = classes.where("words IS NOT NULL").select("id", "class", "words")
    rows = held.mapInArrow(postings, f"id {kind}, class binary, words array<bigint>, size int, prefix int, lone int, block int")
    once = [F.any_value(c, F.lit(True)).alias(c) for c in ("words", "size", "prefix", "lone")]
    dealt = rows.repartition(int(parts.sum()), "block").groupBy("block", "class").agg(*once, F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return materialise(dealt, "prefix-words", by="block", **PACKED)


def _block_files(postings: DataFrame) -> dict[int, list[str]]:
    """Files of each block of stored postings."""
    found = defaultdict(list)
    for file in sorted(postings.inputFiles()):
        found[int(re.search(r"/block=(\d+)/[^/]*$", unquote(file)).group(1))].append(file)
    return dict(found)


def _read_block(files: list[str]) -> pa.Table:
    """Rows of a block, from the shared storage."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    tables = []
    for file in files:
        store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
        with store.open_input_file(path) as source:
            tables.append(pq.ParquetFile(source).read(["class", "words", "prefix", "lone", "n", "first"]))
    return pa.concat_tables(tables).combine_chunks()


class _Block:
    """The sets of a block: ``words`` of all, ``size``, ``start`` (number of the first word) and name of each, ``n`` and ``first`` of its
    texts, and the ``rank`` of ``first`` with the ``order`` of ranks.

    Their prefix words are postings: row of the ``set``, ``place`` of the word, ``slack`` left there, two sketches ``near`` and
    ``far`` of the words after it. They are sorted by ``key``: 48 bits of the word, then falling slack in ``STEPS`` steps.
    """

    def __init__(self, table: pa.Table, limit: float):
        lists = table.column("words").combine_chunks()
        self.names = table.column("class").combine_chunks()
        self.n, self.first = table.column("n").to_numpy(), table.column("first").combine_chunks()
        self.order = pc.sort_indices(self.first).to_numpy().astype(np.int64)  # null ids last
        self.rank = np.argsort(self.order)
        self.size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = lists.flatten().to_numpy(zero_copy_only=False)
        self.start = np.cumsum(self.size) - self.size
        self.sketches: dict[int, np.ndarray] = {}
        prefix, lone = (table.column(c).to_numpy().astype(np.int64) for c in ("prefix", "lone"))
        n = np.maximum(prefix - lone, 0)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - lone, n)
        slack = (1 - limit) / (1 + limit) * self.size[row] - place
        self.top = slack.max(initial=0.0)
        self.span = max(self.top - slack.min(initial=0.0), 1.0)
        key = (self.words[self.start[row] + place] & -(1 << 16)) | self.steps(-slack)
        order = np.argsort(key)
        self.key, self.set, self.place, self.slack = key[order], row[order].astype(np.int32), place[order].astype(np.int32), slack[order]
        at = self.start[self.set] + self.place
        self.near, self.far = (self._after(shift, at) for shift in (26, 32))

    def _after(self, shift: int, at: np.ndarray) -> np.ndarray:
        run = self.words >> shift
        run &= 63
        np.left_shift(1, run, out=run)
        np.bitwise_xor.accumulate(run, out=run)
        return (run[self.start + self.size - 1][self.set] ^ run[at]).view(np.uint64)

    def steps(self, least: np.ndarray) -> np.ndarray:
        """Steps from the top that hold all slack of ``-least`` or more."""
        return np.clip(np.floor((self.top + least) / self.span * STEPS), -1, (1 << 16) - 1).astype(np.int64)


def _meetings(a: _Block, b: _Block, limit: float, tile: int, meetings: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``i`` of ``a`` and ``j`` of ``b`` that meet in a prefix word and may pass the limit, with ``i`` < ``j`` in one block.

    About ``tile`` pairs are compared at a time. A pair comes once, though it may meet in several words: all that sets of ``b`` meet
    are looked at together, for as many sets as have about ``meetings``.
    """
    word = b.key & -(1 << 16)
    first = np.searchsorted(a.key, word)
    taken = np.flatnonzero(first < len(a.key))
    taken = taken[a.key[first[taken]] & -(1 << 16) == word[taken]]
    steps = a.steps(b.slack[taken] + SLACK)  # slack left in all
    taken, steps = taken[steps >= 0], steps[steps >= 0]
    first = first[taken]
    n = np.searchsorted(a.key, word[taken] + steps, side="right") - first
    taken, first, n = (x[n > 0] for x in (taken, first, n))
    part = (np.cumsum(np.bincount(b.set[taken], n, len(b.size))) // meetings)[b.set[taken]]
    for some in np.unique(part):
        whole, begin, each = (x[part == some] for x in (taken, first, n))
        ends = np.cumsum(each)
        at = done = 0
        pairs = []
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, done + tile, side="right")))
            y = np.repeat(whole[at:to], each[at:to])
            x = np.arange(done, ends[to - 1]) + np.repeat(begin[at:to] - (ends[at:to] - each[at:to]), each[at:to])
            at, done = to, ends[to - 1]
            # the words before the shared one are different if it is the first they share, so few differences are left after it
            left = a.slack[x] + b.slack[y] + SLACK
            for one, other in ((a.near, b.near), (a.far, b.far)):
                few = np.bitwise_count(one[x] ^ other[y]) <= left
                x, y, left = x[few], y[few], left[few]
            i, j = a.set[x].astype(np.int64), b.set[y].astype(np.int64)
            m, k = a.size[i], b.size[j]
            fit = np.minimum(m, k) >= np.maximum(m, k) * limit - SLACK
            fit &= np.minimum(m - a.place[x], k - b.place[y]) >= np.ceil(limit / (1 + limit) * (m + k) - SLACK)
            fit &= (i < j) | (a is not b)
            pairs.append(j[fit] * len(a.size) + i[fit])
        j, i = np.divmod(np.unique(np.concatenate(pairs)), len(a.size))
        yield i, j


def sketched(block: _Block, bits: int) -> np.ndarray:
    """A sketch of each set, of which bit i is set if an odd number of the set's words fall to it, as rows of 64-bit numbers.

    Two sketches differ in no more bits than their sets differ in words.
    """
    if bits not in block.sketches:
        made = block.sketches[bits] = np.empty((len(block.size), bits // 64), np.uint64)
        step = max(1, SLICE * BITS // bits)
        for at in range(0, len(made), step):
            sizes = block.size[at : at + step]
            words = block.words[block.start[at] : block.start[at] + sizes.sum()]
            bit = np.repeat(np.arange(len(sizes)), sizes) * bits + (words >> 20 & bits - 1)
            odd = (np.bincount(bit, minlength=len(sizes) * bits) & 1).astype(np.uint8)
            made[at : at + step] = np.packbits(odd).view(np.uint64).reshape(len(sizes), -1)
    return block.sketches[bits]


def sketch_bits(a: _Block, b: _Block, least: int) -> int:
    """Bits of sketches that tell sets of these blocks apart: those of unrelated sets differ in about half of them, so they must not be
    fewer than the words of a set."""
    return max(least, 1 << int(max(a.size.max(), b.size.max()) - 1).bit_length())


def not_too_different(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, limit: float, bits: int) -> np.ndarray:
    """Which of the pairs of rows have sketches that differ in no more bits than two sets above the limit may differ in words."""
    both = a.size[i] + b.size[j]
    most = both - 2 * np.ceil(limit / (1 + limit) * both - SLACK)
    return np.bitwise_count(sketched(a, bits)[i] ^ sketched(b, bits)[j]).sum(axis=1, dtype=np.int64) <= most


def _common(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Common words of the pairs of rows, by their whole sets; about ``most`` words of ``a`` are looked up at once. Rows ``j`` are sorted."""
    common = np.zeros(len(j), np.int64)
    empty = ~np.arange(1 << 18)  # no number is its own slot's
    table = empty.copy()
    cuts = np.flatnonzero(np.diff(j, prepend=-1, append=-1)).tolist()
    for at, to in zip(cuts[:-1], cuts[1:]):
        own = b.words[b.start[j[at]] : b.start[j[at]] + b.size[j[at]]]
        slots = own & len(table) - 1
        table[slots] = own
        rest = np.sort(own[table[slots] != own])  # another word has their slot
        sizes = a.size[i[at:to]]
        parts = np.cumsum(sizes) // most
        for part in np.split(np.arange(to - at), np.flatnonzero(np.diff(parts)) + 1):
            ends = np.cumsum(sizes[part])
            starts = ends - sizes[part]
            words = a.words[np.arange(ends[-1]) + np.repeat(a.start[i[at:to][part]] - starts, sizes[part])]
            hit = table[words & len(table) - 1] == words
            if len(rest):
                hit |= rest[np.minimum(np.searchsorted(rest, words), len(rest) - 1)] == words
            common[at + part] = np.add.reduceat(hit, starts, dtype=np.int64)
        table[slots] = empty[slots]
    return common


def verified(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, limit: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the pairs of rows are above the limit by their whole sets, and the common and all words of the pairs."""
    common = _common(a, b, i, j, most)
    union = a.size[i] + b.size[j] - common
    return common / union > limit, common, union


def _turned(a: pa.Array, b: pa.Array) -> list[pa.Array]:
    """The names of pairs, the smaller one first."""
    less = pc.less(a, b)
    return [pc.if_else(less, a, b), pc.if_else(less, b, a)]


def _cells(held: list[tuple[int, int, int]], limit: float, tasks: int) -> list[tuple[list[int], list[int]]]:
    """Up to ``JOINED`` blocks and those to join with them, the same ones and later ones of sizes that fit, by (least size, largest size,
    block); fewer than ``PARTNERS`` at a time if that makes about ``tasks`` of them."""
    held = sorted(held)
    joined = max(1, min(JOINED, -(-len(held) // tasks)))
    groups = []
    for at in range(0, len(held), joined):
        largest = max(most for _, most, _ in held[at : at + joined])
        groups.append((at, [k for k in range(at, len(held)) if k < at + joined or largest >= held[k][0] * limit - SLACK]))
    share = max(1, min(PARTNERS, -(-sum(len(others) for _, others in groups) // tasks)))
    number = lambda places: [held[k][2] for k in places]
    return [
        (number(range(at, min(at + joined, len(held)))), number(others[k : k + share])) for at, others in groups for k in range(0, len(others), share)
    ]


class _Sums:
    """For each set of a block, the rows of sets that it is linked to in another block, and the smallest rank of their ids there."""

    def __init__(self, block: _Block, other: _Block):
        self.block, self.other = block, other
        self.more = np.zeros(len(block.size), np.int64)
        self.least = np.full(len(block.size), len(other.size))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.more, i, self.other.n[j])
        np.minimum.at(self.least, i, self.other.rank[j])

    def told(self) -> pa.RecordBatch:
        linked = np.flatnonzero(self.more)
        before = self.other.first.take(pa.array(self.other.order[self.least[linked]]))
        return pa.RecordBatch.from_arrays([self.block.names.take(pa.array(linked)), pa.array(self.more[linked]), before], ["class", "more", "before"])


def candidate_pairs(postings: DataFrame, limit: float, give: str = "candidates") -> DataFrame:
    """Pairs ``a`` < ``b`` of classes that share a prefix word and may pass the limit by sizes, its places, what follows it and their sketches.

    A pair comes once. To ``give`` "links", those above the limit with their ``common`` and all words (``union``); to give "sums", a
    ``class`` with the rows of classes it is linked to (``more``) and their smallest id (``before``), once for each two blocks of such links.
    """
    spark = postings.sparkSession
    files = _block_files(postings)
    sizes = postings.groupBy("block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    cells = _cells([tuple(r) for r in sizes.select("least", "most", "block").collect()], limit, 4 * spark.sparkContext.defaultParallelism)
    tile, bits, meetings, rows = TILE, BITS, MEETINGS, ROWS
    schema = {
        "candidates": "a binary, b binary", "links": "a binary, b binary, common bigint, union bigint",
        "sums": f"class binary, more bigint, before {postings.schema['first'].dataType.simpleString()}",
    }[give]

    def passed(a: _Block, b: _Block) -> Iterator[tuple[np.ndarray, ...]]:
        wide = sketch_bits(a, b, bits)
        step = max(1, rows * bits // wide)
        for whole_i, whole_j in _meetings(a, b, limit, tile, meetings):
            for at in range(0, len(whole_i), step):
                i, j = whole_i[at : at + step], whole_j[at : at + step]
                few = not_too_different(a, b, i, j, limit, wide)
                i, j = i[few], j[few]
                if give == "candidates":
                    yield i, j
                else:
                    above, common, union = verified(a, b, i, j, limit, tile)
                    yield i[above], j[above], common[above], union[above]

    def pairs(a: _Block, b: _Block) -> Iterator[pa.RecordBatch]:
        for i, j, *counts in passed(a, b):
            columns = [*_turned(a.names.take(pa.array(i)), b.names.take(pa.array(j))), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "union"][: len(columns)])

    def sums(a: _Block, b: _Block) -> Iterator[pa.RecordBatch]:
        there, back = _Sums(a, b), _Sums(b, a)
        for i, j, *_ in passed(a, b):
            there.add(i, j)
            back.add(j, i)
        yield from (there.told(), back.told())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in (n for batch in batches for n in batch.column("id").to_pylist()):
            joined, others = cells[cell]
            held = [_Block(_read_block(files[block]), limit) for block in joined]
            for block in others:
                at = joined.index(block) if block in joined else len(joined)
                b = held[at] if block in joined else _Block(_read_block(files[block]), limit)
                for a in held[: at + 1]:  # earlier ones and itself, or all
                    yield from (batch for batch in (sums if give == "sums" else pairs)(a, b) if batch.num_rows)

    return spark.range(0, len(cells), 1, max(1, len(cells))).mapInArrow(run, schema)


def _homes(pairs: DataFrame) -> DataFrame:
    """``class`` and ``block`` of the classes in pairs: those of one smallest neighbour, in blocks of about ``BLOCK`` classes."""
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    leads = materialise(ends.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("lead")), "similar-leads")
    parts = leads.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("class"), F.col("parts"))
    return leads.join(parts, "lead").select("class", F.xxhash64("lead", part).alias("block"))


def class_links(classes: DataFrame, limit: float = config.NEAR_DUPLICATE_JACCARD, give: str = "links") -> DataFrame:
    """Pairs ``a`` < ``b`` of classes whose word sets overlap by more than the limit, with their ``common`` and all words, or their "sums"."""
    counters = classes.sparkSession.sparkContext.broadcast(rarity_table(classes))
    postings = prefix_postings(classes, counters, limit)
    counters.destroy()
    return candidate_pairs(postings, limit, give)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: float = config.NEAR_DUPLICATE_JACCARD,
    min_chars: int = config.NEAR_DUPLICATE_MIN_CHARS,
) -> DataFrame:
    """Each row's ``class_id``, number of links and earliest near-duplicate, over the whole table.

    Two rows are linked if their stripped texts are equal, or if both are longer than ``min_chars`` and the Jaccard
    similarity of their word sets is above ``limit``. ``class_id`` is the smallest id of the texts with this word set,
    ``n_links`` counts linked rows, copies included, and ``first_id`` is the smallest id of the row and its links:
    ``where(first_id = id)`` keeps texts without an earlier near-duplicate. Null and blank texts have class null, no links and
    themselves as first. Repeated ids are rows of their own; other columns are not touched. Words are compared by 64-bit hashes.
    """
    # read once: a filter on the words would otherwise be pushed down and cut every text again
    rows = materialise(text_classes(docs, id_column, text_column, min_chars), "text-classes", **PACKED)
    links = class_links(rows, limit, "sums").groupBy("class").agg(F.sum("more").alias("more"), F.min("before").alias("before"))
    beyond = materialise(links, "similar-classes")
    members = rows.where("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    known = members.join(beyond, "class", "left")
    joined = lookup_join(rows.select("id", "class"), known, ["class"], "left")
    return joined.select(
        F.col("id").alias(id_column), F.col("first").alias("class_id"),
        F.coalesce(F.col("n") - 1 + F.coalesce("more", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce(F.least("first", "before"), "id").alias("first_id"),
    )
