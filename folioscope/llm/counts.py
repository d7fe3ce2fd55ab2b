"""Token counts by a two-tier lookup on the map side.

A text's token count is the sum of the lengths of its pre-tokens. The first tier is a compact broadcast table of frequent
pre-tokens and their lengths; the second is each worker's own cache, filled by encoding what the table lacks. No pre-token
is ever shuffled: the count is one pass over the texts, one row in, one row out.

The table only saves work, the counts are the same with any table or none (tested). It holds ``TABLE`` entries at most, made
from the first ``FIT_BYTES`` of at most ``FIT_TASKS`` evenly spaced scan tasks, of which each names its ``TASK_TOP`` most
frequent pre-tokens: bounds that do not grow with the input.

Defined cases: null and empty texts have no bytes and no tokens; special strings inside texts are what the library makes of
them by default; texts of any length are counted whole, in bounded stretches; equal rows and null ids get a row each; an
empty table gives no rows; columns named n_bytes, n_tokens or over_limit are replaced, others are kept if asked for.
"""

from __future__ import annotations

from collections import Counter

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.pretokens import LONGEST, ByteLevel, Pieces, merges_are_ranks

LIMIT = 512
TABLE = 1 << 15
FIT_TASKS = 256
FIT_BYTES = 1 << 18
TASK_TOP = 2000
ADDED = ("n_bytes", "n_tokens", "over_limit")


def tokenizer_source(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def frequent(docs: DataFrame, source: str, table: int = TABLE) -> list[tuple[str, int]]:
    """(pre-token, length) of the pre-tokens that stand out where the scan tasks begin; at most ``table`` pairs."""
    texts = docs.select("text")
    step = -(-max(1, texts.rdd.getNumPartitions()) // FIT_TASKS)

    def heads(batches):
        import pyarrow as pa

        if TaskContext.get().partitionId() % step:
            return
        tokenizer, seen, left = ByteLevel(source, False), Counter(), FIT_BYTES
        for batch in batches:
            for text in batch.column(0):
                part = (text.as_py() or "")[:left]
                left -= len(part)
                for words in tokenizer.pieces(part):
                    seen.update(words)
                if left <= 0:
                    break
            if left <= 0:
                break
        top = [(w, n) for w, n in seen.most_common(TASK_TOP) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    total = Counter()
    for word, n in texts.mapInArrow(heads, "word string, n long").collect():  # FIT_TASKS * TASK_TOP rows at most
        total[word] += n
    tokenizer = ByteLevel(source, False)
    ranked = sorted(total.items(), key=lambda p: (-p[1], p[0]))[:table]
    return [(word, len(tokenizer.ids(word))) for word, _ in ranked]


def packed(table: list[tuple[str, int]]) -> bytes:
    """The table as one Arrow buffer, a few bytes a word."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in table], pa.string()), pa.array([n for _, n in table], pa.uint16())], names=["word", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(buffer: bytes) -> dict[str, int]:
    import pyarrow as pa

    table = pa.ipc.open_stream(buffer).read_all()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))


_workers: dict[int, tuple[ByteLevel, Pieces]] = {}


def _lookup(key: int, source: str, ranked: bool, buffer: bytes) -> tuple[ByteLevel, Pieces]:
    """The tokenizer and cache of this worker, kept over its tasks."""
    if key not in _workers:
        _workers.clear()
        tokenizer = ByteLevel(source, False, ranked)
        _workers[key] = tokenizer, Pieces(lambda piece: len(tokenizer.ids(piece)), unpacked(buffer))
    return _workers[key]


def token_counts(docs: DataFrame, path: str, keep: list[str] | None = None, limit: int = LIMIT, table: int = TABLE) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` (text, ...) with n_bytes, n_tokens and over_limit.

    ``path`` names the file of a byte-level BPE tokenizer; its text travels to the workers, which need no such file.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    source = tokenizer_source(path)
    known = packed(frequent(docs, source, table)) if table else packed([])
    told = docs.sparkSession.sparkContext.broadcast((source, merges_are_ranks(source), known))
    key = hash((source, known))

    def run(batches):
        import pyarrow as pa

        tokenizer, lengths = _lookup(key, *told.value)
        for batch in batches:
            counts = []
            for text in batch.column("__text"):
                counts.append(sum(sum(map(lengths.__getitem__, words)) for words in tokenizer.pieces(text.as_py())) if text.is_valid else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__{i}") for i in range(len(keep))), batch.column("__bytes"), pa.array(counts, pa.int64())], names=names)

    names = [*(f"__{i}" for i in range(len(keep))), "n_bytes", "n_tokens"]
    needed = docs.select(
        *(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)), F.col("text").alias("__text"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("__bytes"),
    )
    kinds = "".join(f"`__{i}` {needed.schema[f'__{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    counted = needed.mapInArrow(run, f"{kinds}n_bytes long, n_tokens long")
    return counted.select(
        *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
