"""Line dedup: content-defined chunks of lines, repeated chunks removed after byte comparison. DataFrame functions only.

A number of each line (the first 32 bits of its MD5) feeds a rolling hash over ``WINDOW`` lines; a chunk ends after every
line whose rolling hash is smaller than that of both neighbours, so cuts depend on nearby lines alone and return to the
same places after an insertion. Cuts leave at least two lines on either side: all chunks are multi-line, except that a
text of one line is no chunk. Of chunks with equal bytes the one with the smallest (doc_id, text digest, place) stays.

Only digests are shuffled to find repeats (a partial aggregation, so a chunk in a third of all documents is one row per
task); the text of a repeated chunk then travels once per copy to be compared byte by byte.

Defined cases: null texts and one-line texts (the empty text too) stay; a text all of whose chunks repeat becomes empty;
rows with equal doc_id and text are one document and keep the same lines; null doc_ids come first; other columns stay,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import let

WINDOW = 2
_FACTOR, _MODULUS, _END = 31, 1 << 32, 1 << 31


def _number(line):
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _rolling(numbers):
    """The hash of every line with the ``WINDOW - 1`` lines before it (missing ones count as 0)."""

    def at(value, i):
        total = value
        for back in range(1, WINDOW):
            total = total + F.when(i >= back, F.get(numbers, i - back)).otherwise(0) * F.lit(_FACTOR**back)
        return total % F.lit(_MODULUS)

    return F.transform(numbers, at)


def chunk_codes(lines):
    """``first line * 2**31 + last line`` of each chunk, in order; no chunk for fewer than two lines."""
    last = F.size(lines) - 1

    def cut(rolling):
        inner = F.when(
            last >= 3,
            F.filter(F.sequence(F.lit(1), last - 2), lambda i: (F.get(rolling, i) < F.get(rolling, i - 1)) & (F.get(rolling, i) < F.get(rolling, i + 1))),
        ).otherwise(F.array().cast("array<int>"))
        return let(
            F.concat(inner, F.array(last)),
            lambda ends: F.transform(
                ends, lambda e, k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1).cast("long") * F.lit(_END) + e
            ),
        )

    codes = let(F.transform(lines, _number), lambda numbers: let(_rolling(numbers), cut))
    return F.when(last >= 1, codes).otherwise(F.array().cast("array<bigint>"))


def _first(code):
    return F.floor(code / F.lit(_END)).cast("int")


def _chunk(lines, code):
    first = _first(code)
    return F.array_join(F.slice(lines, first + 1, (code % F.lit(_END)).cast("int") - first + 1), "\n")


def _lines(text):
    return F.split(text, "\n", -1)


def _text_key(text):
    return F.unhex(F.md5(text.cast("binary")))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Every chunk to remove: doc_id, text_key, code, chunk (the bytes of the first occurrence, to be compared)."""
    named = docs.select("doc_id", "text").where("text is not null").withColumn("text_key", _text_key(F.col("text")))
    parts = named.select(
        "doc_id", "text_key",
        F.explode(let(_lines(F.col("text")), lambda x: F.transform(chunk_codes(x), lambda c: F.struct(c.alias("code"), F.unhex(F.md5(_chunk(x, c).cast("binary"))).alias("key"))))).alias("c"),
    ).select("doc_id", "text_key", "c.code", "c.key")
    place = F.struct("doc_id", "text_key", "code")
    repeated = parts.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    reps = repeated.select("first.doc_id", "first.text_key", F.struct(F.col("first.code").alias("code"), "key").alias("c")).groupBy("doc_id", "text_key").agg(F.collect_list("c").alias("wanted"))
    named, reps = named.alias("n"), reps.alias("r")
    same = F.col("n.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("n.text_key") == F.col("r.text_key"))
    texts = (
        named.join(reps, same)
        .select(F.explode(let(_lines(F.col("text")), lambda x: F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), _chunk(x, w["code"]).alias("chunk"))))).alias("c"))
        .select("c.key", "c.chunk").dropDuplicates(["key"])
    )
    copies = parts.join(repeated, "key").where(place != F.col("first")).select("doc_id", "text_key", "code", "key")
    return copies.join(texts, "key").select("doc_id", "text_key", "code", "chunk")


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("removed_chunks", "removed_lines")) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and how many chunks and lines went (replaced if present)."""
    columns = [c for c in docs.columns if c not in counts]
    gone = repeated_chunks(docs).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("code", "chunk")).alias("copies")).alias("g")
    rows = docs.select(F.struct(*columns).alias("row")).withColumn("key", _text_key(F.col("row.text"))).alias("d")
    joined = rows.join(gone, F.col("d.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.key") == F.col("g.text_key")), "left")

    def rewrite(lines):
        equal = F.transform(F.filter("copies", lambda c: _chunk(lines, c["code"]) == c["chunk"]), lambda c: c["code"])

        def rest(codes):
            kept = F.array_except(chunk_codes(lines), codes)
            return F.struct(
                F.array_join(F.transform(kept, lambda c: _chunk(lines, c)), "\n").alias("text"), F.size(codes).alias("chunks"),
                F.aggregate(codes, F.lit(0), lambda n, c: n + (c % F.lit(_END)).cast("int") - _first(c) + 1).alias("lines"),
            )

        return let(equal, rest)

    changed = F.when(F.col("copies").isNotNull(), let(_lines(F.col("row.text")), rewrite))
    done = joined.select("row", changed.alias("new"))
    return done.select(
        *[(F.when(F.col("new").isNull(), F.col("row.text")).otherwise(F.col("new.text")) if c == "text" else F.col("row").getField(c)).alias(c) for c in columns],
        F.coalesce("new.chunks", F.lit(0)).alias(counts[0]), F.coalesce("new.lines", F.lit(0)).alias(counts[1]),
    )


#: The text of every document without its repeated chunks, as ``dedup_lines`` leaves it.
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n
  FROM documents
), numbered AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines
), rolled AS (
  SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4294967296 AS r FROM numbered
), cuts AS (
  SELECT *, CASE WHEN i >= 1 AND i <= n - 3 AND r < lag(r) OVER w AND r < lead(r) OVER w THEN 1 ELSE 0 END AS cut
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cuts
), chunks AS (
  SELECT doc_id, k, n, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS size, min(i) AS start FROM placed GROUP BY doc_id, k, n
), judged AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk, n >= 2 ORDER BY doc_id, start) > 1 AS gone FROM chunks
)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_lines, count(*) FILTER (WHERE gone) AS removed_chunks,
  CAST(coalesce(sum(size) FILTER (WHERE gone), 0) AS BIGINT) AS removed_lines,
  md5(coalesce(string_agg(chunk, chr(10) ORDER BY start) FILTER (WHERE NOT gone), '')) AS text_md5
FROM judged GROUP BY doc_id
"""
