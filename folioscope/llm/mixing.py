"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Documents fall into cells by source, language and topic. The token weight of the cells is raked in turn to the target
shares of the sources, the languages and the topics. ``probability`` is then ``KEEP`` * raked weight / own weight of a
document's cell: the expected number of its copies in the mixture, above 1 where a cell has to weigh more than it holds.
The column copies tells how often it counts: the whole part, and the rest is drawn by a number from its id. No weight is cut
off, so the expected mixture has the target shares. Default targets are tempered: the share of a source, language or topic
is its token count to the power ``TEMPER``, normalised.

Only the cells are ever grouped: documents are summed up to cells on the map side, a round is three window sums over the
stored table of cells and their targets; every ``STORED`` rounds the table is stored anew in the shared folder.

Defined cases: tokens are the pieces between single spaces and line breaks, none in null or empty texts (such documents
are kept with probability ``KEEP``); null sources, languages and topics are cells of their own; values without a target
keep their weight; equal rows share their fate, for the number depends on the id alone (a null id counts as ``null``);
columns named topic, tokens, probability or copies are replaced, others stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folioscope.sources.storage import materialise

TEMPER = 0.5
KEEP = 0.5
ROUNDS = 20
STORED = 2  # rounds between two stored tables
DIMENSIONS = ("source", "lang", "topic")
ADDED = ("topic", "tokens", "probability", "copies")
#: The first topic one of whose marks occurs in the text; the rest is prose.
TOPIC_MARKS = [
    ("licence", ["icensed under", "ights reserved"]), ("table", [" | "]), ("contact", ["@", "+1 ("]), ("shout", ["!!"]),
]
ORDINARY = "prose"


def topic_of(text):
    found = F.lit(ORDINARY)
    for name, marks in reversed(TOPIC_MARKS):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(text, F.lit(mark))
        found = F.when(hit, name).otherwise(found)
    return F.when(text.isNull(), None).otherwise(found)


def token_count(text):
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(
        1 + F.length(text) - F.length(F.translate(text, " \n", ""))
    ).cast("long")


def draw(doc_id):
    """A number in [0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _key(column):
    return F.when(column.isNull(), "null").otherwise(F.concat(F.lit("="), column.cast("string")))


def tempered(cells: DataFrame, dimension: str, temper: float = TEMPER) -> DataFrame:
    """(key, share): the default targets of a dimension."""
    sums = cells.groupBy(F.col(dimension).alias("key")).agg(F.pow(F.sum("base"), F.lit(temper)).alias("raised")).where("raised > 0")
    return sums.select("key", (F.col("raised") / sums.agg(F.sum("raised")).scalar()).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (keys of ``DIMENSIONS``, base) with the raked weight ``x``; the weights sum to those of ``base``."""
    total = cells.agg(F.sum("base").cast("double")).first()[0] or 0.0
    now = cells.withColumns({"x": F.col("base").cast("double"), "total": F.lit(total)})
    for d, target in targets.items():
        now = now.join(target.select(F.col("key").alias(d), F.col("share").alias(f"goal_{d}")), d, "left")
    now = materialise(now, "cells")
    for k in range(1, rounds + 1):
        for d in targets:
            own = F.sum("x").over(Window.partitionBy(d))
            reached = F.col("x") * F.col(f"goal_{d}") * F.col("total") / own
            now = now.withColumn("x", F.when(F.col(f"goal_{d}").isNotNull() & (own > 0), reached).otherwise(F.col("x")))
        if k % STORED == 0 or k == rounds:
            now = materialise(now, "raked")
    return now.drop("total", *(f"goal_{d}" for d in targets))


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None, keep: float, rounds: int) -> DataFrame:
    """row (the columns of ``docs``), source, lang, topic (as keys), topic_name, tokens and probability of every document."""
    columns = [c for c in docs.columns if c not in ADDED]
    named = docs.select(
        F.struct(*columns).alias("row"), _key(F.col("source")).alias("source"), _key(F.col("lang")).alias("lang"),
        topic_of(F.col("text")).alias("topic_name"), token_count(F.col("text")).alias("tokens"),
    ).withColumn("topic", _key(F.col("topic_name")))
    cells = materialise(named.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("base")), "cells")
    goals = {d: (targets or {}).get(d) or tempered(cells, d) for d in DIMENSIONS}
    raked = rake(cells, goals, rounds).where("base > 0").select(*DIMENSIONS, F.round(keep * F.col("x") / F.col("base"), 9).alias("raked"))
    return named.join(raked, list(DIMENSIONS), "left").withColumn("probability", F.when(F.col("tokens") > 0, F.col("raked")).otherwise(keep))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """The documents (doc_id, text, source, lang, ...) that the mixture holds, with topic, tokens, probability and copies.

    ``targets`` maps a dimension to (key, share) with keys ``=value`` or ``null``; missing dimensions are tempered.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    whole = F.floor("probability")
    copies = (whole + (draw(F.col("row.doc_id")) < F.col("probability") - whole).cast("int")).cast("int")
    drawn = probabilities(docs, targets, keep, rounds).withColumn("copies", copies).where("copies > 0")
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("topic_name").alias("topic"), *ADDED[1:])


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The sample of ``documents`` with default targets as SQL, every rake a query of its own."""
    topic = " ".join(
        f"WHEN {' OR '.join(f'contains(text, {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{name}'" for name, marks in TOPIC_MARKS
    )
    steps = [f"""docs AS (
  SELECT doc_id, source, lang, CASE {topic} ELSE '{ORDINARY}' END AS topic,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE 1 + length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) END AS tokens
  FROM documents
)""", "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS base FROM docs GROUP BY ALL)"]
    for d in DIMENSIONS:
        steps.append(f"goal_{d} AS (SELECT {d}, pow(sum(base), {TEMPER}) / sum(pow(sum(base), {TEMPER})) OVER () AS share FROM cells GROUP BY {d})")
    steps.append("x0 AS (SELECT *, base AS x, sum(base) OVER () AS total FROM cells)")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"x{n + 1} AS (SELECT c.source, c.lang, c.topic, c.base, c.x * g.share * c.total / sum(c.x) OVER (PARTITION BY c.{d}) AS x, c.total FROM x{n} c JOIN goal_{d} g USING ({d}))")
            n += 1
    steps.append(f"""judged AS (
  SELECT doc_id, source, lang, topic, tokens, CASE WHEN tokens > 0 THEN round({KEEP} * x / base, 9) ELSE {KEEP} END AS probability,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / {float(1 << 52)} AS lot
  FROM docs JOIN x{n} USING (source, lang, topic)
), drawn AS (SELECT *, CAST(floor(probability) AS INTEGER) + CAST(lot < probability - floor(probability) AS INTEGER) AS copies FROM judged)""")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, copies FROM drawn WHERE copies > 0
"""
