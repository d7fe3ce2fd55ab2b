"""Reading structured values out of free-text model replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope import config
from folioscope.functions.scoring import spoiler_flag
from folioscope.functions.text import bind, strip

# Fixed patterns for ratings and JSON objects inside prose.
RATING = r"\[(\d+)\]:\s*(\d+)"
JSON_OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
NUMBERED = r"^\d+\."
FENCED_JSON = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"


def numbered_items(reply: Column, min_chars: int = config.MIN_EXPANSION_CHARS) -> Column:
    """Texts of the lines that begin with a number and a dot, if longer than ``min_chars``."""
    lines = F.transform(F.split(reply, "\n"), strip)
    numbered = F.filter(lines, lambda x: x.rlike(NUMBERED))
    return F.filter(
        F.transform(numbered, lambda x: strip(F.regexp_replace(x, NUMBERED, ""))), lambda x: F.length(x) > min_chars
    )


def ratings(reply: Column, n_passages: Column) -> Column:
    """``array<struct<idx, score>>`` of valid ratings, scores clamped to 1..10."""
    pairs = F.zip_with(
        F.regexp_extract_all(reply, F.lit(RATING), 1),
        F.regexp_extract_all(reply, F.lit(RATING), 2),
        lambda i, s: F.struct(
            i.try_cast("int").alias("idx"),
            F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce(s.try_cast("int"), F.lit(10)))).alias("score"),
        ),
    )
    return F.filter(pairs, lambda p: (p["idx"] >= 1) & (p["idx"] <= n_passages))


def rating_of(parsed: Column, idx: Column) -> Column:
    """Score of passage ``idx``; the last of several wins, 1 if not rated."""
    own = F.filter(parsed, lambda p: p["idx"] == idx)
    return F.coalesce(F.try_element_at(own, F.lit(-1))["score"], F.lit(1))


def _parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _has_keys(text: Column, keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.coalesce(F.size(F.array_except(wanted, F.json_object_keys(text))) == 0, F.lit(False))


def tolerant_json(reply: Column, keys: list[str], keys_in_tail: bool = False) -> Column:
    """The JSON text inside a reply, or null.

    Tried in turn: the whole reply; the first balanced object holding all
    ``keys``; a fenced block holding them; the span from the last opening to the
    last closing brace.
    """

    def first_match(pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(reply, F.lit(pattern), group)
        usable = F.filter(found, lambda x: _parses(x) & _has_keys(x, keys))
        return F.try_element_at(usable, F.lit(1))

    opened = F.length(reply) - F.length(F.substring_index(reply, "{", -1))
    closed = F.length(reply) - F.length(F.substring_index(reply, "}", -1))

    def usable_tail(tail: Column) -> Column:
        ok = _parses(tail) & _has_keys(tail, keys) if keys_in_tail else _parses(tail)
        return F.when((opened > 0) & (closed > opened) & ok, tail)

    return F.coalesce(
        bind(strip(reply), lambda whole: F.when(_parses(whole), whole)),
        first_match(JSON_OBJECT, 0),
        first_match(FENCED_JSON, 1),
        bind(F.substring(reply, opened, closed - opened + 1), usable_tail),
    )


def judge_scores(reply: Column) -> Column:
    """Struct of the five judge scores, defaults where the reply is unusable."""
    schema = ", ".join(f"{k} int" for k in config.JUDGE_KEYS)
    defaults = F.struct(*[F.lit(config.JUDGE_DEFAULTS[k]).alias(k) for k in config.JUDGE_KEYS])
    return bind(
        tolerant_json(reply, config.JUDGE_KEYS),
        lambda json: F.when(F.coalesce(F.size(F.json_object_keys(json)) > 0, F.lit(False)), F.from_json(json, schema)).otherwise(defaults),
    )


def judge_spoiler_flag(reply: Column, answer: Column, keywords: Column) -> Column:
    """1 when the judge finds no spoiler; keyword test if the reply is unusable."""

    def flag(json: Column) -> Column:
        usable = F.coalesce(F.size(F.json_object_keys(json)) > 0, F.lit(False))
        verdict = F.lower(F.get_json_object(json, "$.contains_spoilers"))
        clean = verdict.isNull() | verdict.isin("false", "0", "", "null")
        return F.when(usable, F.when(clean, 1).otherwise(0)).otherwise(spoiler_flag(answer, keywords))

    return bind(tolerant_json(reply, ["contains_spoilers"], keys_in_tail=True), flag)
