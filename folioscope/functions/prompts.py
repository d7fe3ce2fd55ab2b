"""Prompts for the model calls, built as columns.

Replies come back through ``hooks.with_reply`` or a reply table and are read by
``parsing``. Wording is free; the reply formats asked for are what the parsers read.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope import config


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def expansion(title: Column, question: Column) -> Column:
    """Asks for two rewritten queries as a numbered list."""
    return _text(
        "Rewrite the question about the book '", title, "' as 2 alternative search queries naming its people, actions and ideas.\n\n",
        "Original query: ", question, "\n\nAnswer with a numbered list only:",
    )


def segment_summary(text: Column, location: Column) -> Column:
    """Asks for a short summary of a stretch of a book."""
    return _text("Summarise in a few sentences what happens up to location ", location, ", naming people and places:\n\n", text)


def evaluated_answer(question: Column, passages: Column) -> Column:
    """Asks for an answer from numbered passages only."""
    numbered = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n\n")
    return _text("Context:\n", numbered, "\n\nQuestion: ", question, "\n\nIf the context is not enough, say that the ", config.REFUSAL_PHRASE, ".\nAnswer:")


def quality_judgement(question: Column, truth: Column, answer: Column) -> Column:
    """Asks for the five quality scores as JSON."""
    scale = ", ".join(f'"{k}": <{"0-1" if k == "instruction_following" else "1-5"}>' for k in config.JUDGE_KEYS)
    return _text("Compare the answer with the ground truth and give scores as JSON only.\nQuery: ", question, "\nGround truth: ", truth, "\nAnswer: ", answer, "\nOutput: {" + scale + "}")


def spoiler_judgement(book: Column, progress: Column, keywords: Column, answer: Column) -> Column:
    """Asks whether an answer gives away forbidden content, as JSON."""
    return _text(
        "Does the answer mention or hint at forbidden content? JSON only.\nBook: ", book, "\nProgress: ", progress, "%\nForbidden: ",
        F.array_join(keywords, ", "), "\nAnswer: ", answer, '\nOutput: {"contains_spoilers": true/false, "reasoning": "..."}',
    )
