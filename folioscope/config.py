"""Effective parameter values, collected in one place.

The values are fixed by the results they have to reproduce; every operator
takes them as arguments, these are only the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
LOCATION_CHARS = 1000          # characters per location
CHUNK_SIZE = 400
CHUNK_OVERLAP = 100
MIN_CHUNK_CHARS = 0            # floors are off: every text keeps a chunk
MIN_CHAPTER_BYTES = 0
EMBED_BATCH = 120              # chunks per embedding batch
SUMMARY_INTERVAL = 11          # locations between two summaries
DEFAULT_TOTAL_LOCATIONS = 100  # used when a book has no total

BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
BM25_SCALE = 0.95
BM25_WEIGHT = 0.4

# heads and thresholds of the four searches
BM25_LIMIT = 10
VECTOR_LIMIT, VECTOR_THRESHOLD = 15, 0.6
SUMMARY_LIMIT, SUMMARY_THRESHOLD, SUMMARY_WEIGHT = 5, 0.65, 0.4
EXPANDED_LIMIT, EXPANDED_THRESHOLD, EXPANDED_WEIGHT = 5, 0.5, 0.7
MIN_EXPANSION_CHARS = 5

RERANK_MIN_RESULTS = 8
RERANK_MIN_WORDS = 3
RERANK_HEAD = 15
RERANKED_LIMIT = 25
PLAIN_LIMIT = 10
EVALUATION_LIMIT = 6
NEAR_DUPLICATE_JACCARD = 0.7
NEAR_DUPLICATE_MIN_CHARS = 50

METHOD_ORDER = {"bm25": 0, "vector": 1, "summary": 2, "expanded_vector": 3}

GROUNDING_STOPWORDS = [
    "a", "an", "the", "is", "it", "in", "on", "of", "for", "to", "and", "but",
    "was", "were",
]
RETRIEVAL_STOPWORDS = GROUNDING_STOPWORDS + ["with", "by"]

REFUSAL_PHRASE = "information needed to answer is not available"
ERROR_MARKER = "ERROR:"
NO_CONTEXT_REPLY = (
    "I don't have enough information from the book to answer that question based on what you've read so far."
)
MISSING_CHAPTER_HTML = "<p>Chapter content not found</p>"

# fixed values: how chapters begin, what marks their titles, kinds in file names
OPENINGS = ["Prologue", "Epilogue", "Afterword", "Foreword", "Introduction", "Preface", "Appendix", "Notes"]
NUMBERED_OPENINGS = ["Chapter", "Section"]
TITLE_MARKS = ["title", "heading", "chapter"]
FILE_KINDS = ["epilogue", "prologue"]

JUDGE_KEYS = [
    "contextual_fidelity", "relevance", "helpfulness", "coherence",
    "instruction_following",
]
JUDGE_DEFAULTS = {
    "contextual_fidelity": 1, "relevance": 1, "helpfulness": 1, "coherence": 1,
    "instruction_following": 0,
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RetrievalParams:
    """Knobs of the hybrid retrieval plan."""

    bm25_limit: int = BM25_LIMIT
    bm25_weight: float = BM25_WEIGHT
    vector_limit: int = VECTOR_LIMIT
    vector_threshold: float = VECTOR_THRESHOLD
    summary_limit: int = SUMMARY_LIMIT
    summary_threshold: float = SUMMARY_THRESHOLD
    summary_weight: float = SUMMARY_WEIGHT
    expanded_limit: int = EXPANDED_LIMIT
    expanded_threshold: float = EXPANDED_THRESHOLD
    expanded_weight: float = EXPANDED_WEIGHT
    rerank_head: int = RERANK_HEAD
    reranked_limit: int = RERANKED_LIMIT
    plain_limit: int = PLAIN_LIMIT
    method_order: dict = field(default_factory=lambda: dict(METHOD_ORDER))
