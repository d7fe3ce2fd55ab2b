"""Tokens of whole batches of texts, split and counted as numpy arrays.

Lower-cased texts without a ``NOT_PLAIN`` character are split here by the classes of their bytes, as ``text.tokens`` splits
them; the others come as lists of tokens that the session's regular expressions made.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from folioscope.functions.text import SPACE_CHARS, tokens

#: A lower-cased text with one of these is not split by bytes. The rest are Latin letters and signs, dashes, quotes, bullets and dots.
NOT_PLAIN = "[^\\x{0}-\\x{24F}\\x{2010}-\\x{2027}]"
_GAP, _WORD, _MARK = 0, 1, 2
#: Texts split at once by a worker, in bytes beyond those of one text.
BYTES_AT_ONCE = 1 << 22


def _class_of(char: str) -> int:
    if char in SPACE_CHARS:
        return _GAP
    return _WORD if unicodedata.category(char) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Pc", "Mn", "Mc", "Me") else _MARK


_CLASSES = np.array([_class_of(chr(code)) for code in range(0x250)], np.uint8)
#: Every first byte of three begins a mark (U+2010 to U+2027).
_OF_BYTE = np.concatenate([_CLASSES[:128], np.full(128, _MARK, np.uint8)])


def split_plain(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(tokens of each text, all tokens in order) of lower-cased plain texts; a null text has none."""
    texts = texts.cast(pa.string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or edges[-1] == edges[0]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    kind = _OF_BYTE[data]
    first = (data & 0xC0) != 0x80  # of a character
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        two = wide[data[wide] < 0xE0]
        kind[two] = kind[two + 1] = _CLASSES[(data[two] & 0x1F).astype(np.int64) << 6 | (data[two + 1] & 0x3F)]
    word = kind == _WORD
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins |= (kind == _MARK) & first
    at = edges[:-1][edges[:-1] < edges[1:]]
    begins[at] |= word[at]
    sizes = np.diff(np.searchsorted(np.flatnonzero(begins), edges))
    inside = kind != _GAP
    values = data[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(values)).astype(np.int32)
    return sizes, pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def coded_texts(texts: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Stretches of rows of about ``BYTES_AT_ONCE``: (tokens of each row, row of each token in the stretch, its number, the
    different tokens by number). A row's tokens come from its list or, if that is null, from its text; not in order."""
    texts, listed = texts.cast(pa.string()), lists.is_valid()
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(sizes // BYTES_AT_ONCE)) + 1).tolist(), len(texts)]
    any_list = pc.any(listed).as_py()
    plain_texts = pc.if_else(listed, pa.scalar(None, pa.string()), texts) if any_list else texts
    for a, b in zip(edges, edges[1:]):
        counts, words = split_plain(plain_texts.slice(a, b - a))
        owner = np.repeat(np.arange(b - a), counts)
        if any_list:
            part = lists.slice(a, b - a)
            other = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            words = pa.concat_arrays([words, part.flatten().cast(pa.string())])
            owner, counts = np.concatenate([owner, np.repeat(np.arange(b - a), other)]), counts + other
        coded = words.dictionary_encode()
        yield counts, owner, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def buckets(distinct: pa.Array, dim: int) -> np.ndarray:
    """The first three bytes of each token's md5, as a number, modulo ``dim``."""
    md5 = hashlib.md5
    heads = b"".join([md5(t).digest()[:3] for t in distinct.cast(pa.binary()).to_pylist()])
    head = np.frombuffer(heads, np.uint8).reshape(-1, 3).astype(np.int64)
    return (head[:, 0] << 16 | head[:, 1] << 8 | head[:, 2]) % dim


def text_counts(text: Column, dim: int) -> Column:
    """(n_tokens, vector, terms) of a text: how many tokens it has, their counts hashed into ``dim`` buckets, and (term, tf) of
    each different one; what ``hashed_embedding`` and ``term_counts`` make of ``tokens``, in one pass."""

    @F.arrow_udf("struct<n_tokens:int,vector:array<float>,terms:array<struct<term:string,tf:int>>>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        totals, rows, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros(1, np.int64)]
        terms, times = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        for total, owner, codes, distinct in coded_texts(texts, lists):
            width = max(1, len(distinct))
            found, count = np.unique(owner * width + codes, return_counts=True)
            row, code = found // width, found % width
            totals.append(total)
            rows.append(np.bincount(row * dim + buckets(distinct, dim)[code], count, len(total) * dim).astype(np.float32))
            sizes.append(np.bincount(row, minlength=len(total)))
            terms.append(distinct.take(pa.array(code)))
            times.append(count)
        flat = np.concatenate(rows)
        pairs = pa.StructArray.from_arrays([pa.concat_arrays(terms), pa.array(np.concatenate(times).astype(np.int32))], ["term", "tf"])
        columns = [
            pa.array(np.concatenate(totals).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat)),
            pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pairs),
        ]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "vector", "terms"])

    lower = F.lower(text)
    wide = F.octet_length(text) != F.length(text)  # plain ASCII is known without the pattern
    return run(lower, F.when(wide & lower.rlike(NOT_PLAIN), tokens(text)))
