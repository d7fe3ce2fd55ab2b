"""Byte-level BPE and space-marked BPE in workers: the ids that the libraries give, in bounded memory.

The file of a byte-level tokenizer is read by ``tokenizers``. Merging by rank gives the same ids as its list of merges if
entries are numbered in the order of their merges and every entry encodes to itself (``merges_are_ranks`` checks both: two
neighbours whose join is an entry are then always the pair that its merge names); ``tiktoken`` does so several times faster.
Pre-tokens are found by a pattern where Unicode versions agree on the classes of characters (``SETTLED``). Any other text or
tokenizer is left to ``tokenizers`` itself.

Neither kind merges across a space that follows a letter or digit (for the space-marked kind if no entry holds a space mark
after another character, which is checked), so very long texts are encoded in stretches cut there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np

#: Characters whose class (letter, number, space, other) has been the same in all Unicode versions the libraries use.
SETTLED = "\t-\r -~¡-¬®-ȳΆ-ώЀ-џ‐-‧‰-›€、-〃ぁ-ゔァ-ヺ一-龥가-힣！-～"
#: Stretches of a very long text have about this many characters.
STRETCH = 1 << 18
#: Pieces longer than this are encoded each time and not kept.
LONGEST = 64
#: A worker keeps at most this many pieces besides the given table.
KEPT = 1 << 18

_odd = re.compile(f"[^{SETTLED}]")
_after_word = re.compile("(?<=[A-Za-z0-9]) ")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, each but the first starting with a space after a letter or digit."""
    at = 0
    while len(text) - at > size:
        cut = _after_word.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Pieces(dict):
    """``encode(piece)`` of every piece looked up, kept up to ``KEPT`` pieces besides the ones given."""

    def __init__(self, encode: Callable, given: dict | None = None, kept: int = KEPT):
        super().__init__(given or {})
        self.encode, self.given, self.most, self.missed = encode, dict(given or {}), kept + len(given or {}), 0

    def __missing__(self, piece: str):
        self.missed += 1
        value = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.given)
            self[piece] = value
        return value


def _shown() -> dict[str, int]:
    """The byte behind every character that byte-level entries are written with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def merges_are_ranks(source: str) -> bool:
    """Whether merging by rank gives the ids of the tokenizer in ``source`` (the text of its file)."""
    model = json.loads(source)["model"]
    if model.get("ignore_merges") or model.get("dropout"):
        return False
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    numbers = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if numbers != sorted(set(numbers)) or len(model["vocab"]) != 256 + len(pairs):
        return False
    shown, library = _shown(), ByteLevel(source, True).library
    single = library.model.tokenize
    return all(all(c in shown for c in entry) and [t.id for t in single(entry)] == [i] for entry, i in model["vocab"].items())


class ByteLevel:
    """A byte-level BPE tokenizer, from the text of its file; ``ranked`` as ``merges_are_ranks`` says."""

    def __init__(self, source: str, plain_specials: bool, ranked: bool = False):
        """``plain_specials``: strings of special tokens inside texts are ordinary text."""
        import regex
        from tokenizers import Tokenizer

        told = json.loads(source)
        kind = told["pre_tokenizer"] or {}
        if told["normalizer"] or kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space"):
            raise ValueError("only byte-level BPE with the usual pattern, without normaliser and prefix space, is supported")
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain_specials
        added = [] if plain_specials else [t["content"] for t in told["added_tokens"]]
        if added and any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        # longest first, as the library prefers the longer of two that start at one place
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        usual = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._usual = regex.compile(usual)
        self._ascii = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
        self._merge = self._whole = None
        if ranked:
            import tiktoken

            shown = _shown()
            ranks = {bytes(shown[c] for c in entry): i for entry, i in told["model"]["vocab"].items()}
            self._merge = tiktoken.Encoding("pieces", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
            self._whole = tiktoken.Encoding("texts", pat_str=usual, mergeable_ranks=ranks, special_tokens={})

    def ids(self, piece: str) -> list[int]:
        """The ids of one pre-token or special string."""
        if self._merge is None or self.added is not None and self.added.fullmatch(piece):
            return self.library.encode(piece, add_special_tokens=False).ids
        return self._merge.encode_ordinary(piece)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text without special tokens."""
        parts = []
        for part in stretches(text):
            if self._whole is None or self.added is not None and self.added.search(part) or _odd.search(part):
                parts.append(np.array(self.library.encode(part, add_special_tokens=False).ids, np.int32))
            else:
                parts.append(np.array(self._whole.encode_ordinary(part), np.int32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _cut(self, text: str) -> list[str]:
        if _odd.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return (self._ascii if text.isascii() else self._usual).findall(text)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of each stretch of ``text``; a special token is a piece of its own."""
        for part in stretches(text):
            if self.added is None or not self.added.search(part):
                yield self._cut(part)
                continue
            at = 0
            for found in self.added.finditer(part):
                yield self._cut(part[at : found.start()])
                yield [found.group()]
                at = found.end()
            yield self._cut(part[at:])

    def entry_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        shown, table = _shown(), [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for entry, i in self.library.get_vocab(with_added_tokens=True).items():
            table[i] = bytes(shown[c] for c in entry) if all(c in shown for c in entry) else entry.encode()
        return table


class SpaceMarked:
    """A BPE model of the ``sentencepiece`` library, which marks spaces and adds one in front."""

    MARK = "▁"

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.entries = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        inner = re.compile(f"[^{self.MARK}]{self.MARK}")
        shown = self.library.encode(" a  b", out_type=str)
        self.whole = "".join(shown) != f"{self.MARK * 2}a{self.MARK * 2}b" or any(inner.search(e) for e in self.entries)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, without the space that the library adds in front."""
        if self.whole or len(text) <= STRETCH:
            return np.array(self.library.encode(text, num_threads=1), np.int32)
        # every stretch begins with a space, which stands for the one that the library adds
        return np.concatenate([np.array(self.library.encode(part[1:], num_threads=1), np.int32) for part in stretches(" " + text)])

    def entry_bytes(self) -> list[bytes]:
        byte = re.compile("<0x([0-9A-Fa-f]{2})>")
        return [bytes([int(found[1], 16)]) if (found := byte.fullmatch(e)) else e.replace(self.MARK, " ").encode() for e in self.entries]


def slices(batch, size: int, column: str = "text"):
    """A record batch in slices of whole rows whose texts or lists have about ``size`` bytes or entries (a longer one is a slice)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    values = batch.column(column)
    lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    part = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
