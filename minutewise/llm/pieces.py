"""Encoding whole texts with the tokenizers library, one library call per distinct piece.

Where a tokenizer always cuts at certain places, the ids of a text are those of the pieces between them. A worker keeps
the ids of the pieces it has met. New ones that are a word with signs behind it, as most are, go to the tokenizer's
model alone, as the steps around it would do nothing; all others of a batch go through the whole tokenizer at once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from itertools import chain

from tokenizers import Tokenizer

# Pieces in a generation; a worker keeps those of the present one and the one before, and as many words. Bounds memory, not results.
KEPT_PIECES = 200_000
ASKED_AT_ONCE = 20_000

Encoder = Callable[[list[str]], list[bytes]]


# Signs that end a word and join no contraction.
_SIGNS = r".,!?;:*#%&$|()\"/+=<>@~^_`\[\]{}\\-"


def _plain_piece(letters: str) -> re.Pattern:
    """Letters with signs behind them, once or twice around a line break: each group is cut apart by any such pattern."""
    return re.compile(f"([{letters}]+)([{_SIGNS}]*)(?:(\n)([{letters}]+)([{_SIGNS}]*))?")


class Pieces:
    """Ids of pieces, as unsigned 32-bit integers in the machine's (little-endian) order."""

    def __init__(self, tokenizer: Tokenizer, plain: re.Pattern, prefix: str = "", kept: int = KEPT_PIECES):
        # plain: pieces whose groups normalisation leaves alone and the pattern cuts apart, so that each is the model's.
        self._tokenizer, self._plain, self._prefix, self._kept = tokenizer, plain, prefix, kept
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._merged: dict[str, bytes] = {}

    def _merge(self, word: str) -> bytes:
        found = self._merged.get(word)
        if found is None:
            spelled = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(_SPELLED)
            self._merged[word] = found = array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()
        return found

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces, one after the other."""
        fits, prefix = self._plain.fullmatch, self._prefix
        self._model = self._tokenizer.model
        wanted = set(chain.from_iterable(texts))
        new = wanted.difference(self._known)
        if len(self._known) + len(new) > self._kept:
            # What is still in use moves on into the new generation.
            self._known, self._before, new = {}, self._known, wanted
        known, before = self._known, self._before
        moved = new.intersection(before)
        known.update((p, before[p]) for p in moved)
        new.difference_update(moved)
        if len(self._merged) > self._kept:
            self._merged.clear()
        waiting = []
        for piece in new:
            if match := fits(piece):
                first, *more = match.groups()
                known[piece] = self._merge(prefix + first) + b"".join(map(self._merge, filter(None, more)))
            else:
                waiting.append(piece)
        for k in range(0, len(waiting), ASKED_AT_ONCE):
            asked = waiting[k : k + ASKED_AT_ONCE]
            told = self._tokenizer.encode_batch_fast([prefix + p for p in asked], add_special_tokens=False)
            known.update((p, array("I", e.ids).tobytes()) for p, e in zip(asked, told))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in texts]


# One printable character for each byte: itself if printable, else the next one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    return [_SPELLED.get(b, chr(b)) for b in range(256)]


# A space before something that is no white space starts a new match of the byte-level pattern, whatever stood before.
_BEFORE_WORD = re.compile(r"(?= \S)")
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def byte_level_encoder(tokenizer: Tokenizer, kept: int = KEPT_PIECES) -> Encoder:
    """texts -> their ids as bytes, for tokenizers whose pattern starts words with an optional space."""
    plain = _plain_piece("A-Za-zÀ-ÖØ-öø-ÿ")
    bare, spaced = Pieces(tokenizer, plain, kept=kept), Pieces(tokenizer, plain, " ", kept)

    def encode(texts: list[str]) -> list[bytes]:
        first, rest = [], []
        for text in texts:
            if _LOOSE_SPACE.search(text):
                first.append(_BEFORE_WORD.split(text))
                rest.append([])
            else:
                pieces = text.split(" ")
                first.append(pieces[:1])
                rest.append(pieces[1:])
        return [a + b for a, b in zip(bare.joined(first), spaced.joined(rest))]

    return encode


# Python counts these four as white space, the tokenizer's pattern does not.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WHITE = re.compile(r"[^\S\x1c-\x1f]+")
# Their small letter depends on the letters around, or is more than one character.
_CASED = re.compile("[Σİ]")


def word_encoder(tokenizer: Tokenizer) -> Encoder:
    """texts -> their ids as bytes, for tokenizers that drop white space and case and never look across white space."""
    words = Pieces(tokenizer, _plain_piece("a-zß-öø-ÿ"))

    def pieces(text: str) -> list[str]:
        # In small letters more words are the same; the tokenizer would lower-case them anyway.
        plain = text if _CASED.search(text) else text.lower()
        return _WHITE.split(plain) if _SEPARATORS.search(plain) else plain.split()

    return lambda texts: words.joined([pieces(t) for t in texts])
