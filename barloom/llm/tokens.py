"""Token ids of whole texts by the tokenizers library, each distinct word being encoded once.

Both vocabularies split a text before merging, and a single blank between two visible characters always ends a piece of
that split; so does a single line end. So the ids of a text are the ids of its words one after the other, and a bounded
table keeps the ids of words by the words themselves. Texts with any other white space than single blanks and line ends
between words, or with "<|" (the start of a special token's string), go to the library whole. Words of letters alone, or
of letters and ASCII punctuation after them, are one piece of the split or two: the letters go straight to the library's
merge model, in the vocabulary's byte letters. Tests compare all ways with the library id by id.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache, partial
from string import punctuation

import numpy as np

#: Words, and words without the punctuation after them, that a Python worker keeps for each place, about 250 bytes each;
#: longer ones, and those that come later, are encoded whenever they occur.
CACHE_WORDS = 1_400_000
CACHE_LETTERS = 64


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


BYTE_LETTERS = byte_letters()


class Words(dict):
    """Ids by word, found once."""

    def __init__(self, ids: Callable[[str], bytes | None], most: int):
        super().__init__()
        self.ids, self.most = ids, most

    def __missing__(self, word: str) -> bytes | None:
        out = self.ids(word)
        if len(self) < self.most and len(word) <= CACHE_LETTERS:
            self[word] = out
        return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaced = self._raw(" b") != self._raw("b")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.line = self.whole("\n") if self.spaced else b""
        self.tails = Words(self.whole, 100_000)
        self.first = Words(partial(self._word, blank=False), CACHE_WORDS)
        self.later = Words(partial(self._word, blank=True), CACHE_WORDS)

    def _raw(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return array(self.code, self._raw(text)).tobytes()

    @staticmethod
    def _plain(text: str, words: list[str]) -> bool:
        """Whether single blanks and line ends are all the white space, none of it at an end or next to another.

        words are split at every white space that Python knows, so joined by single blanks they are such a text, but for
        its line ends.
        """
        return bool(words) and "<|" not in text and " ".join(words) == text.replace("\n", " ")

    def _mergeable(self, letters: str) -> bool:
        """Letters alone, on which normalising does no more than lower-case."""
        if self.spaced or letters.isascii():
            return letters.isalpha()
        return letters.isalpha() and letters.lower().isalpha() and "Σ" not in letters and unicodedata.is_normalized("NFC", letters)

    def _merge(self, word: str, blank: bool) -> bytes:
        """Ids of a mergeable word."""
        if not self.spaced:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize("Ġ" + word if blank and self.spaced else word)]).tobytes()

    def _word(self, word: str, blank: bool) -> bytes:
        """Ids of a word, after a blank or at the start of a line; one with punctuation after it takes those of the word alone."""
        letters = word.rstrip(punctuation)
        if self._mergeable(letters):
            if len(letters) == len(word):
                return self._merge(word, blank)
            return (self.later if blank else self.first)[letters] + self.tails[word[len(letters) :]]
        return self.whole(" " + word if blank and self.spaced else word)

    def _text(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.split()
        if not self._plain(text, words):
            return self.whole(text)
        if not self.spaced:
            return b"".join(map(self.first.__getitem__, words))
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:])))
        return self.line.join(lines)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes of self.kind."""
        return [self._text(t) for t in texts]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
