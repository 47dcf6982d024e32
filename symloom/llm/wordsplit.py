"""Cutting texts into the words that the lower-casing word-end BPE vocabularies encode one by one.

The vocabulary's own rules are: NFC, white space, lower case, then contractions, letter runs,
single digits and symbol runs. No word spans white space, so a text's ids are those of its white
space separated chunks, and chunks repeat: that is what the caches below live from.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: The vocabulary file's own pattern for words.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts within these characters are NFC already, and Python and the vocabulary's engine agree on
#: their white space, case, letters and digits. Other texts take the library's own steps.
NOT_PLAIN = re.compile(r"[^\t-\r -˿]")
#: Strings that the vocabulary file takes as one id wherever they stand.
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: Entries of a cache's young half; this bounds memory, not results.
CHUNKS, WORDS = 1 << 16, 1 << 18


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the letters from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


def letters(word: str) -> str:
    """A word's UTF-8 bytes as byte letters; printable ASCII stands for itself."""
    if word.isascii() and word.isprintable() and " " not in word:
        return word
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS)


def is_plain(text: str) -> bool:
    return NOT_PLAIN.search(text) is None and "<|" not in text


class Halves(dict):
    """A bounded cache: when the young half is full, it becomes the old one, which is dropped.

    ``make(key)`` gives the value of a new key (never None). Looking up a known key is a plain
    dict's work.
    """

    def __init__(self, size: int, make: Callable[[str], object]):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class ChunkCache:
    """Values of whitespace-free chunks, put together from the values of their words.

    ``code(word)`` gives the value of a new word, ``join(values)`` that of a chunk of several.
    """

    def __init__(self, code: Callable[[str], object], join: Callable[[list], object], chunks: int = CHUNKS, words: int = WORDS):
        self.words = Halves(words, code)
        known = self.words.__getitem__
        # a chunk of letters is one word
        self.chunks = Halves(chunks, lambda chunk: known(chunk) if chunk.isalpha() else join(list(map(known, PRE_TOKEN.findall(chunk)))))

    def values(self, text: str) -> list:
        """The values of a plain text's chunks, in order."""
        out = list(map(self.chunks.__getitem__, text.lower().split()))
        self.chunks.age()
        self.words.age()
        return out
