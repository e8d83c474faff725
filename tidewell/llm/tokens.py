"""Exact token ids from the tokenizers library with each distinct pre-token encoded once per worker."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

import numpy as np
import regex

from tidewell.llm.common import kept_in_worker

#: Pre-token patterns of the two published vocabularies (fixed values of their file formats).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Pre-tokens, and chunks between spaces, that a worker remembers, and the bytes of those strings with their ids.
CACHE_ENTRIES, CACHE_BYTES = 250_000, 8 << 20
#: The longest string remembered, in characters.
CACHE_CHARS = 256

#: Characters whose classes and case rules agree between the library and Python; other texts go to the library whole.
_PLAIN_BYTE = regex.compile(r"[^\x00-Ր‐-⁠　-〠一-鿿]")
_PLAIN_WORD = regex.compile(r"[^\x00-ɏ‐-⁠　-〠一-鿿]")


#: How byte-level vocabularies spell bytes: printable ones as themselves, the others as characters from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELLED = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


#: Stands for a line end before a chunk; texts that hold it go to the library whole.
LINE = "\0"


class OddChunk(Exception):
    """A chunk that isn't cut alone as it is within its text."""


class Remembered(dict):
    """Ids by string; what is missing is made by a function and kept while there is room.

    Frequent strings come early, so a full table keeps those.
    """

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make
        self.room = CACHE_BYTES

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= CACHE_CHARS and len(self) < CACHE_ENTRIES and self.room > 0:
            self[key] = ids
            self.room -= len(key) + len(ids)
        return ids


class PieceEncoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A text is cut at single spaces and line ends into chunks, these by the
    vocabulary's own pattern into pre-tokens, and each distinct pre-token is encoded
    by the library's model once.  Texts that hold an added token's string or
    characters outside the plain ranges are encoded by the library as a whole, so
    the result never differs from its own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = bool(spec["model"].get("end_of_word_suffix"))
        self.pattern = regex.compile(WORD_LEVEL if self.words else BYTE_LEVEL)
        self.strange = _PLAIN_WORD if self.words else _PLAIN_BYTE
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.cache = Remembered(self.pretoken)
        self.chunks = Remembered(self.word_chunk if self.words else self.byte_chunk)

    def plain(self, text: str) -> bool:
        return not any(a in text for a in self.added) and (text.isascii() or self.strange.search(text) is None)

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a plain text."""
        return self.pattern.findall(text.lower() if self.words else text)

    def model_ids(self, pretoken: str) -> bytes:
        """Ids of a pre-token by the library's model, as little-endian unsigned 32-bit integers."""
        spelled = pretoken.encode().decode("latin-1").translate(_SPELLED)
        return array("I", [t.id for t in self.model(spelled)]).tobytes()

    def letters(self, word: str, after_space: bool) -> bytes:
        """The same for letters alone, with or without a space before them."""
        space = _SPELLED[32] if after_space else ""
        spelled = space + (word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLED))
        return array("I", [t.id for t in self.model(spelled)]).tobytes()

    def pretoken(self, w: str) -> bytes:
        if w[0] == " " and (known := self.chunks.get(w[1:])):  # a word after a space may be known as a chunk
            return known
        return self.model_ids(w)

    def word_chunk(self, c: str) -> bytes:
        """Ids of what stands between white space."""
        return self.letters(c, False) if c.isalpha() else b"".join(map(self.cache.__getitem__, self.pattern.findall(c)))

    def byte_chunk(self, c: str) -> bytes:
        """Ids of what stands between two single spaces, with the space before it, or after a line end, with that.

        A space or line end before anything but white space always begins a
        pre-token, so such chunks are cut alone as they are within the text.
        """
        if c.isalpha():  # one pre-token
            return self.letters(c, True)
        line = c[:1] == LINE
        body = c[1:] if line else c
        if not body or body[0].isspace():
            raise OddChunk
        ids = b"".join(map(self.cache.__getitem__, self.pattern.findall(body if line else " " + body)))
        return self.cache["\n"] + ids if line else ids

    def cut_ids(self, text: str) -> bytes:
        """Ids by the pattern over the whole text."""
        return b"".join(map(self.cache.__getitem__, self.pretokens(text)))

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self.plain(text) or LINE in text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.words:
            return b"".join(map(self.chunks.__getitem__, text.lower().replace("\n", " ").split(" ")))
        parts = text.replace("\n", " " + LINE).split(" ")
        try:  # the first chunk has no space before it
            return self.cut_ids(parts[0]) + b"".join(map(self.chunks.__getitem__, parts[1:]))
        except OddChunk:
            return self.cut_ids(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return [self.ids(t) for t in texts]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary file."""
    return kept_in_worker(f"encoder {path}", lambda: PieceEncoder(path))
