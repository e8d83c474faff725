"""Word shingles of texts as arrays of 64-bit hashes."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

from tidewell.llm.common import chain64


class WordHashes(dict):
    """Words to 64-bit hashes; remembers short ones and forgets all when it grows past its bound."""

    limit, longest = 100_000, 64

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h


def word_hashes(texts: list[str], held: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, of the texts one after another, and each text's number of words."""
    words = [t.encode().lower().split() for t in texts]  # bytes: lower() changes A-Z only, split() knows ASCII white space only
    n = np.fromiter(map(len, words), np.int64, len(words))
    get = held.__getitem__
    flat = np.fromiter((h for w in words for h in map(get, w)), np.uint64, int(n.sum()))
    return flat, n


def shingle_sets(texts: list[str], held: WordHashes, width: int = 3) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a shorter text is one shingle, one without words has none."""
    flat, n = word_hashes(texts, held)
    ends = np.cumsum(n)
    windows = chain64(*[flat[k : len(flat) - width + 1 + k] for k in range(width)]) if len(flat) >= width else flat[:0]
    out = []
    for start, end, count in zip((ends - n).tolist(), ends.tolist(), n.tolist()):
        if count >= width:
            out.append(np.unique(windows[start : end - width + 1]))
        elif count:
            out.append(chain64(*[flat[i : i + 1] for i in range(start, end)]))
        else:
            out.append(flat[:0])
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed 64-bit integers."""
    raw = shingles.tobytes()
    return tuple(xxhash.xxh64_intdigest(raw, seed) - (1 << 63) for seed, _ in zip((1, 2), repeat(0)))
