"""Words of UTF-8 texts as 64-bit hashes, many texts at a time in numpy.

Two word classes are in use. ALNUM words are runs of ASCII letters and digits and of every
non-ASCII character; SPACED words are runs of anything but the six ASCII white-space
characters. A-Z is lower-cased, other letters stay as they are. Both classes are told apart
by single bytes, so that UTF-8 need not be decoded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_SEED = 20250101


def _byte_class(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


ALNUM = _byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
SPACED = _byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: For bytes.translate: lower case, and a space for each byte outside ALNUM words.
ALNUM_SPACES = bytes(int(LOWER[b]) if ALNUM[b] else 0x20 for b in range(256))
_VALUE = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order. Sorting is several times faster here than numpy's hashing."""
    x = np.sort(x, axis=None)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    return up(int(_MULT)), up(pow(int(_MULT), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, (n - 1).bit_length())
    return _powers(size)


class Words:
    """The words of a run of texts: hash, the bytes they cover, and where each text's words begin."""

    def __init__(self, raws: Sequence[bytes], kind: np.ndarray):
        self.blob = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        self.text_start = np.concatenate(([0], np.cumsum(sizes + 1)))
        low = LOWER[self.blob]
        inside = np.zeros(len(low) + 2, dtype=np.int8)
        inside[1:-1] = kind[self.blob]
        edges = np.flatnonzero(np.diff(inside))
        self.start, self.end = edges[::2], edges[1::2]
        up, down = powers(len(low) + 1)
        total = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[low] * up[: len(low)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, for the places that have so many."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix(out + _U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) + hashes[k : k + len(out)]
    return mix(out)


def shingles(words: Words, n: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the n-word shingles; a text of fewer words has its whole sequence as one, if short_whole."""
    owner = words.text_of()
    if len(words.hash) >= n:
        same = owner[: len(owner) - n + 1] == owner[n - 1 :]
        text, value = owner[: len(same)][same], runs(words.hash, n)[same]
    else:
        text, value = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if short_whole:
        extra_t, extra_v = [text], [value]
        for k in range(1, n):
            few = np.flatnonzero(words.count == k)
            if len(few):
                v = np.full(len(few), k, dtype=np.uint64)
                for j in range(k):
                    v = mix(v * _MULT + words.hash[words.first[few] + j])
                extra_t.append(few)
                extra_v.append(v)
        text, value = np.concatenate(extra_t), np.concatenate(extra_v)
    return text, value


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value), sorted."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    if len(text):
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])))
        text, value = text[new], value[new]
    return text, value
