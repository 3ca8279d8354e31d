"""Vectorised hashing of words and word shingles.

A word is a run of ASCII letters, digits and underscores and of any
characters beyond ASCII, in lower case.  Words are hashed from one prefix sum
over the bytes of a batch of texts, so no text is cut into Python strings.
All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Odd multipliers of the byte and the word polynomials.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Texts are hashed together up to so many bytes; a longer one is hashed alone.
BATCH_BYTES = 1 << 18

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _byte_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte base and of its inverse, at least ``n`` of them."""
    if len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + 4096)
        for k, base in enumerate((BYTE_BASE, pow(BYTE_BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def batches(texts: list[str | None], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts to hash together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offset of each text's first word (one more at the end)."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([b"", *parts, b""]), np.uint8)
    word = _IS_WORD[data]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[0::2] + 1, edges[1::2]
    powers, inverse = _byte_powers(len(data))
    sums = np.cumsum((data.astype(U64) + U64(1)) * powers[: len(data)], dtype=U64)
    hashes = mix((sums[ends] - sums[starts - 1]) * inverse[starts])
    firsts = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return hashes, np.searchsorted(starts, firsts)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words in each text, and each text's offsets.

    A text with words, but fewer than ``k``, has one shingle: all its words.
    """
    counts = np.diff(offsets)
    if not len(words):
        return words, np.zeros(len(offsets), np.int64)
    factors = [U64(pow(WORD_BASE, j, 1 << 64)) for j in range(k)]
    padded = np.concatenate([words, np.zeros(k - 1, U64)])
    sums = sum(padded[j : j + len(words)] * f for j, f in enumerate(factors))
    keep = np.ones(len(words), bool)
    ends = offsets[1:]
    for j in range(1, k):
        last = ends[counts >= j] - j
        keep[last] = False
    for n in range(1, k):
        at = offsets[:-1][counts == n]
        length = U64(n * 0x5851F42D4C957F2D % (1 << 64))
        sums[at] = sum((words[at + j] * factors[j] for j in range(1, n)), words[at] + length)
        keep[at] = True
    made = np.maximum(counts - (k - 1), np.minimum(counts, 1))
    return mix(sums[keep]), np.concatenate([[0], np.cumsum(made)])
