"""64-bit hashes of words and of runs of them, in numpy.

Words and lines are hashed whole by SipHash. A run's hash is made from the hashes of two shorter runs that cover it, by a step
that isn't linear, so that no pattern of words (periodic, alternating, Thue-Morse) makes
different runs equal, as it does with polynomials modulo 2**64; what is left is chance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are words at once.
CHUNK = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def string_hashes(found: list, key: str = "evidora-strings.") -> np.ndarray:
    """The SipHash of each of a list of bytes or strings (those as UTF-8)."""
    out = np.empty(len(found), object)
    out[:] = found
    return pd.util.hash_array(out, hash_key=key, categorize=False) if len(found) else np.empty(0, U)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the UTF-8 bytes data."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of the bytes data. Long texts go in chunks that end between words."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + CHUNK)
        parts.append(string_hashes(data[at:end].tobytes().split()))  # bytes.split() splits at just the six characters
        at = end
    return np.concatenate(parts) if parts else np.empty(0, U)


def buffers(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column (null: none)."""
    for text in column:
        buffer = text.as_buffer() if text.is_valid else None
        yield np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)


def many_words(texts: Iterable[np.ndarray], most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at once (about `most` words of them; a longer text comes alone): the hashes of all their words, and the bounds
    of the texts in them."""
    words: list[bytes] = []
    bounds = [0]
    for data in texts:
        if len(data) > CHUNK:
            if len(bounds) > 1:
                yield string_hashes(words), np.array(bounds)
                words, bounds = [], [0]
            h = word_hashes(data)
            yield h, np.array([0, len(h)])
            continue
        words += data.tobytes().split()
        bounds.append(len(words))
        if len(words) >= most:
            yield string_hashes(words), np.array(bounds)
            words, bounds = [], [0]
    if len(bounds) > 1:
        yield string_hashes(words), np.array(bounds)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + (b ^ (b >> U(29))) * U(0xD1342543DE82EF95) + U(1))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values of h from each place on (the last places: none)."""
    if len(h) < n:
        return np.empty(0, U)
    size = 1
    with np.errstate(over="ignore"):
        while 2 * size <= n:
            h = _join(h[:-size], h[size:])
            size *= 2
        return _join(h[: len(h) - (n - size)], h[n - size :]) if size < n else h


class Runs:
    """Hashes of runs of any lengths: the two longest runs of a power of two that cover one, and its length, make it."""

    def __init__(self, h: np.ndarray):
        self.levels = [h]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the values from start up to end, which must be more."""
        size = end - start
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(start), U)
        with np.errstate(over="ignore"):
            for j in range(int(level.max(initial=-1)) + 1):
                if j == len(self.levels):
                    h, step = self.levels[-1], 1 << (j - 1)
                    self.levels.append(_join(h[:-step], h[step:]))
                at = np.flatnonzero(level == j)
                out[at] = _join(self.levels[j][start[at]], self.levels[j][end[at] - (1 << j)] + size[at].astype(U))
        return out
