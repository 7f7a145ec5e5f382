"""Word hashes, window hashes and minimizer runs of one text, vectorised in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# ASCII white space parts words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Odd multipliers of the polynomial hashes; chosen at random, any odd ones do.
_BYTE = 0x9E3779B97F4A7C15
_WORD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word, so that sums of powers keep no structure of the bytes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 2 * len(self.tables[0]))
            self.tables = [
                np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in self.bases
            ]
        return self.tables[0][:n], self.tables[1][:n]


_TABLES = {base: _Powers(base) for base in (_BYTE, *_WORD)}


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    up, _ = _TABLES[base].upto(len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])


def _slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], independent of the place."""
    _, down = _TABLES[base].upto(len(sums))
    return _mix((sums[ends] - sums[starts]) * down[starts])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    edge = np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


@dataclass
class Words:
    """Prefix sums of a text's word hashes, in two independent lanes."""

    n: int
    sums: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, data: np.ndarray) -> Words:
        starts, ends = word_bounds(data)
        word = _slices(_sums(data.astype(np.uint64) + np.uint64(1), _BYTE), starts, ends, _BYTE)
        return cls(len(starts), (_sums(word, _WORD[0]), _sums(_mix(word + np.uint64(1)), _WORD[1])))

    def hashes(self, lane: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return _slices(self.sums[lane], starts, starts + size, _WORD[lane])


def runs(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, minimizer place) of the runs of windows that share a minimizer.

    The minimizer of a window is its k-word piece of smallest hash, the leftmost of equal ones, so it
    depends on nothing but the window.
    """
    n = words.n - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    pieces = words.hashes(0, np.arange(words.n - k + 1), k)
    wide = window - k + 1
    # Sliding argmin by doubling: best[i] is the place of the smallest piece in [i, i + size).
    best, size = np.arange(len(pieces)), 1
    while size < wide:
        step = min(size, wide - size)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(pieces[a] <= pieces[b], a, b)
        size += step
    best = best[:n]
    starts = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    return starts, np.diff(np.append(starts, n)), best[starts]
