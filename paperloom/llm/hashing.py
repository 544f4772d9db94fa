"""Vectorised hashes of substrings: any number of words or windows of a text in a few numpy passes."""

from __future__ import annotations

from functools import cache

import numpy as np

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Text that one pass covers; arrays take some 50 times as many bytes.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _letters(lane: int) -> np.ndarray:
    return np.random.default_rng(1234 + lane).integers(0, 2**64, 256, dtype=_U)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    have = _powers.get(lane)
    if have is None or len(have[0]) <= n:
        most = max(n, 1 << 16)
        base = int(_BASES[lane])
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(most + 1, b, _U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = (out[0], out[1])
        if n <= 2 * SLICE:
            _powers[lane] = have
    return have


class Substrings:
    """Hashes of parts of one buffer. Equal parts have equal hashes wherever they stand."""

    def __init__(self, buf: np.ndarray, lane: int = 0):
        up, self.down = _power(lane, len(buf))
        self.sums = np.zeros(len(buf) + 1, _U)
        np.cumsum(_letters(lane)[buf] * up[: len(buf)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, size: int) -> np.ndarray:
        """Of the window at every start."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII blanks."""
    blank = np.ones(len(buf) + 2, bool)
    blank[1:-1] = _BLANK[buf]
    change = np.flatnonzero(blank[1:] != blank[:-1])
    return change[::2], change[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word in order; long texts in slices that end at a blank."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > SLICE:
            cut = max(raw.rfind(b, at, at + SLICE) for b in (b" ", b"\n", b"\t"))
            end = cut + 1 if cut > at else end
        buf = np.frombuffer(raw, np.uint8, end - at, at)
        s, e = word_bounds(buf)
        out.append(mix(Substrings(buf).hash(s, e) + (e - s).astype(_U)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def many_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, offsets of each text's words); for texts of a slice together."""
    if len(texts) == 1:
        h = word_hashes(texts[0])
        return h, np.array([0, len(h)])
    raw = b" ".join(texts)
    buf = np.frombuffer(raw, np.uint8)
    s, e = word_bounds(buf)
    h = mix(Substrings(buf).hash(s, e) + (e - s).astype(_U)) if len(buf) else np.zeros(0, _U)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(s, first)
