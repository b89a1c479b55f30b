"""Word shingles of many texts at once, as 64-bit hashes, in vectorised numpy.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a shingle is WIDTH consecutive words, or the
whole sequence of a shorter text. Texts are hashed together in slices of bounded bytes; one longer text is a slice
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEFFICIENT = np.random.default_rng(42).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xCA5A826395121157)
    x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the total), for texts in UTF-8."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    up, down = _power(len(data))
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, stops = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    words = mix64((total[stops] - total[starts]) * down[starts])
    return words, np.append(0, np.searchsorted(starts, ends))


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width words from each place on; the last width - 1 places have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n] * _COEFFICIENT[0]
    for k in range(1, width):
        out = out + words[k : k + n] * _COEFFICIENT[k]
    return mix64(out + np.uint64(width))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a text without words."""
    for a, b in slices(texts):
        words, first = word_hashes(texts[a:b])
        every = sequence_hashes(words, width)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= width:
                yield np.unique(every[lo : hi - width + 1])
            elif hi > lo:
                yield sequence_hashes(words[lo:hi], int(hi - lo))
            else:
                yield np.zeros(0, dtype=np.uint64)
