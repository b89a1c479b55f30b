"""Suffix arrays by the difference-cover algorithm (modulo 3), in vectorised numpy."""

from __future__ import annotations

import numpy as np


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks of rows of small numbers, equal rows equal, in lexicographic order."""
    out = columns[0]
    for c in columns[1:]:
        out = out * (int(c.max(initial=0)) + 1) + c
        _, out = np.unique(out, return_inverse=True)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text (numbers of 1 and more) in order; a suffix sorts before its extensions.

    The sample is the suffixes that start at 1 or 2 modulo 3. Their triples are sorted and named; where names repeat,
    the names' own suffix array orders the sample. The others sort by their first number and the sample's rank after
    it, and both are merged: each comparison needs two numbers and a rank at most.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int32)
    s = np.zeros(n + 3, np.int32)
    s[:n] = text
    one = np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32)  # where n leaves 1, an empty suffix ends the first run of the names
    sample = np.concatenate([one, np.arange(2, n, 3, dtype=np.int32)])
    top = int(s.max()) + 1
    if top < 1 << 21:
        triple = (s[sample].astype(np.int64) * top + s[sample + 1]) * top + s[sample + 2]
    else:
        triple = _dense(s[sample].astype(np.int64), s[sample + 1], s[sample + 2])
    order = np.argsort(triple, kind="stable").astype(np.int32)
    name = np.empty(len(sample), np.int32)
    name[order] = np.cumsum(np.diff(triple[order], prepend=triple[order[:1]] - 1) != 0)
    del triple
    if name[order[-1]] < len(sample):
        del order
        order = suffix_array(name)
    rank = np.zeros(n + 3, np.int32)
    ranked = sample[order]
    rank[ranked] = np.arange(1, len(sample) + 1, dtype=np.int32)
    del sample, order, name
    ranked = ranked[ranked < n]
    wide = 2 * (n // 3) + 4
    rest = np.arange(0, n, 3, dtype=np.int32)
    key = s[rest].astype(np.int64) * wide + rank[rest + 1]
    rest = rest[np.argsort(key, kind="stable")]
    key = s[rest].astype(np.int64) * wide + rank[rest + 1]
    first, second = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    place = np.arange(len(rest)) + np.searchsorted(s[first].astype(np.int64) * wide + rank[first + 1], key)
    pair = s[:-1].astype(np.int64) * top + s[1:]
    if top * top > (1 << 62) // wide:
        _, pair = np.unique(pair, return_inverse=True)
    place += np.searchsorted(pair[second] * wide + rank[second + 2], pair[rest] * wide + rank[rest + 2])
    del pair, key
    out = np.empty(n, np.int32)
    out[place] = rest
    others = np.ones(n, bool)
    others[place] = False
    out[others] = ranked
    return out
