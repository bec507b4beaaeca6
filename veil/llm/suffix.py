"""Suffix sorting by induction, in vector steps; external.py has the same with queues on disk.

A suffix is S-type if it is smaller than the suffix one place on, else L-type; an S-type place after
an L-type one is a *leftmost S* place.  The substring from a place to its next leftmost-S place,
with types, and the order of the leftmost-S suffixes decide the order of every suffix.  So: name
the leftmost-S substrings, sort the (at most half as long) string of names by recursion, and induce
the order of all suffixes from it.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .external import QUEUE, File, Induced

_BASE = 64


def _dense(x: np.ndarray) -> tuple[np.ndarray, int]:
    values, inverse = np.unique(x, return_inverse=True)
    return inverse.astype(np.int64), len(values)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer string whose last symbol is 0 and appears nowhere else."""
    n = len(text)
    text = text.astype(np.int64)
    if n <= _BASE:
        whole = text.tolist()
        return np.array(sorted(range(n), key=lambda i: whole[i:]), np.int64)
    step = np.sign(np.diff(text))
    place = np.where(step != 0, np.arange(n - 1), n - 2)
    decides = np.minimum.accumulate(place[::-1])[::-1]
    small = np.append(step[decides] > 0, True)
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost-S places; the last is the final 0
    after = np.searchsorted(first, np.arange(n), side="right")
    typed = 2 * text + small
    bits = int(typed.max()).bit_length()
    width = max(1, 63 // bits)
    stop = np.append(first, n)[after]  # next leftmost-S place
    stop[n - 1] = n - 1
    reach = stop - np.arange(n)
    padded = np.concatenate([typed, np.zeros(width + 1, np.int64)])
    key = np.zeros(n + len(first), np.int64)
    for j in range(width):
        key <<= bits
        key[:n] |= np.where(j <= reach, padded[j : j + n], 0)
        if j == 0:
            key[n:] |= typed[first]  # a leftmost-S symbol by itself
    done = width
    while (reach >= done).any():
        key, m = _dense(key)
        far = np.flatnonzero(reach >= done)
        rest = far + done
        second = np.zeros(len(key), np.int64)
        alone = reach[far] == done
        second[far[~alone]] = key[rest[~alone]] + 1
        second[far[alone]] = key[n + np.searchsorted(first, rest[alone])] + 1
        key = key * (m + 1) + second
        done *= 2
    names, distinct = _dense(key[first])
    if distinct == len(first):
        order = names
    else:
        order = np.empty(len(first), np.int64)
        order[suffix_array(names)] = np.arange(len(first))
    induced = np.append(order, -1)[after]
    return np.lexsort((induced, key[:n]))


def equal_to_next(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether the common prefix of neighbours in ``at`` has ``size`` bytes; at: places with as many bytes left."""
    if len(at) < 2:
        return np.zeros(0, bool)
    words = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
    left = np.arange(len(at) - 1)
    for k in [*range(0, size - 7, 8), size - 8]:
        here, there = words[at[left] + k].view(np.uint64), words[at[left + 1] + k].view(np.uint64)
        left = left[(here == there).ravel()]
    same = np.zeros(len(at) - 1, bool)
    same[left] = True
    return same


def first_windows(data: np.ndarray, at: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """For windows of ``size`` bytes at the places ``at``: does an equal one have a lower ``order``?

    Suffix-sorts the text; windows with equal bytes are neighbours there.
    """
    sa = suffix_array(np.append(data.astype(np.int64) + 1, 0))
    slot = np.full(len(data) + 1, -1, np.int64)
    slot[at] = np.arange(len(at))
    rows = slot[sa]
    rows = rows[rows >= 0]
    group = np.concatenate([[0], np.cumsum(~equal_to_next(data, at[rows], size))]) if len(rows) else rows
    ranked = np.lexsort((order[rows], group))
    rows, group = rows[ranked], group[ranked]
    later = np.zeros(len(at), bool)
    later[rows[1:]] = group[1:] == group[:-1]
    return later


def first_windows_external(runs, size: int, queue: int = QUEUE):
    """The same over text that comes in runs, each small enough for memory, by external induced sorting.

    The text and the windows' identities are written to files; suffixes come back in order with common-prefix
    values, and windows between which no value is below ``size`` are equal. runs: (data, at, keys, places).
    Yields (key, place) of every window that has an equal one before it in the order (key, place).
    """
    with tempfile.TemporaryDirectory() as folder:
        text, owners = File(folder), File(folder)
        for data, at, keys, places in runs:
            begins = dict(zip(at.tolist(), zip(keys.tolist(), places.tolist(), strict=True), strict=True))
            for i, symbol in enumerate(data.tolist()):
                text.add(symbol + 1)
                owners.add(*begins.get(i, (0, -1)))
        text.add(0)
        owners.add(0, -1)
        known = owners.read()
        best, common = None, 0
        for i, value in Induced(text.read(), folder, size, queue).in_order():
            common = min(common, value)
            key, place = known[2 * i], known[2 * i + 1]
            if place < 0:
                continue
            if best is not None and common >= size:
                yield max(best, (key, place))
                best = min(best, (key, place))
            else:
                best = (key, place)
            common = size
