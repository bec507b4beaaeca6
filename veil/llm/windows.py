"""Super-windows: how repeated fixed-length windows are brought together without all-pairs work.

Every window of ``size`` symbols (bytes or words) of a document has a minimizer: the least hash of
the ``gram`` symbols starting at any of its first ``size - gram + 1`` places.  Equal windows have
equal minimizers, so neighbouring windows with one minimizer travel together as a *super-window*
and equal windows always meet in the shard of that minimizer.  All functions here are pure numpy
helpers that work on one bounded piece of text; partitioning is left to Spark.
"""

from __future__ import annotations

import numpy as np

#: Windows in one super-window at most; its first and last windows then cover all its symbols.
MAX_RUN = 64
_RUN_BITS = 7

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _rolling(symbols: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all runs of each wanted length, by doubling: h2k[i] = hk[i] * B^k + hk[i + k]."""
    base, out, by_power = _U(0xB5297A4D3F84D5B5), {}, {1: symbols}
    power, k, top = {1: base}, 1, max(lengths)
    while 2 * k <= top:
        h = by_power[k]
        by_power[2 * k] = h[:-k] * power[k] + h[k:] if len(h) > k else h[:0]
        power[2 * k] = power[k] * power[k]
        k *= 2
    for n in lengths:
        h, have = None, 0
        for bit in sorted(by_power, reverse=True):
            if n & bit:
                part = by_power[bit]
                m = len(symbols) - n + 1
                if m <= 0:
                    h = symbols[:0]
                    break
                h = part[:m] if h is None else h * power[bit] + part[have : have + m]
                have += bit
        out[n] = h
    return out


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    k = 1
    while 2 * k <= n:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def super_windows(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, gram: int, contents: np.ndarray | None = None):
    """Cut the windows of some documents, laid end to end, into super-windows.

    symbols: uint64 hash of each symbol, of which minimizers are made; starts, ends: each document's range in it;
    contents: an independent hash of each symbol for the content hash, else the same.
    Returns arrays (document index, start within the document, number of windows, minimizer, content hash);
    documents shorter than ``size`` give none.
    """
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none, none
    with np.errstate(over="ignore"):
        h = _rolling(symbols, {gram, size} if contents is None else {gram})
        grams = mix(h[gram])
        least = _sliding_min(grams, size - gram + 1)
        m = n - size + 1
        whole = h[size] if contents is None else _rolling(contents, {size})[size]
        doc = np.repeat(np.arange(len(starts)), ends - starts)[:m]
        valid = np.arange(m) + size <= ends[doc]
        new = np.empty(m, bool)
        new[0] = True
        # a run ends where its least gram is left behind, so that no two windows of a run are equal
        new[1:] = (least[1:] != least[:-1]) | (grams[: m - 1] == least[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
        at = np.flatnonzero(new & valid)
        if not len(at):
            return none, none, none, none, none
        stop = np.minimum(np.append(at[1:], m), ends[doc[at]] - size + 1)
        pieces = -((at - stop) // MAX_RUN)
        if (pieces > 1).any():
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, stop = np.repeat(at, pieces) + step * MAX_RUN, np.repeat(stop, pieces)
        runs = np.minimum(stop - at, MAX_RUN)
        content = mix(mix(whole[at]) + mix(whole[at + runs - 1] ^ _U(0x5851F42D4C957F2D)) * _U(3) + runs.astype(_U))
    which = doc[at]
    return which, at - starts[which], runs, least[at].view(np.int64), content.view(np.int64)


def pack(start: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << _RUN_BITS) | runs.astype(np.int64)


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pos >> _RUN_BITS, pos & ((1 << _RUN_BITS) - 1)


def byte_symbols(raw: np.ndarray, family: int = 0) -> np.ndarray:
    """A fixed random 64-bit value for each byte, another in each family."""
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=_U) + _U(1 + 256 * family)) * _U(0xA0761D6478BD642F))[raw]
