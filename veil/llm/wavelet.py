"""A wavelet matrix in one compressed file: bit planes with rank and select, beside the documents' ends.

The file's symbols are its distinct ids by falling count, so the upper planes are mostly zeros.  A plane
is cut into blocks of BLOCK bits, each compressed by itself with the number of ones before it; an access touches one block of each plane.
Layout: magic, counts, then sections, each with its length before it: documents, null marks, ends, symbols, and for each plane its number of
zeros, ones before each block, ends of the compressed blocks, and the blocks.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"VWM1"
#: Bits of one compressed block.
BLOCK = 1 << 16
_HEAD = struct.Struct("<4sQIB")
_WIDTH = struct.Struct("<Q")


def encode(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """The file of these ids (uint32), in documents that end before ``ends``."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    symbols = symbols[np.argsort(-counts[symbols], kind="stable")]
    bits = max(1, int(len(symbols) - 1).bit_length())
    number = np.zeros(len(counts), np.uint32)
    number[symbols] = np.arange(len(symbols))
    current = number[ids]
    if bits <= 16:
        current = current.astype(np.uint16)
    press = zstandard.ZstdCompressor(level=1)
    sections = [np.array([d or 0 for d in doc_ids], "<i8"), np.packbits(np.array([d is None for d in doc_ids], bool)), np.asarray(ends, "<u4"), symbols.astype("<u4")]
    parts = [x.tobytes() for x in sections]
    for level in range(bits - 1, -1, -1):
        zeros, ones, counts, pressed = [], [], [0], []
        for a in range(0, len(current), BLOCK):
            some = current[a : a + BLOCK]
            one = (some & some.dtype.type(1 << level)).astype(bool)
            pressed.append(press.compress(np.packbits(one, bitorder="little").tobytes()))
            # places are taken, as a mask costs a guess for each bit
            zeros.append(some.take(np.flatnonzero(~one)))
            ones.append(some.take(np.flatnonzero(one)))
            counts.append(len(ones[-1]))
        before = np.cumsum(counts)
        parts += [_WIDTH.pack(len(ids) - int(before[-1])), before[:-1].astype("<u4").tobytes(), np.cumsum(list(map(len, pressed))).astype("<u4").tobytes(), b"".join(pressed)]
        current = np.concatenate([current[:0], *zeros, *ones])
        if level == 8:
            current = current.astype(np.uint8)  # only lower bits are asked for from here
    body = b"".join(_WIDTH.pack(len(p)) + p for p in parts)
    return _HEAD.pack(MAGIC, len(ids), len(doc_ids), bits) + body


class Plane:
    def __init__(self, n: int, zeros: int, ones: np.ndarray, stops: np.ndarray, data: memoryview):
        self.n, self.zeros, self.ones, self.stops, self.data = n, zeros, ones, stops, data
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint8))

    def block(self, i: int) -> np.ndarray:
        """The packed bits of one block; the last one asked for is kept."""
        if self.kept[0] != i:
            a = int(self.stops[i - 1]) if i else 0
            raw = zstandard.ZstdDecompressor().decompress(self.data[a : int(self.stops[i])], max_output_size=BLOCK // 8)
            self.kept = i, np.frombuffer(raw, np.uint8)
        return self.kept[1]

    def bit(self, at: int) -> int:
        return int(self.block(at // BLOCK)[at % BLOCK // 8]) >> (at % 8) & 1

    def rank(self, at: int) -> int:
        """Ones before a place."""
        if at >= self.n:
            return self.n - self.zeros
        block, within = self.block(at // BLOCK), at % BLOCK
        found = int(self.ones[at // BLOCK]) + int(np.bitwise_count(block[: within // 8]).sum())
        return found + (int(block[within // 8]) & ((1 << within % 8) - 1)).bit_count()

    def select(self, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind."""
        before = self.ones.astype(np.int64) if bit else np.arange(len(self.ones)) * BLOCK - self.ones
        i = int(np.searchsorted(before, k, "right")) - 1
        there = np.unpackbits(self.block(i), bitorder="little")[: self.n - i * BLOCK] == bit
        return i * BLOCK + int(np.flatnonzero(there)[k - int(before[i])])

    def whole(self) -> np.ndarray:
        return np.unpackbits(np.concatenate([self.block(i) for i in range(len(self.stops))]), count=self.n, bitorder="little").astype(bool) if self.n else np.zeros(0, bool)


class TokenFile:
    """One file: access, counting and occurrences without decoding it; ``ids`` decodes all of it."""

    def __init__(self, content: bytes):
        magic, self.n, self.n_docs, self.bits = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        view, at, sections = memoryview(content), _HEAD.size, []
        while at < len(content):
            (length,) = _WIDTH.unpack_from(content, at)
            sections.append(view[at + _WIDTH.size : at + _WIDTH.size + length])
            at += _WIDTH.size + length
        nulls = np.unpackbits(np.frombuffer(sections[1], np.uint8), count=self.n_docs)
        self.doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(sections[0], "<i8").tolist(), nulls.tolist(), strict=True)]
        self.ends, self.symbols = np.frombuffer(sections[2], "<u4").astype(np.int64), np.frombuffer(sections[3], "<u4")
        self.planes = [Plane(self.n, _WIDTH.unpack(sections[i])[0], np.frombuffer(sections[i + 1], "<u4"), np.frombuffer(sections[i + 2], "<u4"), sections[i + 3]) for i in range(4, 4 + 4 * self.bits, 4)]
        self.number = {s: i for i, s in enumerate(self.symbols.tolist())}

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(at), plane.rank(at)
            value = value << 1 | bit
            at = plane.zeros + ones if bit else at - ones
        return int(self.symbols[value])

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        number = self.number[token]
        for level, plane in enumerate(self.planes):
            before, upto = plane.rank(a), plane.rank(b)
            a, b = (plane.zeros + before, plane.zeros + upto) if number >> (self.bits - 1 - level) & 1 else (a - before, b - upto)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often an id stands in a range of places."""
        if token not in self.number:
            return 0
        low, high = self._range(token, a, self.n if b is None else b)
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at, number = self._range(token, 0, 0)[0] + k, self.number[token]
        for level in range(self.bits - 1, -1, -1):
            plane = self.planes[level]
            at = plane.select(1, at - plane.zeros) if number >> (self.bits - 1 - level) & 1 else plane.select(0, at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id: the range of its equals in the last plane, taken up through the planes together."""
        if token not in self.number:
            return np.zeros(0, np.int64)
        low, high = self._range(token, 0, self.n)
        at, number = np.arange(low, high), self.number[token]
        for level in range(self.bits - 1, -1, -1):
            one = bool(number >> (self.bits - 1 - level) & 1)
            places = np.flatnonzero(self.planes[level].whole() == one)
            at = places[at - self.planes[level].zeros if one else at]
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        value = np.zeros(self.n, np.uint8)
        for level, plane in enumerate(reversed(self.planes)):
            above = np.empty(self.n, np.uint8 if level < 8 else kind)
            zero, one = 0, plane.zeros
            for i in range(len(plane.stops)):
                some = above[i * BLOCK : (i + 1) * BLOCK]
                bits = np.unpackbits(plane.block(i), count=len(some), bitorder="little").view(bool)
                zeros, ones = np.flatnonzero(~bits), np.flatnonzero(bits)
                some[zeros] = value[zero : zero + len(zeros)]
                some[ones] = value[one : one + len(ones)] | above.dtype.type(1 << level)
                zero, one = zero + len(zeros), one + len(ones)
            value = above
        return self.symbols[value]
