"""External induced sorting: suffixes in order with common-prefix values, by disk-backed priority queues.

The text, all lists and the queues are files; what is in memory is bounded by ``QUEUE`` tuples.  A suffix is S-type if it
is smaller than the one a place on, else L-type; an S-type place after an L-type one is a *seed*.

1. Seeds in the order of their first symbol are induced: L-types from the left, S-types from the right.  That sorts
   the seeds' substrings, which are named in order.
2. If names repeat, the string of names is sorted by recursion; seeds then are in order.
3. The same two scans, now from sorted seeds, put every suffix in order.

A scan takes the least tuple (symbol, sequence number, place, common prefix) of a queue or the next one of a sorted list,
and pushes the suffix before it, if that has the scan's type.  The common prefix of a pushed suffix with the
one pushed before it to the same symbol is one more than the least common prefix scanned in between, so the values
are carried in the tuples and through the recursion.  Values stop at ``most``, which bounds everything kept about them.
"""

from __future__ import annotations

import heapq
import mmap
import os
import struct
from bisect import bisect_left
from collections.abc import Iterator

#: Tuples of a queue in memory; more are written to disk as a sorted run.
QUEUE = 1 << 17
#: Runs of a queue; more are merged into one.
RUNS = 64


class File:
    """A list of long integers on disk: appended to, then read at any place."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder, f"{len(os.listdir(folder))}-{os.urandom(4).hex()}")
        self.out, self.n, self.buffer = open(self.path, "wb"), 0, []  # noqa: SIM115

    def add(self, *values: int) -> None:
        self.buffer += values
        self.n += len(values)
        if len(self.buffer) > 1 << 15:
            self._write()

    def _write(self) -> None:
        self.out.write(struct.pack(f"<{len(self.buffer)}q", *self.buffer))
        self.buffer = []

    def read(self) -> memoryview:
        self._write()
        self.out.close()
        if not self.n:
            return memoryview(b"").cast("q")
        with open(self.path, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("q")


class DiskQueue:
    """A priority queue of tuples of four integers; the least comes first."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.heap, self.heads, self.runs = folder, most, [], [], 0

    def push(self, item: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self._spill(iter(sorted(self.heap)))
            self.heap = []

    def _spill(self, items: Iterator[tuple]) -> None:
        if len(self.heads) >= RUNS:  # all runs become one
            heads, self.heads = self.heads, []
            items = heapq.merge(items, *(self._from(head, rest) for head, _, rest in heads))
        run = File(self.folder)
        for item in items:
            run.add(*item)
        values = run.read()
        rest = zip(*[iter(values)] * 4, strict=True)
        self.runs += 1
        heapq.heappush(self.heads, (next(rest), self.runs, rest))

    @staticmethod
    def _from(head: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
        yield head
        yield from rest

    def first(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not self.heads or (self.heap and self.heap[0] < self.heads[0][0]):
            return heapq.heappop(self.heap)
        item, run, rest = self.heads[0]
        following = next(rest, None)
        if following is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (following, run, rest))
        return item


class Least:
    """The least of the values since any earlier one: a stack of rising values, of which there are at most ``most`` + 1."""

    def __init__(self):
        self.values, self.places, self.n = [], [], 0

    def add(self, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.places.pop()
        self.values.append(value)
        self.places.append(self.n)
        self.n += 1

    def since(self, place: int) -> int:
        """Of the values at ``place`` and after."""
        return self.values[bisect_left(self.places, place)]


def _common(text, a: int, b: int, most: int, known: int = 0) -> int:
    """The common prefix of two suffixes, up to ``most``, of which ``known`` symbols are the same."""
    n, k = len(text), known
    while k < most and a + k < n and b + k < n and text[a + k] == text[b + k]:
        k += 1
    return min(k, most)


class Induced:
    """Of a text (indexable integers) whose last symbol is 0 and appears nowhere else."""

    def __init__(self, text, folder: str, most: int, queue: int = QUEUE):
        self.text, self.folder, self.most, self.queue = text, folder, most, queue

    def scan(self, lists: Iterator[tuple[int, int]], small: bool) -> File:
        """One scan: (place, common prefix with the one before) of all L-types (small: S-types, from the greatest).

        lists: the sorted suffixes that the scan starts from, as (place, common prefix with the one before them in the list).
        """
        text, most = self.text, self.most
        sign = -1 if small else 1
        queue, out, least, pushed = DiskQueue(self.folder, self.queue), File(self.folder), Least(), {}
        number, last, last_queued = 0, None, None
        given = next(lists, None)
        while True:
            head = queue.first()
            if head is None and given is None:
                return out
            # of equal symbols the types that the scan makes come first
            queued = head is not None and (given is None or head[0] <= sign * text[given[0]])
            if queued:
                _, _, place, common = queue.pop()
                out.add(place, common)
            else:
                place, common = given
                given = next(lists, None)
            # the common prefix with the suffix scanned before, wherever it came from
            if last is None or text[last] != text[place]:
                between = 0
            elif queued == last_queued:
                between = common
            else:
                between = _common(text, last, place, most)
            least.add(between)
            last, last_queued = place, queued
            if place:
                before, here = text[place - 1], text[place]
                # L-types follow only L-types or seeds, S-types only what is greater or S-type itself
                if (before > here or (before == here and queued)) if not small else (before < here or (before == here and queued)):
                    key = sign * before
                    at = pushed.get(before)
                    shared = 0 if at is None else min(most, 1 + least.since(at))
                    queue.push((key, number, place - 1, shared))
                    number += 1
                    pushed[before] = least.n

    def seeds(self) -> memoryview:
        """Places of the seeds, from the left; the last is the final 0."""
        text, found, small = self.text, File(self.folder), True
        found.add(len(text) - 1)
        for i in range(len(text) - 2, -1, -1):
            before = small
            small = text[i] < text[i + 1] or (text[i] == text[i + 1] and small)
            if before and not small and i + 1 < len(text) - 1:
                found.add(i + 1)
        return found.read()[::-1]

    def _both(self, seeds: Iterator[tuple[int, int]]) -> tuple[memoryview, memoryview]:
        """L-types from the least, S-types from the greatest, as flat lists of (place, common prefix)."""
        large = self.scan(seeds, False).read()
        # from the greatest, the common prefix with the one scanned before is that of the next greater one
        places = range(len(large) - 2, -1, -2)
        down = ((large[i], large[i + 3] if i + 3 < len(large) and self.text[large[i + 2]] == self.text[large[i]] else 0) for i in places)
        return large, self.scan(down, True).read()

    def in_order(self) -> Iterator[tuple[int, int]]:
        """(place, common prefix with the suffix before it) of every suffix."""
        text, most = self.text, self.most
        if len(text) == 1:
            yield 0, 0
            return
        seeds = self.seeds()
        large, small = self._both(self._sorted(seeds))
        n = len(text)
        last = None
        yield n - 1, 0
        i, j = 0, len(small) - 2
        while i < len(large) or j >= 0:
            take_large = i < len(large) and (j < 0 or text[large[i]] <= text[small[j]])
            if take_large:
                place, common = large[i], large[i + 1]
                common = common if last is not None and last[1] else None
                i += 2
            else:
                place = small[j]
                # the value of the next greater one belongs to the pair
                common = small[j + 3] if last is not None and not last[1] and j + 3 < len(small) else None
                j -= 2
            if last is None or text[last[0]] != text[place]:
                common = 0
            elif common is None:
                common = _common(text, last[0], place, most)
            yield place, common
            last = (place, take_large)

    def _sorted(self, seeds: memoryview) -> Iterator[tuple[int, int]]:
        """The seeds in the order of their suffixes, with the common prefix with the one before."""
        text, most, folder = self.text, self.most, self.folder
        m = len(seeds)
        # step 1: by substrings; the seeds' first order is that of their symbols
        rough = DiskQueue(folder, self.queue)
        for k in range(m):
            rough.push((text[seeds[k]], k, seeds[k], 0))

        def by_symbol():
            while rough.first() is not None:
                yield rough.pop()[2], 0

        _, small = self._both(by_symbol())
        names, name, last = DiskQueue(folder, self.queue), 0, None
        names.push((m - 1, 0, 0, 0))
        for j in range(len(small) - 2, -1, -2):
            k = bisect_left(seeds, small[j])
            if k >= m or seeds[k] != small[j]:
                continue
            if last is None or not self._same(seeds, last, k):
                name += 1
            names.push((k, name, 0, 0))
            last = k
        string = File(folder)
        while names.first() is not None:
            string.add(names.pop()[1])
        string = string.read()
        if name + 1 == m:
            ranked = DiskQueue(folder, self.queue)
            for k in range(m):
                ranked.push((string[k], k, 0, 0))

            def order():
                while ranked.first() is not None:
                    yield ranked.pop()[1], 0
        else:
            order = Induced(string, folder, most, self.queue).in_order
        before = None
        for k, common in order():
            # common: seeds' substrings that are the same; the rest is compared symbol by symbol
            known = min(most, seeds[k + common] - seeds[k]) if before is not None and common else 0
            yield seeds[k], 0 if before is None else _common(text, seeds[before], seeds[k], most, known)
            before = k

    def _same(self, seeds: memoryview, a: int, b: int) -> bool:
        """Are two seeds' substrings, up to and with the next seed, the same?"""
        text = self.text
        if a == len(seeds) - 1 or b == len(seeds) - 1:
            return a == b
        n = seeds[a + 1] - seeds[a]
        return n == seeds[b + 1] - seeds[b] and all(text[seeds[a] + i] == text[seeds[b] + i] for i in range(n + 1))
