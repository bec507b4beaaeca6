"""Where windows of documents occur again: the Spark plan that operators 2 and 3 share.

1. Each document is cut into super-windows (windows.py); one shuffle by minimizer brings every
   possible repeat together.  A super-window whose content equals an earlier one needs no index: all
   its windows are repeats.
2. Of the rest only the first occurrence of each content can matter, and only if another content
   has its minimizer.  Their text is fetched by a join on the document's key.
3. They are dealt out by minimizer.  Each task turns its groups into shards of bounded size and
   hands them to the operator's own index, which says which windows are repeats.
4. A minimizer with more text than MOST, as a passage in many surroundings has it, is not indexed:
   its windows are dealt one by one by the hash of the whole window, which spreads the surroundings,
   and equal ones (two 64-bit hashes) are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import cut, flat, parts, slabs

#: Bytes of text that are laid end to end for one round of vector work.
SLAB = 1 << 19
#: Bytes of text in one index shard; a group of one minimizer above it takes the external way.
SHARD = 1 << 19
#: Symbols to index of one minimizer; above it its windows are dealt singly.
MOST = {"word": 1 << 17, "byte": 3 << 18}

#: Rows of a side that is sent to every task.
SEND = 100_000

_ANCHOR = "m long, h long, key long, pos long"
_FOUND = "m long, key long, pos long, kind int"
_SLICE = "m long, key long, start long, runs int, content binary"
_FLAG = "key long, start long, runs long"

REPEAT, INDEX, HEAVY = 0, 1, 2
#: Bytes of a word that is hashed as a polynomial, and the families' bases.
LONG = 64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Stands for the content of a super-window that is known to repeat.
SETTLED = np.iinfo(np.int64).min


def word_bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Start and end byte of each word, and each document's range of words."""
    space = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~space
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    live = starts[starts < ends]
    begins[live] |= inside[live]
    stops = inside[:-1] & ~inside[1:]
    stops[live[1:] - 1] |= inside[live[1:] - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return a, b, np.searchsorted(a, starts), np.searchsorted(a, ends)


def word_symbols(data: np.ndarray, a: np.ndarray, b: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands; families 0 and 1 are independent.

    Words of up to LONG bytes are polynomials modulo 2^64, which tell all words of that length apart but by chance; in longer words
    they fail on self-similar ones, so these are digests.
    """
    u = np.uint64
    with np.errstate(over="ignore"):
        base = u(_BASES[family])
        inverse = u(pow(int(base), -1, 1 << 64))
        n = len(data) + 1
        up, down = np.full(n, base), np.full(n, inverse)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=u), np.cumprod(down, dtype=u)
        total = np.concatenate([np.zeros(1, u), np.cumsum(W.byte_symbols(data, family) * up[:-1], dtype=u)])
        out = W.mix((total[b] - total[a]) * down[a] + (b - a).astype(u))
    long = np.flatnonzero(b - a > LONG)
    if len(long):
        raw = data.tobytes()
        digests = [hashlib.blake2b(raw[x:y], digest_size=8, person=bytes([family])).digest() for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(digests), "<u8")
    return out


def _anchors(unit: str, size: int, gram: int, first_too: bool):
    """Super-windows of each batch of documents, those that repeat one of their batch set apart.

    Of equal super-windows in a batch only the first goes to the shuffle by minimizer; the others are
    known repeats (content SETTLED), dealt by their document, so that no frequent content piles up.
    A batch may hold parts of documents, with their ``first`` place.  Where gram is size, every
    window is its own super-window.  Words' minimizers and contents are of independent families of hashes; so are those of bytes
    where every window is its own super-window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            data, starts, ends = flat(batch.column("text"))
            begin = batch.column("first").to_numpy(zero_copy_only=False) if "first" in batch.schema.names else np.zeros(len(keys), np.int64)
            found = []
            for which, symbols, others, s, e, shift in _pieces(unit, data, starts, ends, size):
                if others is None and gram == size:
                    others = W.mix(symbols ^ np.uint64(0xD1342543DE82EF95))
                doc, start, runs, m, h = W.super_windows(symbols, s, e, size, gram, others)
                found.append((m, h, keys[which[doc]], W.pack(begin[which[doc]] + start + shift[doc], runs)))
            if not found:
                continue
            m, h, key, pos = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((pos, key, h, m))
            m, h, key, pos = m[order], h[order], key[order], pos[order]
            again = np.append(False, (m[1:] == m[:-1]) & (h[1:] == h[:-1]))[: len(m)]
            settled = again.copy()
            if first_too:
                settled[:-1] |= again[1:]
            known, at = key[settled], pos[settled]
            if gram == size:
                known, at = _joined(known, at >> 7)
            columns = [
                np.concatenate([m[~again], W.mix(known.view(np.uint64)).view(np.int64)]),
                np.concatenate([h[~again], np.full(len(known), SETTLED)]),
                np.concatenate([key[~again], known]),
                np.concatenate([pos[~again], at]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["m", "h", "key", "pos"])

    return run


def _joined(key: np.ndarray, place: np.ndarray):
    """Single windows as packed runs of neighbours."""
    key, start, runs = spans(key, place)
    pieces = -(-runs // W.MAX_RUN)
    step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * W.MAX_RUN
    left = np.repeat(runs, pieces) - step
    return np.repeat(key, pieces), W.pack(np.repeat(start, pieces) + step, np.minimum(left, W.MAX_RUN))


def _pieces(unit: str, data, starts, ends, size):
    """(document of each piece, symbols, those of another family for words, starts, ends, symbols of the document before the piece)."""
    if unit == "byte":
        for slab in slabs(starts, ends, SLAB, size - 1):
            which, a, b = (np.array(x) for x in zip(*slab, strict=True))
            length = b - a
            e = np.cumsum(length)
            symbols = W.byte_symbols(np.concatenate([data[x:y] for x, y in zip(a, b, strict=True)]))
            yield which, symbols, None, e - length, e, a - starts[which]
        return
    for group in _whole(starts, ends):
        lo, hi = starts[group[0]], ends[group[-1]]
        a, b, first, last = word_bounds(data[lo:hi], starts[group] - lo, ends[group] - lo)
        families = [word_symbols(data[lo:hi], a, b, family) for family in (0, 1)]
        for slab in slabs(first, last, SLAB, size - 1):
            which, x, y = (np.array(v) for v in zip(*slab, strict=True))
            length = y - x
            e = np.cumsum(length)
            symbols, others = (np.concatenate([f[p:q] for p, q in zip(x, y, strict=True)]) for f in families)
            yield group[which], symbols, others, e - length, e, x - first[which]


def _whole(starts, ends):
    """Runs of documents of about SLAB bytes; a longer document makes a run by itself."""
    group, size = [], 0
    for i, n in enumerate((ends - starts).tolist()):
        group.append(i)
        size += n
        if size >= SLAB:
            yield np.array(group)
            group, size = [], 0
    if group:
        yield np.array(group)


def _groups(first_too: bool):
    """Over rows sorted by (m, h, key, pos): which super-windows repeat, which must be indexed.

    A group may span any number of batches; all that is kept between them is the last first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_m = last_h = None
        held = None  # (m, key, pos, may repeat, may need the index)

        def out(m, key, pos, kind):
            arrays = [pa.array(np.asarray(x, np.int64)) for x in (m, key, pos)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(arrays[0]), kind, np.int32))], ["m", "key", "pos", "kind"])

        for batch in batches:
            m, h, key, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "h", "key", "pos"))
            known = h == SETTLED
            if known.any():
                yield out(m[known], key[known], pos[known], REPEAT)
                m, h, key, pos = m[~known], h[~known], key[~known], pos[~known]
            if not len(m):
                continue
            new_m = np.append(last_m is None or m[0] != last_m, m[1:] != m[:-1])
            new_h = new_m | np.append(last_m is None or h[0] != last_h, h[1:] != h[:-1])
            last_m, last_h = m[-1], h[-1]
            first = np.flatnonzero(new_h)
            if held is not None:
                hm, hk, hp, dup, need = held
                if dup and not new_h[0]:
                    yield out([hm], [hk], [hp], REPEAT)
                if need and len(first) and not new_m[first[0]]:
                    yield out([hm], [hk], [hp], INDEX)
                held = (hm, hk, hp, False, need) if not len(first) else None
            again = np.flatnonzero(~new_h)
            if first_too and len(again):
                before = first[np.isin(first + 1, again)]
                again = np.concatenate([again, before])
            if len(again):
                yield out(m[again], key[again], pos[again], REPEAT)
            if len(first):
                more = ~new_m[first]
                more[:-1] |= ~new_m[first[1:]]
                some = first[more]
                if len(some):
                    yield out(m[some], key[some], pos[some], INDEX)
                f = first[-1]
                held = (m[f], key[f], pos[f], first_too and f == len(m) - 1, not more[-1])

    return run


def _weighed(first_too: bool, size: int, most: int):
    """_groups, with a row of kind HEAVY after each minimizer that has more than ``most`` symbols to index."""
    groups = _groups(first_too)

    def heavy(m):
        m = np.asarray(m, np.int64)
        none = np.zeros(len(m), np.int64)
        return pa.RecordBatch.from_arrays([*map(pa.array, (m, none, none)), pa.array(np.full(len(m), HEAVY, np.int32))], ["m", "key", "pos", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in groups(batches):
            yield batch
            if batch.column("kind")[0].as_py() != INDEX:
                continue
            m, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "pos"))
            at = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            values, sums = m[at], np.add.reduceat(W.unpack(pos)[1] + size - 1, at)
            if values[0] == last:
                sums[0] += total
            elif total > most:
                yield heavy([last])
            above = values[:-1][sums[:-1] > most]
            if len(above):
                yield heavy(above)
            last, total = values[-1], sums[-1]
        if total > most:
            yield heavy([last])

    return run


def _singles(unit: str, size: int, first_too: bool):
    """Every window of the super-windows that each document has in heavy groups, as an anchor by itself."""
    slices, anchors = _slices(unit, size), _anchors(unit, size, size, first_too)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (pa.RecordBatch.from_arrays([x.column(c) for c in ("key", "start", "content")], ["key", "first", "text"]) for x in slices(batches))
        return anchors(parts)

    return run


def _slices(unit: str, size: int):
    """The text of the super-windows that each document has to have indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = flat(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            listed = batch.column("wanted")
            offsets = np.asarray(listed.offsets)
            m_all, pos_all = (listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("m", "pos"))
            rows: list[tuple] = []
            held = 0
            for i in range(len(keys)):
                m, pos = m_all[offsets[i] : offsets[i + 1]], pos_all[offsets[i] : offsets[i + 1]]
                start, runs = W.unpack(pos)
                text = data[starts[i] : ends[i]]
                raw = text.tobytes()
                if unit == "byte":
                    cuts = zip(start.tolist(), (start + runs + size - 1).tolist(), strict=True)
                    contents = [raw[a:b] for a, b in cuts]
                else:
                    words = raw.split()
                    contents = [b" ".join(words[a : a + r + size - 1]) for a, r in zip(start.tolist(), runs.tolist(), strict=True)]
                rows.append((m, np.full(len(m), keys[i]), start, runs, contents))
                held += sum(map(len, contents))
                if held > 1 << 23:
                    yield _slice_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _slice_batch(rows)

    return run


def _slice_batch(rows):
    m, key, start, runs, contents = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(m)), pa.array(np.concatenate(key)), pa.array(np.concatenate(start)), pa.array(np.concatenate(runs).astype(np.int32)), pa.array([c for x in contents for c in x], pa.binary())],
        ["m", "key", "start", "runs", "content"],
    )


def _shards(index: Callable, large: Callable):
    """Over slices sorted by minimizer: gather whole groups into shards and give each to the index.

    index(key, start, runs, contents) and large(iterator of the same) yield arrays (key, start, runs)
    of repeated windows; large gets a group that is too long for one shard, in runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("m", "key", "start", "runs", "content")), strict=True)

        def send(found):
            key, start, runs = found
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (key, start, runs)], ["key", "start", "runs"])

        stream = rows()
        row = next(stream, None)
        shard: list[tuple] = []
        size = 0
        while row is not None:
            m, group, length = row[0], [], 0
            while row is not None and row[0] == m and length <= SHARD:
                group.append(row[1:])
                length += len(row[4])
                row = next(stream, None)
            if row is not None and row[0] == m:

                def chunks(group=group, m=m):
                    nonlocal row
                    while group:
                        yield tuple(zip(*group, strict=True))
                        group, length = [], 0
                        while row is not None and row[0] == m and length <= SHARD:
                            group.append(row[1:])
                            length += len(row[4])
                            row = next(stream, None)

                for found in large(chunks()):
                    yield from send(found)
                continue
            if size + length > SHARD and shard:
                yield from send(index(*zip(*shard, strict=True)))
                shard, size = [], 0
            shard += group
            size += length
        if shard:
            yield from send(index(*zip(*shard, strict=True)))

    return run


def spans(key: np.ndarray, place: np.ndarray):
    """Neighbouring windows of one document as runs (key, start, number of windows)."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1)) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return key[at], place[at], np.diff(np.append(at, len(key)))


def repeats(docs: DataFrame, unit: str, size: int, gram: int, first_too: bool, index: Callable, large: Callable) -> DataFrame:
    """docs (key, doc_id, text as binary) with a column ``spans``: arrays (start, runs) of repeated windows, or null."""
    n = parts(docs.sparkSession)
    anchors = docs.select("key", "text").mapInArrow(_anchors(unit, size, gram, first_too), _ANCHOR)
    weighed = _weighed(first_too, size, MOST[unit])
    found = cut(anchors.repartition(n, "m").sortWithinPartitions("m", "h", "key", "pos").mapInArrow(weighed, _FOUND))
    to_index = found.where(F.col("kind") == INDEX)
    # at most one for every MOST symbols, which is broadcast up to a size; beyond it these joins shuffle
    heavy = found.where(F.col("kind") == HEAVY).select("m")
    n_heavy = heavy.count()
    some_heavy = n_heavy > 0
    if some_heavy and n_heavy <= SEND:
        heavy = F.broadcast(heavy)
    listed = F.collect_list(F.struct("m", "pos")).alias("wanted")
    light = to_index.join(heavy, "m", "left_anti") if some_heavy else to_index
    # the joins below read the documents by one exchange
    dealt = docs.repartition(n, "key")
    slices = dealt.join(light.groupBy("key").agg(listed), "key").select("key", "text", "wanted").mapInArrow(_slices(unit, size), _SLICE)
    indexed = slices.repartition(n, "m").sortWithinPartitions("m").mapInArrow(_shards(index, large), _FLAG)
    same = found.where(F.col("kind") == REPEAT)
    if some_heavy:
        wanted = to_index.join(heavy, "m", "left_semi").groupBy("key").agg(listed)
        singles = dealt.join(wanted, "key").select("key", "text", "wanted").mapInArrow(_singles(unit, size, first_too), _ANCHOR)
        grouped = singles.repartition(n, "m").sortWithinPartitions("m", "h", "key", "pos").mapInArrow(_groups(first_too), _FOUND)
        same = same.unionByName(grouped.where(F.col("kind") == REPEAT))
    same = same.select("key", F.shiftright("pos", 7).alias("start"), F.col("pos").bitwiseAND(127).alias("runs"))
    flagged = same.unionByName(indexed).groupBy("key").agg(F.collect_list(F.struct("start", "runs")).alias("spans"))
    return dealt.join(flagged, "key", "left")
