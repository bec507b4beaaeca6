"""Plain versions of the training-data operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text):
    return WORD.findall(text or "")


def windows_elsewhere(rows, size=35):
    """Operator 2: {id: (n_words, n_removed, digest)}."""
    count = Counter()
    split = {d: words(t) for d, t in rows}
    for w in split.values():
        count.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), len(w) - len(kept), sha(" ".join(kept).encode()))
    return out


def strings_before(rows, size=100):
    """Operator 3: {id: (n_bytes, n_removed, n_spans, digest)}; rows in order."""
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(kept), kept)
    return out


def jaccard_classes(rows, gram=5, similarity=0.8):
    """Operator 5: {id: (class, copy_of, n_links)}."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    first = {}
    for d in sorted(sets):
        if sets[d]:
            first.setdefault(sets[d], d)
    reps = sorted(first.values())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(int)
    for i, a in enumerate(reps):
        for b in reps[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    out = {}
    for d, s in sets.items():
        copy = first[s] if s else d
        out[d] = (find(copy), copy, links[copy])
    return out


def base_rules(text):
    """Operator 6: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if five[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed
