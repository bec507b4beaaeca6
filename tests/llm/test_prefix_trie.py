"""The conversation trie against a plain version, its parentheses, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from veil.llm import prefix_trie as P


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            node = tuple(turns[:d])
            members[node].append(c)
            if d:
                children[node[:-1]].add(node)
        ends[tuple(turns)].append(c)
    out = []
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        below = [totals[x] for x in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below), 1 + max((b[2] for b in below), default=-1))
    for node, who in members.items():
        leaves, saved, height = totals[node]
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves, saved, digest, height))
    return sorted(out, key=repr)


def conversations(seed, n=150):
    rng = random.Random(seed)
    turns = [("user", "hi"), ("user", "hé 😀"), ("assistant", "ok"), ("assistant", ""), ("system", "x" * 300)]
    rows = []
    for _ in range(n):
        c = rng.randrange(0, 1200)
        rows += [(c, i, *rng.choice(turns)) for i in range(rng.randint(1, 9))]
    rows += [(c, i, "user", f"shared {i}") for c in range(2000, 2090) for i in range(3)]  # copies
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn int, role string, text string, depth int, node binary").repartition(3)


def found(shards):
    return sorted((tuple(r) for r in P.trie_nodes(shards).select(*P.RESULT).collect()), key=repr)


@pytest.mark.parametrize("most", [1, 7, 60, 1 << 16])
def test_same_as_plain(spark, monkeypatch, most):
    monkeypatch.setattr(P, "SHARD_NODES", most)
    rows = list(dict.fromkeys(conversations(most)))
    assert found(P.encode_trie(P.rebuilt(P.in_order(frame(spark, rows))))) == plain(plain_rebuilt(rows))


def test_not_rebuilt(spark):
    rows = [(c, t, r, x) for c, t, r, x in conversations(3) if c != 2005]
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t, r, x))
    convs = {c: [x[1:] for x in sorted(turns)] for c, turns in own.items()}
    assert found(P.encode_trie(P.as_they_are(P.in_order(frame(spark, rows))))) == plain(convs)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 3)
    rows = [(None, 0, "user", "no id"), (5, None, None, None), (5, 1, "a", "b"), (5, 1, "a", "b"), (5, 1, None, "z"), (-7, 0, "user", "minus"), (-250, 3, "user", "x"), (-200, 0, "user", "y")]
    rows += [(c, 0, "u", "one turn") for c in range(301, 340)]  # many are without turns after h of them, and end at the root
    rows += [(7001, i, "user", "ok") for i in range(3000)]
    assert found(P.encode_trie(P.rebuilt(P.in_order(frame(spark, rows))))) == plain(plain_rebuilt(rows))


def test_empty_table(spark):
    assert found(P.encode_trie(P.rebuilt(P.in_order(frame(spark, [(1, 1, "a", "b")]).limit(0))))) == []


def test_parentheses():
    rng = random.Random(2)
    for trial in range(60):
        n = rng.choice([1, 2, 40, 300, 1500])
        bits, open_, left = [1], [0], n - 1
        closes = {}
        while open_:
            if left and (len(open_) == 1 or rng.random() < (0.9 if trial % 2 else 0.5)):
                open_.append(len(bits))
                bits.append(1)
                left -= 1
            else:
                closes[open_.pop()] = len(bits)
                bits.append(0)
        parens = P.Parens(np.array(bits, bool))
        opens = np.array(sorted(closes))
        close = parens.find_close(opens)
        assert close.tolist() == [closes[o] for o in opens.tolist()]
        assert parens.highest(opens, close).tolist() == [int(parens.excess[a : b + 1].max()) for a, b in zip(opens, close)]
        values = np.array([rng.randint(0, 99) for _ in bits])
        assert P.range_least(values, opens, close).tolist() == [int(values[a:b].min()) for a, b in zip(opens, close)]
