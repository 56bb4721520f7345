"""The trie against a dictionary of prefixes: copies, odd rows, nodes over many blocks."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from slatemill.llm import conversation_trie
from slatemill.llm.conversation_trie import RangeMin, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int, block int"


def slow_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest() + format(len(re.findall(r"[^\x20\x09-\x0D]+", text)), "08X")
            own[c].append(((turn is not None, turn or 0, mark), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        kids[p[:-1]] += bool(p)
    for p, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * words
    return sorted((nodes[p][0], len(p), nodes[p[:-1]][0] if p else None, len(nodes[p]), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in nodes)


def both(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in prefix_trie(df).collect()]
    return sorted(got, key=lambda r: (r[0], r[1])), sorted(slow_trie(rows), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("block, chunk", [(32_768, 8192), (5, 2)])
def test_against_prefix_dictionary(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    rnd = random.Random(5)
    texts = ["hello there", "hello", "", "a b  c", "été 中文", "no\nyes"]
    rows = []
    for c in [*range(-45, 80), *range(200, 240)]:
        # a third of all conversations are copies of one
        path = ["same", "same again", "end"] if c % 3 == 0 else [rnd.choice(texts) for _ in range(rnd.choice([1, 1, 2, 3, 5, 9]))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(path)]
    got, want = both(spark, rows)
    assert got == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 1, "user", "b c"), (0, 1, "user", "b c"), (0, 1, "bot", "tie"), (1, 5, "user", "x" * 100_000 + " y"),
            (2, 0, "", "joined"), (3, 0, "joined", ""), (7, 0, "user", "only turn"), (41, 0, "u", "t"), (42, 0, "u", "t"), (43, 0, "u", "t"), (44, 0, "u", "t"), (45, 0, "u", "t")]
    got, want = both(spark, rows)
    assert got == want and got[0][1] == 0 and got[0][2] is None
    assert any(zlib.crc32(str(c).encode()) % 4 for c in range(41, 46))      # some lose their only turn
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(empty).collect() == []
    lone, want = both(spark, [(9, 0, "user", "w")])
    assert lone == want


def test_long_conversation(spark):
    rows = [(20 * c, t, "user", f"t{t // 2}") for c in range(3) for t in range(1500 + c)]
    got, want = both(spark, rows)
    assert got == want


def test_range_minimum():
    import numpy as np
    rnd = np.random.default_rng(3)
    v = rnd.integers(0, 5, 77)
    t, i = RangeMin(v), np.repeat(np.arange(77), 6)
    d = np.tile(np.arange(6), 77)
    last, first = t.last(i, d), t.first(i, d)
    for k, depth, r, left in zip(i, d, last, first):
        assert r == next((j - 1 for j in range(k + 1, 77) if v[j] < depth), 76)
        assert left == next((j for j in range(k, 0, -1) if v[j] < depth), 0)
    a, b = np.minimum(i, i[::-1]), np.maximum(i, i[::-1])
    assert t.between(a, b).tolist() == [v[x:y + 1].min() for x, y in zip(a, b)]
