"""Covering SimHash against all pairs of fingerprints by brute force."""
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from slatemill.llm.components import components
from slatemill.llm.covering_simhash import covering_masks, fingerprint, keep_first, near_links, simhash_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, radius):
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= radius:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {v: top(v) for v in values}


def test_fingerprint_and_hash_seed(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n", "One", "two Words", "ÉCOLE Ü one\x0btwo three  FOUR five", "x " * 9, " ".join(str(rnd.randrange(50)) for _ in range(70_000))]
    assert [int(fingerprint(None if t is None else t.encode())) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert spark.sql("SELECT xxhash64('a b c d') h").first().h == np.uint64(xxhash.xxh64_intdigest("a b c d", 42)).astype(np.int64)


def test_masks_cover_every_pair_within_the_radius():
    masks = covering_masks(list(range(64)), 4)
    assert len(masks) == 31
    rnd = random.Random(2)
    for _ in range(3000):
        diff = sum(1 << p for p in rnd.sample(range(64), rnd.randrange(1, 5)))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("split", [5, 256])
def test_links_of_clusters_and_chains(spark, split):
    rnd = random.Random(3)
    values = set()
    for _ in range(8):
        base = rnd.getrandbits(64)
        values.add(base)
        for _ in range(8):
            base ^= sum(1 << p for p in rnd.sample(range(64), rnd.randrange(1, 7)))     # chains with some steps too far
            values.add(base)
    values |= {0, (1 << 64) - 1, 15}
    want = slow_components(sorted(values), 4)
    fps = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(near_links(fps, 4, split)).collect()}
    classes = lambda m: {frozenset(k for k in values if m.get(k, k) == r) for r in {m.get(k, k) for k in values}}
    assert classes(got) == classes(want)


def test_rows_nulls_repeats_and_stage(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, 1), (9, text.upper(), 2), (7, text + " tail", 3), (3, None, 4), (4, "  ", 5), (8, "alone here", 6), (8, "alone here", 7), (None, text, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = {}
    for r in simhash_components(docs).collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    want = {v: format(slow_fingerprint(t), "016x") for v, t, _ in rows}
    assert all(f == want[d] for d, v in got.items() if d is not None for f, _ in v)
    near = (slow_fingerprint(text) ^ slow_fingerprint(text + " tail")).bit_count() <= 4
    assert got[9][0][1] == 5 and got[None][0][1] == 5 and got[7][0][1] == (5 if near else 7)
    assert got[3][0][1] == 3 and got[4][0][1] == 3 and len(got[8]) == 2
    kept = [r.doc_id for r in keep_first(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({5, 3, 8} | (set() if near else {7})) and kept.count(None) == 1
    assert simhash_components(docs.limit(0)).collect() == []


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 500)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = dict((r.node, r.root) for r in components(edges).collect())
    assert all(got[i] == 0 for i in range(501)) and got[1001] == 1000


def test_different_texts_under_one_doc_id_each_count(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(5, a), (5, b), (2, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in keep_first(docs).collect()) == [(2, b), (5, a)]
    assert sorted(tuple(r) for r in keep_first(docs.where("doc_id = 5")).collect()) == [(5, a), (5, b)]
