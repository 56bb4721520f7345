"""Length buckets against every choice of bounds; batches against their budget."""
import itertools
import random

import numpy as np

from slatemill.llm.length_buckets import best_buckets, pack


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


def test_least_padding():
    rnd = random.Random(5)
    for _ in range(40):
        lengths = sorted(rnd.sample(range(60), rnd.randrange(1, 9)))
        counts = [rnd.randrange(1, 30) for _ in lengths]
        for k in (1, 2, 3, 12):
            got = best_buckets(np.array(lengths), np.array(counts), k)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
            assert len(got) <= k and got[-1] == lengths[-1] and padding(lengths, counts, got) == best


def test_parts_and_batches(spark):
    rnd = random.Random(6)
    size = {i: rnd.choice([0, 1, 3, 40, 41, 200, 999]) for i in range(300)}
    rows = [(i, "w " * n if n else rnd.choice([None, "", " "]), i) for i, n in size.items()] + [(None, "a b", 0), (4, "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket long").repartition(3)
    got = [r.asDict() for r in pack(docs, max_length=128, buckets=3, batch_tokens=256).collect()]
    for i, n in size.items():
        mine = sorted((r["part"], r["start"], r["length"]) for r in got if r["doc_id"] == i)
        cut = [(p, p * 128, min(128, n - p * 128)) for p in range(max(1, -(-n // 128)))]
        assert mine == (sorted([*cut, (0, 0, 1)]) if i == 4 else cut)
    assert sum(r["doc_id"] is None for r in got) == 1
    batches = {}
    for r in got:
        assert r["length"] <= r["bucket_length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (b, k), members in batches.items():
        room = max(1, 256 // max(1, members[0]["bucket_length"]))
        last = max(x for y, x in batches if y == b)
        assert len(members) == room or k == last and len(members) <= room
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    order = [(r["bucket"], r["batch"], r["slot"], r["doc_id"], r["part"]) for r in got if r["doc_id"] is not None]
    for a, b in zip(sorted(order), sorted(order)[1:]):
        assert a[0] != b[0] or a[3:] <= b[3:]
    assert pack(docs.limit(0)).collect() == []
