"""The mix against the contract's own arithmetic and a plain replay of the schedule."""
import re
from fractions import Fraction

import pytest

from slatemill.llm.mixing import mix, repeat_by_mix, schedule


def slow_targets(sizes, weights=(3, 1, 2), budget=Fraction(3, 2), cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


DOCS = [(i, "w " * (i * 37 % 50), ["b", "a", "c", "é", None, "hot"][min(i % 7, 5)]) for i in range(400)] + [
    (400, None, "a"), (401, "", None), (402, " \n", "b"), (403, "x " * 9000, "hot"), (7, "w " * 20, "a"), (7, "w " * 20, "a"), (None, "n m", "zero"), (500, "", "empty")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "t") for r in DOCS], "doc_id long, text string, source string, size long, target string").repartition(4)


@pytest.mark.parametrize("block", [16, 4096])
def test_targets_and_taken(docs, block):
    got = [r.asDict() for r in mix(docs, block_words=block).collect()]
    assert len(got) == len(DOCS)
    sizes = {}
    for _, text, source in DOCS:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = slow_targets(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - float(want[s])) <= 0.5 + 1e-6 for s in want)
    again = mix(docs.repartition(3), block_words=block).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(key(r) for r in again) == sorted(map(key, got))


def test_schedule_is_the_ranked_van_der_corput_sequence(spark):
    need = {0: 5, 1: 0, 2: 11, 3: 1, 4: 20}
    q = spark.createDataFrame(list(need.items()), "sid long, blocks long")
    got = {r.position: (r.sid, r.block) for r in schedule(q).collect()}
    seen, want = dict.fromkeys(need, 0), {}
    for i in range(64):
        cell, lo = int(format(i, "06b")[::-1], 2), 0
        for s, n in need.items():
            if lo <= cell < lo + n:
                want[i] = (s, seen[s])
                seen[s] += 1
            lo += n
    assert got == want and seen == need


def test_repeats_and_empty(spark, docs):
    rows = repeat_by_mix(docs).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "source", "size", "target"}
    words = sum(len((r.text or "").split()) for r in rows)
    size = [(s, len((t or "").split())) for _, t, s in DOCS]
    rounding = sum(max(n for x, n in size if x == s) / 2 for s in {s for s, _ in size})     # one document a source is cut
    assert abs(words - 1.5 * sum(n for _, n in size)) <= rounding + 1
    assert mix(docs.limit(0)).collect() == [] and repeat_by_mix(docs.limit(0)).collect() == []
