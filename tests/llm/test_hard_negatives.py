"""Residue products against Python integers, hard negatives against a plain search."""
import math
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from slatemill.llm import hard_negatives as hn
from slatemill.llm.hard_negatives import ResidueScores, best, moduli

SCHEMA = "vec_id long, embedding array<double>, label int, score double, row string"


def plain(rows):
    good = []
    for i, (k, v, label) in enumerate(rows):
        if k is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, k, [math.floor(256 * x) for x in v], (label + 1) % 10 if k % 7 == 0 else label))
    dim = max(Counter(len(g[2]) for g in good).items(), key=lambda x: (x[1], x[0]))[0] if good else 0
    good = [g for g in good if len(g[2]) == dim]
    out = []
    for i, k, v, label in good:
        if k % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(v, w)), kk, j, other) for j, kk, w, other in good if j != i)
        for p, pk, _, other in [x for x in s if x[3] == label][:5]:
            fit = [x for x in s if x[3] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(k, pk, n + 1, x[1], -p, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def both(spark, rows):
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA).repartition(4)
    got = hn.hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect()), plain(rows)


@pytest.mark.parametrize("shard, scale", [(65_536, 1.0), (90, 1.0), (90, 3e4)])
def test_against_plain_search(spark, monkeypatch, shard, scale):
    monkeypatch.setattr(hn, "SHARD", shard)
    monkeypatch.setattr(hn, "SUB", 2)
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 70)) * scale + 0.4 * scale
    x[::3] = x[0]                                   # a third of all rows are copies
    got, want = both(spark, [(i, x[i].tolist(), int(rnd.integers(0, 3))) for i in range(300)])
    assert got == want and len(got) > 20


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 0.5], 2), (2, [0.9, 0.5], 3), (3, [0.9, 0.9], 2), (4, [1.0, nan], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2),
            (7, [0.5, 0.5], 1), (8, None, 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (10, [1.0], 2), (11, [], 2), (12, [0.0, 0.0], 2), (13, [0.7, 0.6], 2), (14, [0.7, 0.6], 3),
            (50, [0.0, 0.0], 2), (100, [-1.0, -1.0], 2)]
    got, want = both(spark, rows)
    assert got == want and {r[0] for r in got} >= {0, 50}
    big, _ = both(spark, rows + [(15, [1e300, 1.0], 2)])
    assert big == want
    assert both(spark, [])[0] == [] and both(spark, [(1, [1.0], 1)])[0] == []


def test_residue_products_are_exact():
    rnd = np.random.default_rng(7)
    for dim, size in ((64, 300), (200, 2 ** 20), (3, 2 ** 30)):
        a, b = rnd.integers(-size, size + 1, (9, dim)), rnd.integers(-size, size + 1, (40, dim))
        a[0], b[0], b[1] = size, size, -size
        primes = moduli(dim * size * size)
        assert len(set(primes)) == len(primes) and hn.SLICE * (primes[0] // 2) ** 2 <= 2 ** 24 and math.prod(primes) > 2 * dim * size * size
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert ResidueScores(b, primes).score(a).tolist() == want


def test_best_breaks_ties_by_column():
    s = np.array([[5, 7, 7, 1, 7], [1, 1, 1, 1, 1]])
    fit = np.array([[True, True, True, True, True], [False, True, False, False, False]])
    q, c = best(s, fit, 2)
    assert list(zip(q.tolist(), c.tolist())) == [(0, 1), (0, 2), (1, 1)]
