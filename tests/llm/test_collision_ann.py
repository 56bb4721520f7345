"""Collision counting against brute force: recall, order, ties and odd rows."""
import numpy as np
import pyspark.sql.functions as F
import pytest

from slatemill.llm import collision_ann
from slatemill.llm.collision_ann import SortedProjections, collisions_needed, nearest


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float64)
    out = {}
    for i in good:
        if i % every == 0:
            s = sorted((-float(good[j] @ good[i]), j) for j in good if j != i)[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


@pytest.mark.parametrize("shard", [100, 16_384])
def test_recall_and_scores(spark, shard, monkeypatch):
    monkeypatch.setattr(collision_ann, "SHARD", shard)
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=(6, 24))
    x = np.vstack([rnd.normal(size=(400, 24)) * rnd.uniform(0.2, 3, (400, 1)), centre[rnd.integers(0, 6, 200)] + 0.05 * rnd.normal(size=(200, 24))])
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), F.expr("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 21)) for g in got.values())
    recall = np.mean([len({j for j, _ in got[i].values()} & {j for j, _ in want[i]}) / 20 for i in want])
    assert recall >= 0.95
    v = dict(rows)
    for i, g in got.items():
        assert all(abs(s - np.dot(v[i], v[j])) < 1e-9 for j, s in g.values())
        assert [(-s, j) for j, s in (g[n] for n in range(1, 21))] == sorted((-s, j) for j, s in g.values())


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, [-1.0, -1.0])]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = {}
    for r in nearest(df, F.expr("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 1, 2.0), (2, 2, 2.0), (3, 20, 0.0), (4, 40, -1.0)]
    assert sorted(got[20]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0), (4, 40, -1.0)] and set(got) == {0, 20, 40}
    assert nearest(df.limit(0), F.expr("vec_id % 20 = 0")).collect() == []


def test_threshold_is_the_quantile():
    rnd = np.random.default_rng(1)
    n = collisions_needed(64, 1.1, 0.05)
    share = ((np.abs(rnd.normal(size=(20_000, 64))) <= 1.1).sum(axis=1) >= n).mean()
    assert 0.94 < share < 0.99
    v = rnd.normal(size=(50, 8))
    assert len(SortedProjections(v, np.linalg.norm(v, axis=1).max()).search(v[3:4], 50)[0]) == 50
