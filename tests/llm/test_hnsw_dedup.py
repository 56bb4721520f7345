"""Small-world near-duplicates against all pairs by brute force."""
import numpy as np
import pytest

from slatemill.llm import hnsw_dedup
from slatemill.llm.hnsw import SmallWorld
from slatemill.llm.hnsw_dedup import cosine_groups, linked, unit


def brute(rows, above):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    near = {i: [j for j in good if j != i and len(rows[j][1]) == len(rows[i][1]) and u[i] @ u[j] >= above] for i in good}
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near.get(todo.pop(), [])) - seen
            seen |= new
            todo += new
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(names) if names else None
        out.append((name, len(near.get(i, [])), comp, name == comp))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [120, 32_768])
def test_counts_and_components(spark, shard, monkeypatch):
    monkeypatch.setattr(hnsw_dedup, "SHARD", shard)
    monkeypatch.setattr(hnsw_dedup, "BLOCK", 64)
    rnd = np.random.default_rng(2)
    x = [rnd.normal(size=16) for _ in range(250)]
    for n, noise in ((3, 0.1), (40, 0.12), (70, 0.2)):
        c = rnd.normal(size=16)
        x += [(c + noise * rnd.normal(size=16)) * rnd.uniform(0.1, 9) for _ in range(n)]
    rows = [(int(i), v.tolist()) for i, v in zip(rnd.permutation(len(x)), x)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, [0.0] * 16), (2001, None), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0, 0.0]),
                                                          (3, rows[7][1]), (None, rows[7][1]), (2005, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n_links int, cid int").repartition(5)
    got = sorted((tuple(r) for r in cosine_groups(df).collect()), key=str)
    assert got == brute(rows, 0.9)


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in cosine_groups(df).collect()] == [(4, 0, 4, True)]
    assert cosine_groups(df.limit(0)).collect() == []


def test_graph_recall():
    rnd = np.random.default_rng(7)
    v = unit(rnd.normal(size=(3000, 24)))
    v[1500:1800] = unit(v[10] + 0.05 * rnd.normal(size=(300, 24)))
    g = SmallWorld(v)
    found = sum(len(a) for a, _ in linked(g, v, v, 0.9, 16))
    assert found == (v @ v.T >= 0.9).sum()
    ids, _ = g._beam(0, np.zeros((200, 1), dtype=np.int64), v[:200].astype(np.float32), 64)
    near = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, near)]) > 0.9


def test_sparse_links_between_shards():
    """One query in a hundred has a link, at a cosine just above 0.9, in a shard that it is not from."""
    rnd, want, got = np.random.default_rng(11), 0, 0
    for _ in range(1):
        v = unit(rnd.normal(size=(8192, 64)))
        q = unit(rnd.normal(size=(2048, 64)))
        some = rnd.choice(len(q), 20, replace=False)
        side = unit(rnd.normal(size=(20, 64)))
        to = v[rnd.choice(len(v), 20, replace=False)]
        side = unit(side - np.einsum("ij,ij->i", side, to)[:, None] * to)
        q[some] = 0.905 * to + np.sqrt(1 - 0.905 ** 2) * side
        want += (q @ v.T >= 0.9).sum()
        got += sum(len(a) for a, _ in linked(SmallWorld(v), v, q, 0.9, hnsw_dedup.WIDTH))
    assert want >= 20 and got == want


def test_a_graph_that_leads_nowhere_is_noticed_without_links():
    """No audited query has a link; only its nearest neighbours show that beams cannot reach the node of query 1."""
    rnd = np.random.default_rng(5)
    v, q = unit(rnd.normal(size=(1000, 32))), unit(rnd.normal(size=(2000, 32)))
    q[1] = v[700]
    g = SmallWorld(v)
    for links in g.links:
        links[100:] = -1
        links[links >= 100] = -1
    found = [(a, b) for x, y in linked(g, v, q, 0.9, hnsw_dedup.WIDTH) for a, b in zip(x.tolist(), y.tolist())]
    assert (q @ v.T >= 0.9).sum() == 1 and found == [(1, 700)]
