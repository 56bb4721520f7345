"""Boosting from cells against boosting row by row."""
import numpy as np
import pandas as pd
import pytest

from slatemill.operators.boosting import Boost, boost_cells, boosted_walk_forward


def row_by_row(x, y, new, b):
    """Leaf-wise histogram boosting on single rows; `x` and `new` hold bins. Also returns every split."""
    k, f, out, splits = x.shape[1], np.full(len(y), y.mean()), np.full(len(new), y.mean()), []
    rnd = np.random.default_rng(b.seed)

    def best(rows, g, use):
        top = (0.0, -1, -1)
        total, m = g[rows].sum(), len(rows)
        for j in use:
            for cut in range(int(x.max()) + 1):
                left = rows[x[rows, j] <= cut]
                if len(left) >= b.min_rows and m - len(left) >= b.min_rows:
                    gl = g[left].sum()
                    gain = gl ** 2 / (len(left) + b.penalty) + (total - gl) ** 2 / (m - len(left) + b.penalty) - total ** 2 / (m + b.penalty)
                    if gain > top[0] + 1e-9:
                        top = (gain, int(j), cut)
        return top

    for _ in range(b.trees):
        use = np.sort(rnd.choice(k, min(k, max(1, int(np.ceil(b.columns * k)))), replace=False))
        g = y - f
        leaves = [(best(np.arange(len(y)), g, use), np.arange(len(y)), np.arange(len(new)))]
        while len(leaves) < b.leaves:
            i = max(range(len(leaves)), key=lambda q: leaves[q][0][0])
            (gain, j, cut), rows, asked = leaves[i]
            if gain <= 1e-12:
                break
            splits.append((j, cut))
            a, c = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
            leaves[i:i + 1] = [(best(a, g, use), a, asked[new[asked, j] <= cut]), (best(c, g, use), c, asked[new[asked, j] > cut])]
        for _, rows, asked in leaves:
            step = b.rate * g[rows].sum() / (len(rows) + b.penalty)
            f[rows] += step
            out[asked] += step
    return out, splits


@pytest.mark.parametrize("columns", [1.0, 0.6])
def test_cells_equal_rows(columns):
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 6, (900, 3))
    y = np.round(3 * (x[:, 0] > 2) + x[:, 1] * (x[:, 2] > 3) + rnd.normal(size=900), 3)
    b = Boost(trees=25, rate=0.2, leaves=6, min_rows=20, penalty=5.0, columns=columns)
    cells, inverse = np.unique(x, axis=0, return_inverse=True)
    got = boost_cells(cells, np.bincount(inverse).astype(float), np.bincount(inverse, weights=y), b)
    want, splits = row_by_row(x, y, cells, b)
    assert np.allclose(got, want, atol=1e-9) and len(splits) > 50


def test_every_season_sees_only_earlier_ones(spark):
    rnd = np.random.default_rng(5)
    n = 3000
    d = pd.DataFrame({"season": rnd.integers(0, 5, n), "a": rnd.normal(size=n), "b": rnd.integers(0, 4, n).astype(float), "eligible": rnd.random(n) < 0.9, "id": range(n)})
    d["y"] = 2 * (d.a > 0.3) + d.b + rnd.normal(size=n)
    b = Boost(trees=30, rate=0.2, leaves=6, min_rows=30, penalty=2.0)
    rows = [(int(s), None if i % 11 == 0 else float(a), float(f), bool(e), i, float(y)) for s, a, f, e, i, y in d.itertuples(index=False)]
    schema = "season int, a double, b double, eligible boolean, id int, y double"
    run = lambda r: {x.id: x.mu_gbt for x in boosted_walk_forward(spark.createDataFrame(r, schema), ["a", "b"], "y", b).collect()}
    got = run(rows)
    assert set(got) == set(d[d.season >= 2].id)
    late = d.season >= 3
    moved = run([(*r[:5], r[5] + (50.0 if r[0] >= 3 else 0.0)) for r in rows])
    assert all(got[i] == moved[i] for i in d[(d.season >= 2) & (d.season <= 3)].id) and any(got[i] != moved[i] for i in d[d.season == 4].id)
    seen = d[late & (d.id % 11 != 0)]
    error = np.mean((seen.y - [got[i] for i in seen.id]) ** 2)
    assert error < 1.4 < seen.y.var()
    assert boosted_walk_forward(spark.createDataFrame(rows, schema).where("season < 2"), ["a", "b"], "y", b).count() == 0
