import math

import numpy as np
import pyarrow as pa

from tidewake.llm import projection_forest as pf


def brute(rows):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            (a, u, k), (b, v, m) = rows[i], rows[j]
            if None in (a, b, k, m) or k != m or not ok(u) or not ok(v) or len(u) != len(v):
                continue
            x, y = np.float32(u).astype(float), np.float32(v).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i, (a, _, _) in enumerate(rows):
        comp = min((rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None), default=None) if a is not None else None
        out.append((a, links[i], comp, a == comp))
    return out


def corpus(n=700, dims=24):
    rng = np.random.default_rng(9)
    rows, centre = [], rng.standard_normal((30, dims))
    for i in range(n):
        c = centre[0] if i % 3 == 0 else centre[rng.integers(30)]
        spread = rng.choice([0.05, 0.12, 0.3, 1.0])
        rows.append((i, (c + spread * rng.standard_normal(dims)).astype(np.float32).tolist(), int(i % 4)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label int, node long, vector double")


def test_links_reach_the_recall_and_none_is_false(spark, monkeypatch):
    monkeypatch.setattr(pf, "TILE", 40)
    rows = corpus()
    got = {r.vec_id: r for r in pf.near_vectors(_frame(spark, rows), leaf=30).collect()}
    want = {a: (n, c) for a, n, c, _ in brute(rows)}
    assert all(got[a].n_links <= n for a, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert np.mean([got[a].component_id == c for a, (_, c) in want.items()]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    v = [1.0] * 8
    rows = [(5, v, 1), (3, v, 1), (3, v, 1), (9, v, 2), (10, v, None), (11, None, 1), (12, [0.0] * 8, 1), (13, [1.0, None] * 4, 1), (14, [float("nan")] * 8, 1), (15, [float("inf")] * 8, 1), (16, [2.0] * 8, 1), (17, [1.0] * 4, 1), (18, [], 1), (None, v, 1)]
    got = pf.near_vectors(_frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((a, n, c, k) for a, n, c, k in brute(rows)), key=repr)
    assert pf.near_vectors(_frame(spark, [])).collect() == []
    assert len(pf.near_vectors(_frame(spark, [(1, None, None)])).collect()) == 1


def test_a_pair_counts_in_one_leaf_only():
    lists = [[1, 4, 9], [4, 9], [2, 9], [9]]
    i, j = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3])
    assert pf._met_before(pf._earlier(pa.array(lists), 9), i, j).tolist() == [True, False, False, False]
    assert pf._met_before(pf._earlier(pa.array(lists), 4), i[:1], j[:1]).tolist() == [False]


def test_a_longer_vector_outside_the_sample_keeps_its_links(spark):
    """The one vector of five components has zeros in the first four: nothing of it may be cut."""
    rows = [(i, [float(i + 1), 1.0, 0.5, 2.0], 0) for i in range(8)] + [(20, [0.0, 0.0, 0.0, 0.0, 3.0], 0), (21, [0.0, 0.0, 0.0, 0.0, 5.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pf.near_vectors(_frame(spark, rows), sample=2).collect()}
    assert got[20] == (1, 20) and got[21] == (1, 20)
