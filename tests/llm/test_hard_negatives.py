"""Hard negatives against all pairs in whole numbers."""

import math

import numpy as np
import pytest

from tidewake.llm import hard_negatives


def brute(rows: list[tuple], every: int = 50, positives: int = 5, negatives: int = 3) -> list[tuple]:
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, x, label) in enumerate(good):
        if a % every:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, n, other == label) for n, (i, y, other) in enumerate(good) if n != k]
        scored = sorted((-max(-(1 << 63) + 2, min((1 << 63) - 1, s)), i, n, same) for s, i, n, same in scored)
        for ps, p, _, _ in [r for r in scored if r[3]][:positives]:
            near = [r for r in scored if not r[3] and 50 * -ps <= 100 * -r[0] <= 95 * -ps]
            out += [(a, p, rank, n, -ps, -s) for rank, (s, n, _, _) in enumerate(near[:negatives], 1)]
    return sorted(out)


def made(n: int = 700) -> list[tuple]:
    g = np.random.default_rng(5)
    centre = g.standard_normal((8, 12)) / 3
    rows = [(int(i), (centre[g.integers(8)] + 0.1 * g.standard_normal(12)).tolist(), int(g.integers(4))) for i in g.permutation(n)]
    common = centre[0].tolist()  # a third of the rows hold one vector: ties
    rows = [(i, common if k % 3 == 0 else v, 1 if k % 3 == 0 and k % 2 else label) for k, (i, v, label) in enumerate(rows)]
    rows += [(1000, None, 1), (1050, [0.1] * 11 + [None], 1), (1100, [float("nan")] + [0.1] * 11, 1), (1150, [float("inf")] * 12, 1), (1200, [0.1] * 12, None), (None, [0.1] * 12, 1)]
    rows += [(1250, [], 1), (1300, [0.0] * 12, 1), (1350, common[:5], 2), (1400, common, 1), (1400, common, 1), (1450, [-v for v in common], 3), (1500, common, 77)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, ids string, first long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("kw", [{}, {"block_rows": 7, "broadcast_bytes": 20_000}])
def test_equals_all_pairs(spark, kw):
    rows = made()
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows), **kw).collect())
    want = brute(rows)
    assert got == want and len(want) > 50


def test_numbers_beyond_the_exact_range_of_doubles(spark):
    g = np.random.default_rng(2)
    big = [(i, (g.standard_normal(6) * 10.0 ** (4 + 6 * (i % 3))).tolist(), i % 2) for i in range(120)]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(spark, big), every=10).collect())
    assert got == brute(big, every=10) and got
    a = np.array([[2.0**40, 3.0], [1.0, -(2.0**80)]])
    assert hard_negatives.product(a, a[:1]).tolist() == [[(1 << 63) - 1], [-(1 << 63) + 2]]


def test_product_is_exact_in_each_range():
    g = np.random.default_rng(3)
    for top in (1 << 20, 1 << 27, 1 << 34):
        a, b = (g.integers(-top, top, (9, 4)).astype(float) for _ in range(2))
        want = [[max(-(1 << 63) + 2, min((1 << 63) - 1, sum(int(p) * int(q) for p, q in zip(x, y)))) for y in b] for x in a]
        assert hard_negatives.product(a, b).tolist() == want


def test_query_equals_all_pairs_and_an_empty_table_gives_nothing(spark, tmp_path):
    rows = [(i, v, None if label is None else label % 10) for i, v, label in made(300)]
    frame(spark, rows).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = sorted(tuple(r) for r in hard_negatives.op12_hard_negatives(spark, f"{tmp_path}/a").collect())
    shifted = [(i, v, (label + 1) % 10 if i is not None and label is not None and i % 7 == 0 else label) for i, v, label in rows]
    assert got == brute(shifted) and got
    frame(spark, []).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert hard_negatives.op12_hard_negatives(spark, f"{tmp_path}/b").count() == 0
