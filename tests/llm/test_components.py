import random

import numpy as np

from tidewake.llm.components import UnionFind, components, local_components


def test_components_match_union_find(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(60)] + [(7, 7)]
    uf = UnionFind()
    for a, b in edges:
        uf.union(a, b)
    want = {x: uf.find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_local_components():
    a, b = np.array([0, 2, 4, 5]), np.array([1, 1, 5, 6])
    assert local_components(8, a, b).tolist() == [0, 0, 0, 3, 4, 4, 4, 7]
    chain = np.arange(99)
    assert set(local_components(100, chain[::-1], chain[::-1] + 1)) == {0}
