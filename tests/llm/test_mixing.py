import re
from collections import defaultdict

import pytest

from tidewake.llm import mixing


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshare the excess until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, live, out = share * sum(sizes.values()), set(names), {}
    while live:
        level = left / sum(w[s] for s in live)
        over = {s for s in live if level * w[s] > cap * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in live}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        live -= over
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, rate double, copies int")


ROWS = [(i, "w " * (i % 37), f"s{i % 3}") for i in range(900)] + [(9000 + i, "tiny set", "z") for i in range(4)] + [(9100, None, None), (9101, "", None), (9102, "a b c", None), (None, "x y", "s1"), (9103, " \t", "")]


def test_targets_match_resharing(spark):
    got = mixing.mixing_plan(_frame(spark, ROWS)).collect()
    sizes = defaultdict(int)
    source = {}
    for i, t, s in ROWS:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        source[i] = s
    want = _targets(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.copies <= 2
    taken = defaultdict(int)
    for r in got:
        taken[source[r.doc_id]] += r.size * r.copies
    for s in ("s0", "s1", "s2"):
        assert abs(taken[s] - want[s]) < 0.15 * want[s]


def test_mix_repeats_whole_rows_and_is_repeatable(spark):
    df = _frame(spark, ROWS)
    plan = {r.doc_id: r.copies for r in mixing.mixing_plan(df).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert count == {k: v for k, v in plan.items() if v}
    assert sorted(map(repr, mixing.mix(df.repartition(7)).collect())) == sorted(map(repr, out.collect()))


def test_empty_and_wordless(spark):
    assert mixing.mixing_plan(_frame(spark, [])).collect() == []
    assert mixing.mix(_frame(spark, [])).collect() == []
    assert [r.target for r in mixing.mixing_plan(_frame(spark, [(1, "", "a"), (2, None, "b")])).collect()] == [0.0, 0.0]
