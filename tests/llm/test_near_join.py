import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewake.llm import near_join as nj
from tidewake.llm import common
from tidewake.llm.common import flagged, heavy_keys, join_unskewed, without_rows
from tidewake.llm.shingles import shingle_sets


def sets_of(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    return out


def brute(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return sorted(out, key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node long, component long")


def corpus(seed=3, groups=12, size=12):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in idea sea ship port north".split()) + str(rng.randrange(40))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(5, 160))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


def test_links_match_brute_force(spark):
    rows = corpus()
    rows += [(5001, None), (5002, ""), (5003, " \n"), (5004, "one two"), (5005, "One  TWO"), (5006, "one two three"), (None, rows[0][1]), (None, "alone null words here now"), (rows[1][0], rows[1][1])]
    got = nj.near_components(_frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_groups_of_dissimilar_texts_are_searched_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 3)
    rows = corpus(8, 10, 8)
    got = nj.near_components(_frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_heavy_leaders_and_clashing_names(spark, monkeypatch):
    """Leaders in cells of two, sets named by 5 bits first: the same rows."""
    monkeypatch.setattr(nj, "CELL", 2)
    rows = corpus(13, 10, 14) + [(2000 + k, "one common text of seven words here") for k in range(9)]
    got = nj._components_of(_frame(spark, rows), "doc_id", "text", 5).drop("row_hash").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_a_group_meets_its_leader_once():
    nodes = np.arange(200, dtype=np.int64) * 7 + 1
    sigs = np.full((200, 5), 3, np.uint8).tobytes()
    blob = pa.RecordBatch.from_arrays([pa.array([0]), *(pa.array([v], pa.binary()) for v in (sigs, nodes.tobytes(), np.ones(200, np.uint32).tobytes(), None, None))], names=list(nj._PACKED))
    (got,) = [b.to_pylist() for b in nj._read_groups(iter([blob]))]
    (row,) = got
    assert np.array_equal(np.frombuffer(row["members"], np.int64), nodes) and row["leader"] in nodes
    (pairs,) = [b.to_pylist() for b in nj._leader_pairs(iter([pa.RecordBatch.from_pylist([{"l": row["leader"], "m": row["members"]}])]))]
    assert {r["a"] for r in pairs} == {row["leader"]} and {r["b"] for r in pairs} == set(nodes.tolist()) - {row["leader"]}


def test_nearest_candidates_leave_the_rest_flagged():
    hist = np.zeros((4, nj.BINS // 2), np.uint8)
    hist[1, 0] = hist[3, 1] = 1
    rows = [{"grp": 9, "i": 0, "j": 0, "tile": 0, "node": k, "comp": k % 2, "n": 40, "hist": hist[k].tobytes()} for k in range(4)]
    split = [pa.RecordBatch.from_pylist(rows[:3]), pa.RecordBatch.from_pylist(rows[3:])]
    near = [r for b in nj._open_pairs(True)(iter(split)) for r in b.to_pylist()]
    assert {r["grp"] for r in near} == {None, 9} and {(r["a"], r["b"]) for r in near if r["grp"] is None} <= {(0, 1), (0, 3), (1, 2), (2, 3)}
    assert sorted((r["a"], r["b"]) for b in nj._open_pairs(False)(iter(split)) for r in b.to_pylist()) == [(0, 1), (0, 3), (1, 2), (2, 3)]


def test_joins_of_heavy_keys(spark):
    left = spark.createDataFrame([(k % 3 if k < 30 else k, k) for k in range(60)] + [(None, 99)], "key long, v long")
    right = spark.createDataFrame([(k, str(k)) for k in range(0, 60, 2)], "key long, w string")
    for how in ("inner", "left"):
        want = Counter(map(tuple, left.join(right, "key", how).select("key", "v", "w").collect()))
        assert Counter(map(tuple, join_unskewed(left, right, "key", how, 5).select("key", "v", "w").collect())) == want
    assert sorted(heavy_keys(left, "key", 5)) == [(0, 10), (1, 10), (2, 10)]


def test_membership_filter_loses_no_key(spark, monkeypatch):
    keys = spark.createDataFrame([(k * 977_777_777_777 - 5,) for k in range(3000)], "k long")
    df = spark.range(0, 9000).select((F.col("id") * 977_777_777_777 - 5).alias("v"), F.lit("x").alias("_hit"), F.col("id").alias("_slot"))
    for bits in (1 << 26, 1 << 15):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        rows, hit = flagged(df, F.col("v"), keys, "k")
        assert rows.columns == [*df.columns, hit]
        got = {r["_slot"]: r[hit] for r in rows.collect()}
        assert len(got) == 9000 and all(got[k] for k in range(3000))
        assert sum(got[k] for k in range(3000, 9000)) < (600 if bits > 1 << 20 else 6000)
    rows, hit = flagged(df, F.col("v"), keys.limit(0), "k")
    assert rows.filter(hit).count() == 0


def test_rows_go_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "a"), (2, None), (3, "c")], "doc_id long, text string")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    gone = docs.filter("text = 'a' or doc_id = 2").select(F.col("doc_id").alias("gone_id"), h.alias("gone_hash"))
    assert sorted(map(tuple, without_rows(docs, gone, "doc_id", h).collect())) == [(1, "b"), (3, "c")]


def test_empty_table_and_filter(spark):
    assert nj.near_components(_frame(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    kept = nj.drop_near_copies(_frame(spark, [(4, text), (2, text + " more"), (None, text), (9, "other text")])).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [2, 9, None] and kept[0].asDict().keys() == {"doc_id", "text", "node", "component"}


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 200, 999]:
        for _ in range(8):
            s = np.unique(rng.integers(0, 2**64, n, np.uint64))
            t = s.copy()
            changes = rng.integers(0, max(1, len(s) // 5) + 1)
            for _ in range(changes):
                t = np.delete(t, rng.integers(len(t))) if rng.random() < 0.5 and len(t) > 1 else np.unique(np.append(t, rng.integers(0, 2**64, 1, np.uint64)))
            if nj.linked(s, t):
                assert np.intersect1d(nj._signatures(s), nj._signatures(t)).size, (len(s), len(t))


def test_shingle_sets_do_not_depend_on_blocks(monkeypatch):
    import tidewake.llm.shingles as sh

    texts = [t.encode() for _, t in corpus(5)] + [b"", b" ", b"a", ("é word " * 500).encode()]
    want = [s.tolist() for s in shingle_sets(texts)]
    monkeypatch.setattr(sh, "BLOCK", 64)
    assert [s.tolist() for s in shingle_sets(texts)] == want
    assert [len(s) for s in shingle_sets([b"a b c d e f", b"A B  c D e", b"a b"])] == [2, 1, 1]
