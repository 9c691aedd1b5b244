import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from tidewake.llm import ordinal_quality as oq
from tidewake.llm import toxicity as tx

rng = random.Random(8)
PLAIN = "the of and ship harbour weather cargo north".split()
RUDE = ["idiot", "moron", "worthless"]


def _text(rude: bool) -> str:
    w = [rng.choice(PLAIN) for _ in range(rng.randrange(20, 200))]
    for _ in range(rng.randrange(2, 5) if rude else 0):
        w[rng.randrange(len(w))] = rng.choice(RUDE)
    return " ".join(w)


def test_toxicity_on_held_out_rows(spark):
    rows = [(i, _text(i % 4 == 0), i % 4 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows] + [(None, None, "x", 0.5), (9000, "", "x", 0.5)], "doc_id long, text string, label_id string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    got = {r.row.doc_id: r for r in tx.score_rows(docs, model).collect()}
    held = [(got[i].score >= 0.7) == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert 0 <= got[None].score < 0.7 and got[9000].score == got[None].score and got[1].row.label_id == "x"
    assert tx.score_rows(docs.limit(0), model).collect() == []


def test_toxicity_never_sees_the_held_out_fold(spark):
    rows = [(i, _text(i % 2 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    a = tx.fit(docs, spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    b = tx.fit(docs, spark.createDataFrame([(i, int(i % 2 == 0) if fold(i) != 1 else int(i % 2)) for i, _ in rows], "doc_id long, toxic int"))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_training_without_both_labels():
    assert tx.train([], []).score(b"x") == 0.5
    assert tx.train([b"a", b"b"], [0, 0]).score(b"a") < 0.5
    assert oq.train([], []).score(b"x") == (0.0, 1.0) and oq.train([b"a"], [2.0]).score(b"") == (2.0, 1.0)


def test_scores_do_not_depend_on_blocks(monkeypatch):
    model = tx.train([_text(i % 2 == 0).encode() for i in range(80)], [int(i % 2 == 0) for i in range(80)])
    long = (_text(True) * 20).encode()
    want = model.margin(long)
    monkeypatch.setattr(tx, "BLOCK", 101)
    assert abs(model.margin(long) - want) < 1e-9


def test_grades_are_ordered_and_held_out_rows_agree(spark):
    def text(g):
        return " ".join(rng.choice(PLAIN) if rng.random() < (0.15, 0.5, 0.95)[g] else rng.choice(["###", "BUY!!", "zz$$"]) for _ in range(120))

    rows = [(i, text(i % 3), i % 3) for i in range(450)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(None, None, 1.0), (9000, "", 1.0)], "doc_id long, text string, tail_prob double")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(3, None)], "doc_id long, quality int")
    model = oq.fit(docs, labels)
    assert model.grades == [0.0, 1.0, 2.0] and (np.diff(model.thresholds) > 0).all()
    got = {r.row.doc_id: r for r in oq.grade_rows(docs, model).collect()}
    held = [(got[i].expected_grade, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([round(e) == g for e, g in held]) > 0.9
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 for r in got.values()) and None in got
    assert oq.grade_rows(docs.limit(0), model).collect() == []


def test_quality_features_do_not_depend_on_blocks(monkeypatch):
    import tidewake.llm.shingles as sh

    texts = [b"", b"a", b"One. TWO, three!! " * 40, ("é word 12,5 " * 50).encode(), b"x" * 300]
    want = [[c.tolist() for c in oq.features(t)] for t in texts]
    for size in (7, 64):
        monkeypatch.setattr(oq, "BLOCK", size)
        monkeypatch.setattr(sh, "BLOCK", size)
        for t, (col, v) in zip(texts, want):
            got = oq.features(t)
            assert got[0].tolist() == col and np.allclose(got[1], v, rtol=1e-12)


def test_repeated_long_and_clashing_rows_are_scored_alike(spark):
    rows = [(i % 7, ("you idiot " if i % 2 else "calm sea ") * (1 + i % 3)) for i in range(40)] + [(90, "calm sea " * 150_000), (91, None), (91, None)]
    docs = spark.createDataFrame([(i, t, 0.25, "x") for i, t in rows], "doc_id long, text string, score double, row string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)], "doc_id long, toxic int, quality int")
    model, graded = tx.fit(docs, labels), oq.fit(docs, labels)
    for got, key in ((tx.score_rows(docs, model), ["score"]), (oq.grade_rows(docs, graded), ["expected_grade", "tail_prob"])):
        assert got.select("row.*").columns == docs.columns
        seen = {}
        for r in got.collect():
            seen.setdefault(r.row.text, set()).add(tuple(r[k] for k in key))
        assert len(seen) == len({t for _, t in rows}) and all(len(v) == 1 for v in seen.values())


def test_training_on_tables_is_training_on_texts(spark):
    rows = [(i, ("you idiot moron " if i % 3 == 0 else "calm sea and storm ") + str(i * i)) for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    kept = {r.doc_id for r in spark.createDataFrame(labels, "doc_id long, y int").filter(tx.fold(F.col("doc_id")) != 1).collect()}
    a = tx.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = tx.train([t.encode() for i, t in rows if i in kept], [y for i, y in labels if i in kept])
    assert np.allclose(a.weights, b.weights, atol=1e-6) and abs(a.bias - b.bias) < 1e-6
