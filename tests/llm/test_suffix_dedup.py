import hashlib
import random

import numpy as np
import pytest

from tidewake.llm import suffix_dedup as sd


def brute(rows, size=50):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        for p in range(len(t) - size + 1):
            g = t[p : p + size]
            first[g] = min(first.get(g, float("inf")), order(i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < order(i):
                gone[p + 1 : p + size + 1] = True
        left = bytes(c for c, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    base = [draw("abcdefgh éñ ", rng.randrange(60, 300)) for _ in range(8)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randrange(5)):
            b, r = rng.choice(base), rng.random()
            if r < 0.5:
                at = rng.randrange(len(b))
                t += b[at : at + rng.choice([45, 49, 50, 51, 60, 120])]
            else:
                t += "For " * rng.randrange(5, 40) if r < 0.6 else draw("xyzw \0", rng.randrange(100))
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "batch"), [(1 << 21, 1 << 16), (90, 40)])
def test_spans_match_brute_force(spark, monkeypatch, block, batch):
    monkeypatch.setattr(sd, "BLOCK", block)
    rows = corpus()
    rows += [(None, rows[0][1]), (None, rows[0][1]), (rows[3][0], rows[3][1]), (rows[4][0], rows[5][1])]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, ident long, body binary").repartition(3)
    got = sd.remove_repeats(df, batch=batch).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute([(i, t.encode()) for i, t in rows])
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.removed) == r.n_spans


def test_null_short_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(df).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 0, 0)]
    assert sd.remove_repeats(df.limit(0)).collect() == []


def test_levels_stay_logarithmic():
    rng = np.random.default_rng(0)
    family = sd.SuffixFamily()
    for k in range(64):
        text = np.array([rng.bytes(50).replace(b"\0", b"x") for _ in range(64)], "S50")
        family.add(text, np.full(64, k))
    assert len(family.levels) <= 8
    assert sum(len(t) for t, _ in family.levels) == 64 * 64


def test_equal_segments_of_a_batch_travel_once():
    """A passage of twelve documents in one batch: one copy's segments travel, the others' runs are told at once."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400)).encode()
    own = [bytes(rng.choice(b"xyzw") for _ in range(80)) + passage + bytes(rng.choice(b"pqrs") for _ in range(80)) for _ in range(12)]
    packer = sd._Packer(4)
    ends = np.cumsum([len(t) for t in own])
    packer.add(b"".join(own), [(i, 0, 0, 0, int(e)) for i, e in enumerate(ends)])
    runs = np.concatenate(packer.runs)
    assert set(runs["ident"].tolist()) == set(range(1, 12)) and len(runs) == 11
    assert all(r["first"] >= 70 and r["last"] <= 490 - sd.LENGTH for r in runs) and min(int(r["last"] - r["first"]) for r in runs) > 300
    travelling = sum(len(p[1]) for p in packer.parts)
    single = sd._Packer(4)
    single.add(own[0], [(0, 0, 0, 0, len(own[0]))])
    assert travelling < 12 * sum(len(p[1]) for p in single.parts) / 1.5


def test_suffix_arrays_are_in_order():
    rng = random.Random(9)
    head = [bytes(rng.choice(b"ab\0\xff") for _ in range(8)) for _ in range(5)]
    text = np.array([rng.choice(head) + bytes(rng.choice(b"xy\0\xfe") for _ in range(42)) for _ in range(600)] * 2, "S50")
    got = text[sd._suffix_array(text)]
    assert (got == np.sort(text)).all() and (got[:-1] <= got[1:]).all()


def test_rows_of_one_identifier_keep_their_own_spans(spark, monkeypatch):
    """Texts under one identifier whose first hashes clash: the passage goes from one, nothing from the other."""
    rng = random.Random(5)
    passage, *alien = ("".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(3))
    known = sd.F.xxhash64
    monkeypatch.setattr(sd.F, "xxhash64", lambda *c: sd.F.lit(7).cast("long") if len(c) == 1 and isinstance(c[0], str) and c[0] == "body" else known(*c))
    rows = [(1, passage)]
    for ident, other in zip((None, 9), alien):
        rows += [(ident, "head " + passage), (ident, "wholly " + other + " with an end of its own"), (ident, None)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute([(i, (t or "").encode()) for i, t in rows])
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 0, 0, 90, 95]  # the later one shares its head too


def test_batches_are_as_long_as_asked_and_scan_levels(monkeypatch):
    """The runs of a bucket don't depend on the batch; with short batches, several levels are scanned."""
    packer = sd._Packer(1)
    texts = [(i, t.encode()) for i, t in sorted(corpus(80))]
    ends = np.cumsum([len(t) for _, t in texts])
    for i, t in texts:  # one by one: nothing is matched before it travels
        packer.add(t, [(i, 0, 0, 0, len(t))] if t else [])
    assert int(ends[-1]) and not packer.runs
    blobs = [(n, text, meta) for _, n, text, meta in packer.rows()]
    scans, batches = [], []
    scan, add = sd._merge_scan, sd.SuffixFamily.add
    monkeypatch.setattr(sd, "_merge_scan", lambda level, text: scans.append(len(level)) or scan(level, text))
    monkeypatch.setattr(sd.SuffixFamily, "add", lambda self, s, d: batches.append((len(s), len(self.levels))) or add(self, s, d))
    found = {}
    for size in (1 << 16, 40):
        scans.clear(), batches.clear()
        found[size] = sorted(zip(*(c.tolist() for c in sd.matches(blobs, size))))
        if size == 40:
            assert max(n for n, _ in batches) == 40 and max(levels for _, levels in batches) >= 3 and len(scans) > len(batches)
        else:
            assert len(batches) == 1 and not scans
    assert found[40] == found[1 << 16] and found[40]
