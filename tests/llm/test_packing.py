import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewake.llm import pattern_packing as pp
from tidewake.llm import token_matrix as tm
from tidewake.llm.tokens import cut, default_path, document_ids, encoder

rng = random.Random(5)
TEXTS = [" ".join(rng.choice(["ship", "harbour", "Zug", "ñandú", "12,5", "\n\n", "!!"]) for _ in range(rng.choice([0, 1, 5, 80, 700, 2500]))) for _ in range(60)]
ROWS = list(enumerate(TEXTS)) + [(None, "no identifier"), (None, "no identifier"), (3, TEXTS[3]), (100, None), (101, ""), (102, "<|endoftext|> is plain text")]
SCHEMA = "doc_id long, text string, length long, piece int, ids string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, 9, "x") for i, t in rows], SCHEMA)


def test_both_vocabulary_files_give_the_same_ids():
    fast, plain = encoder(None), encoder(default_path("byte_bpe_50k.json"))
    odd = ["\x1c\x85  x", "it's  'll\t\n x", "a\r\n\r\nb", "日本語 テキスト", "\U0001f6a2" * 3, "x" * 300, " " * 40 + "y"]
    letters = "aZ9 \n\t'.,é  ß"
    odd += ["".join(rng.choice(letters) for _ in range(60)) for _ in range(300)]
    for t in TEXTS + odd:
        assert fast(t) == plain(t)


def test_pack_places_every_piece_without_overlap(spark):
    got = pp.pack(_frame(spark, ROWS).repartition(3)).collect()
    want = Counter()
    for i, t in ROWS:
        ids = document_ids(t)
        for k, (at, n) in enumerate(cut(len(ids), 1024)):
            want[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    per = defaultdict(list)
    for r in got:
        per[r.sequence_id].append((r.offset, r.length))
    for parts in per.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(per) <= -(-total // 1024) * 1.03 + 1
    assert pp.pack(_frame(spark, [])).collect() == []


def test_cut_is_lossless():
    for n in (1, 1023, 1024, 1025, 2048, 5000):
        parts = cut(n, 1024)
        assert sum(p[1] for p in parts) == n and all(p[1] == 1024 for p in parts[1:]) and [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts])[:-1])


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_each_piece_once_and_waste_little(seed):
    r = np.random.default_rng(seed)
    hist = Counter(int(x) for x in np.clip(r.lognormal(5.5, 1.0, 4000), 1, 256))
    plan = pp.plan_sequences(hist, 256)
    used = Counter()
    for kind, n in plan.items():
        assert n > 0 and sum(kind) <= 256
        for length in kind:
            used[length] += n
    assert used == hist
    assert sum(plan.values()) <= sum(pp.best_fit_counts(dict(hist), 256).values()) * 1.01 + 1


def test_room_tree_is_best_fit_decreasing():
    for _ in range(50):
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(60))]
        got = tm.best_fit_decreasing(lengths, 64)
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] + n <= 64]
            if fits:
                bins[max(fits, key=lambda b: bins[b])] += n
            else:
                bins.append(n)
        assert sorted(sum(lengths[i] for i in b) for b in got) == sorted(bins)


def test_matrix_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tm, "WINDOW_IDS", 3000)
    df = _frame(spark, ROWS).repartition(2)
    tm.write_matrix(df, str(tmp_path / "m"))
    matrix = spark.read.parquet(str(tmp_path / "m"))
    rows = matrix.collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    ids, positions = tm.read_matrix(rows)
    for r, p, row in zip(rows, positions, ids):
        for lo, hi in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert p[lo:hi].tolist() == list(range(hi - lo)) and hi > lo
        assert r.cu_seqlens[-1] == r.n_tokens <= 1024 and not row[r.n_tokens :].any()
    docs = defaultdict(list)
    for s in tm.unpack(matrix).collect():
        docs[s.doc_id].append((s.start, bytes(s.ids)))
    for i, t in ROWS:
        if i not in (None, 3):
            assert b"".join(b for _, b in sorted(docs[i])) == document_ids(t).tobytes()
    assert len(docs[None]) == 2 and len(docs[3]) == 2 * len(cut(len(document_ids(TEXTS[3])), 1024))
    assert tm.token_matrix(_frame(spark, [])).collect() == []
