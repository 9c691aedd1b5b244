"""Every opN_ query on small tables: against its SQL, brute force, or an exact round trip."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidewake.llm import licence_scan
from tidewake.llm.queries import ORACLES, QUERIES

from .test_projection_forest import brute as brute_vectors

WORDS = "The of and ship Harbour weather cargo north sea storm light MIT Apache general public License license".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("tables")), random.Random(4)
    docs = []
    for i in range(150):
        w = [rng.choice(WORDS) + rng.choice(["", "s", ",", " 12"]) for _ in range(rng.randrange(0, 160))]
        if i % 6 == 0:
            w[2:2] = ["Released under the MIT license", "idiot moron"]
        docs.append((i * 3, rng.choice([" ", "\n", "  "]).join(w), "en", rng.choice(["a", "b", "é", None]), len(w)))
    docs += [(900 + k, docs[k * 7][1].replace("cargo", "Cargo", 1) + " tail" * (k % 2), "en", "a", 1) for k in range(12)]
    docs += [(950, None, None, None, None), (951, "", "en", "b", 0), (952, "word " * 3000 + "<|endoftext|> end", "en", "b", 1), docs[5], docs[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i * 3, i % 2, int(i % 6 == 0)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    g = np.random.default_rng(1)
    centre = g.standard_normal((6, 16))
    vectors = [(i, (centre[i % 6] + 0.05 * (i % 4) * g.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(90)] + [(95, None, 1), (96, [0.0] * 16, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, docs, vectors


def _run(spark, tables, name):
    return QUERIES[name](spark, tables[0]).collect()


@pytest.mark.parametrize("name", sorted(n for n, sql in ORACLES.items() if "FROM documents" in sql or "from documents" in sql))
def test_queries_equal_their_sql(spark, tables, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables[0]}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda rs: sorted(tuple(cell(r[c]) for c in sorted(want.columns)) for r in rs)
    got = [r.asDict() for r in _run(spark, tables, name)]
    assert len(got) == len(tables[1])
    if name == "op8_ngram_jaccard":  # its SQL has one row per identifier
        got = list({r["doc_id"]: r for r in got}.values())
    assert rows(got) == rows([dict(zip(want.columns, r)) for r in want.fetchall()])


def test_op3_is_what_the_tokenizer_says(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = _run(spark, tables, "op3_pattern_packing")
    ids = {d[0]: np.array(tok.encode(d[1] or "", add_special_tokens=False).ids + [2], "<u4") for d in tables[1]}
    assert 50256 in ids[952]
    seen, room = {}, {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length <= 1024
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = {d[0]: sum(x[0] == d[0] for x in tables[1]) for d in tables[1]}
    for doc, pieces in seen.items():
        once = sorted(set(pieces))
        assert len(pieces) == copies[doc] * len(once) and [p for p, _, _ in once] == list(range(len(once)))
        assert [s for _, s, _ in once] == np.cumsum([0] + [n for _, _, n in once])[:-1].tolist() and sum(n for _, _, n in once) == len(ids[doc])
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_op4_base_columns(spark, tables):
    got = sorted(_run(spark, tables, "op4_licence_scan"), key=lambda r: r.doc_id)
    for r, d in zip(got, sorted(tables[1], key=lambda d: d[0])):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[1] or "")
        places = licence_scan.base_places(d[1] or "")
        starts = [s for _, s in places]
        labels = {licence_scan.BASE[k][1] for k, _ in places}
        assert (r.doc_id, r.n_words, r.n_base) == (d[0], len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)), len(places))
        assert (r.first_word, r.last_word, r.base_labels) == (min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert any(r.n_base for r in got)


@pytest.mark.parametrize(("name", "score"), [("op5_ordinal_quality", "tail_prob"), ("op6_toxicity", "score")])
def test_held_out_and_decisions(spark, tables, name, score):
    got = _run(spark, tables, name)
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in tables[1])
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r[score] <= 1
        assert (r.predicted == int(r.score >= 0.7)) if name == "op6_toxicity" else (r.kept == (r.tail_prob >= 0.5) and 0 <= r.expected_grade <= 1)
    if name == "op6_toxicity":
        assert all(r.predicted == int(r.doc_id % 18 == 0) for r in got if r.doc_id < 450 and r.held_out)


def test_op7_on_whole_vectors(spark, tables):
    got = sorted(tuple(r) for r in _run(spark, tables, "op7_projection_forest"))
    assert got == sorted(brute_vectors(tables[2]))


def test_op9_rows_are_the_texts(spark, tables):
    from tidewake.llm.tokens import document_ids

    pieces = {}
    for r in _run(spark, tables, "op9_token_matrix"):
        row, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(row) == len(positions) == 1024 and r.n_segments == len(r.doc_ids) and zlib.crc32(r.ids) == r.ids_crc32 and zlib.crc32(r.positions) == r.positions_crc32
        for doc, piece, start, lo, hi in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault((doc, piece, start), []).append(row[lo:hi])
            assert positions[lo:hi].tolist() == list(range(hi - lo))
        assert not row[r.n_tokens :].any() and r.cu_seqlens[-1] == r.n_tokens
    for d in tables[1]:
        want = document_ids(d[1])
        parts = [v for (doc, *_), v in sorted(pieces.items()) if doc == d[0]]
        assert np.concatenate([v[0] for v in parts]).tolist() == want.tolist()
