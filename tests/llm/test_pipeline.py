import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as cp
from tidewake.llm import toxicity
from tidewake.llm.tokens import cut, document_ids

from .test_mixing import _targets
from .test_near_join import sets_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rng = random.Random(11)
    plain = "the of and ship harbour weather cargo north sea storm light".split()
    rows = []
    for i in range(260):
        w = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(8, 150))]
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "worthless"])
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 1))
    for i in range(260, 300):
        base = rows[(i * 3) % 100][1].split()
        if i % 2:
            base[len(base) // 2] = "changed"
        rows.append((i, ("  " if i % 4 == 0 else " ").join(base), "en", None, 1))
    return rows + [(400, None, None, "s1", None), (401, "", "de", "s2", 0), (None, "row without identifier", None, "s0", 5)]


def _stages(rows, labels, model):
    """Brute force of every stage on its own input."""
    rows = [r for r in rows if model.score((r[1] or "").encode()) < 0.7]
    yield rows
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in rows:
        if r[0] is not None:
            least[norm(r[1])] = min(r[0], least.get(norm(r[1]), r[0]))
    rows = [r for r in rows if least.get(norm(r[1])) == r[0]]
    yield rows
    sets, parent = sets_of([r[:2] for r in rows]), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    first = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[find(i)].append(r[0])
    rows = [r for i, r in enumerate(rows) if r[0] is None or r[0] == min(first[find(i)])]
    yield rows
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    targets, out = _targets(sizes), []
    for r in rows:
        rate = targets[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        u = int(hashlib.sha256(f"mix-1:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (int(rate) + (u < rate - int(rate)))
    yield out


def test_every_stage_matches_brute_force(spark, tmp_path):
    rows = _corpus()
    labels = [(i, int(i % 5 == 0)) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    for k, ((name, stage), want) in enumerate(zip(cp.STAGES, _stages(rows, labels, model))):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
    assert 50 < len(want) < 2 * len(rows)
    pieces = Counter()
    for r in want:
        ids = document_ids(r[1])
        for p, (at, n) in enumerate(cut(len(ids), 1024)):
            pieces[r[0], p, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in cp.run(spark, str(tmp_path)).collect()) == pieces


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Rows that repeat identifier and text share their fate; columns named like working ones pass."""
    base = "the storm and the harbour light of the north sea with ships and cargo under heavy weather".split()
    text, other = " ".join(base * 3), " ".join(reversed(base * 3))
    rows = [(1, text, "s0", 1.0, "x"), (1, text, "s0", 2.0, "x"), (2, text + " ", "s0", 3.0, "x"), (3, text + "  more", "s0", 4.0, "x"), (4, other, None, 5.0, "x"), (4, other, None, 5.0, "x"), (5, None, "s1", 6.0, None), (6, "", "s1", 7.0, "x")]
    schema = "doc_id long, text string, source string, score double, gone_id string"
    docs = spark.createDataFrame(rows, schema).repartition(2)
    spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in cp.STAGES[1:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 2, 4: 2, 5: 1})
    scored = cp.drop_toxic(spark, docs, str(tmp_path))
    assert scored.columns == docs.columns and {r.doc_id for r in scored.collect()} <= {r[0] for r in rows}
    mixed = cp.mix_sources(spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in cp.pack_sequences(spark, kept, str(tmp_path)).collect()} == {1, 4, 5}
