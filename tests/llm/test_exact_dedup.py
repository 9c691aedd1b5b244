import hashlib
import random
import re

from tidewake.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, n long, sha string, row string, body string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], SCHEMA)


def _brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        known = [x for x in g if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_rows_match_brute_force(spark):
    long = "wörd " * 60_000
    rows = [(5, "a b"), (3, "a \n\t b"), (9, "a b "), (1, None), (2, ""), (4, " "), (None, "a b"), (None, "only"), (None, "only"), (7, long), (8, long), (6, "a b"), (3, "a  b"), (10, "\x1ca"), (11, "a")]
    got = ed.exact_dedup(_frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _brute(rows)


def test_empty_table(spark):
    assert ed.exact_dedup(_frame(spark, [])).collect() == []
    assert ed.drop_copies(_frame(spark, [])).columns == ["doc_id", "text", "n", "sha", "row", "body"]


def test_drop_copies_keeps_columns_and_owners(spark):
    rows = [(5, "a b"), (3, "a \n b"), (9, "c"), (None, "c")]
    got = ed.drop_copies(_frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [3, 9] and got[0].asDict().keys() == {"doc_id", "text", "n", "sha", "row", "body"}


def test_normalise_is_the_regular_expression():
    rng = random.Random(1)
    for _ in range(2000):
        t = bytes(rng.choice(b"ab \t\n\v\f\r\x1c\x85\xa0") for _ in range(rng.randrange(12)))
        assert ed.normalise(t) == re.sub(rb"[\x20\x09-\x0D]+", b" ", t)


def test_trie_spills_subtrees_and_stays_exact():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(4000)]
    for budget in (None, 64, 500, 5000):
        trie, want = ed.PatriciaTrie(ed.Owner.merge, budget), {}
        for i, k in enumerate(keys):
            trie.insert(k, ed.Owner(i, 1, hashlib.sha256(k).digest()))
            a, n = want.get(k, (i, 0))
            want[k] = (min(a, i), n + 1)
        got = list(trie.items())
        assert len(got) == len(want)
        assert {k: (v.least, v.count) for k, v in got} == want
