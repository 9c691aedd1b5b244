"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tidewake.llm import prefix_trie


def brute(seqs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[x] for x in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(seqs[c]) == len(p))
        out.append((len(p), m[0], members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def sequences(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    out = defaultdict(list)

    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", digest(r[2] or "", r[3] or ""))):
        out[c].append((role or "", text or ""))
    return out


def shared_openings(own: dict) -> dict:
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def rows_of(frame) -> list[tuple]:
    cols = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.select(*cols).collect()), key=lambda r: r[:2])


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn int, role string, text string, node string, pos int")


def made() -> list[tuple]:
    rows = []
    for c in range(40):  # an opening that many share, of different length, and copies of whole conversations
        for t in range(c % 4):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"opening {t}"))
        for t in range(4, 4 + c % 3):
            rows.append((c, t, "user", f"own {c % 6} {t}"))
    for c in (100, 101):  # long ones that part late
        rows += [(c, t, "user", f"turn {t}" if t < 6 else f"turn {t} of {c}") for t in range(9)]
    rows += [(c, t, "user", f"turn {t}") for c in (200, 201, 202) for t in range(8)]
    rows += [(-7, None, None, None), (-7, 3, "user", "after"), (-7, None, "system", "früh"), (-5, 1, "user", "")]
    rows += [(300, 1, "user", "twice"), (300, 1, "user", "twice"), (300, 1, "assistant", "tie"), (None, 1, "user", "nobody's")]
    rows += [(301, 0, "user", "x" * 300_000)]
    return rows


@pytest.mark.parametrize("small", [3, prefix_trie.SMALL])
def test_trie_equals_brute_force_however_it_is_split(spark, small):
    rows = made()
    got = rows_of(prefix_trie.conversation_trie(table_of(spark, rows), small=small))
    assert got == brute(sequences(rows))


def test_shared_openings_equal_brute_force(spark):
    rows = made()
    members, turns = prefix_trie.branched(prefix_trie.ordered_turns(table_of(spark, rows)))
    nodes, copies, _ = prefix_trie.trie(members, turns, small=10)
    assert rows_of(prefix_trie.with_ends(nodes, copies)) == brute(shared_openings(sequences(rows)))


def test_one_conversation_with_most_turns_is_ranked_in_several_partitions(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(900)] + [(c, 0, "user", "hello") for c in range(10, 20)] + [(6, 0, "user", "same")] * 50
    turns = prefix_trie.ordered_turns(table_of(spark, rows))
    got = sorted((r.conv, r.pos) for r in turns.select("conv", "pos").collect())
    assert got == sorted((c, i + 1) for c, s in sequences(rows).items() for i in range(len(s)))
    assert rows_of(prefix_trie.conversation_trie(table_of(spark, rows), small=100)) == brute(sequences(rows))


def test_chunks_of_a_large_group_of_copies_give_one_digest(spark):
    ids = [*range(-9000, 9000, 7), 1 << 40]
    copies = spark.createDataFrame([(i, ids[0]) for i in ids] + [(50_000, 50_000), (50_001, 50_000)], "conv long, rep long")
    got = dict(tuple(r) for r in prefix_trie.digests(copies).collect())
    assert got == {ids[0]: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 50_000: hashlib.sha256(b"50000,50001").hexdigest()}


def test_empty_table_and_the_query_over_it(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(empty).count() == 0
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert prefix_trie.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rows = made()
    table_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(prefix_trie.op13_prefix_trie(spark, str(tmp_path))) == brute(shared_openings(sequences(rows)))
