"""Operator 8: Jaccard self-join of word-shingle sets by PartEnum signatures.

Two sets link when their Jaccard similarity is at least 4/5. Such sets differ in at most
(n + m) / 9 elements and their sizes are within 4:5. Sizes are cut in bands of that ratio,
so linked sets share a band or sit in neighbouring ones; a set writes signatures for its
own band and, where a partner can be there, for the next. A band cuts the domain of shingle
hashes in more partitions than elements may differ, so the elements of one partition at
least are the same on both sides, and a signature is the hash of one partition's elements.
An empty partition proves nothing and gives no signature; a set that fills too few
partitions also writes signatures of a finer partitioning, and so on (the finer of two sets
still writes all coarser ones, so the pair meets).

Of the partitions that a set of size n fills, at most k = (n + largest partner) / 9 differ
from a linked set's. Signatures have one order for all (elements of the partition, then
hash), and a set writes its k + 1 highest ones only: of the signatures that a pair shares,
the highest has at most k before it on either side, so both write it. Partitions of one
element, which a passage shared by many documents fills by the thousand, drop out that way.

Equal sets are one node. Every group of nodes that share a signature tests its members
against a leader (the first of an order for all, so that groups agree on leaders); pairs are
bounded by histograms before their whole texts are compared. Components of the links found
are built, and only nodes of one group in different components are tested against each
other, in two steps: first each node's nearest candidate by histogram, then, after another
contraction, all candidates that are left. So a large group of near copies costs a few
tests a node, no pair is left out, and no group is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import discard, flagged, heavy_keys, join_unskewed, materialise, mix64, prepare, shuffle_width, table, text_bytes, without_rows
from tidewake.llm.components import components
from tidewake.llm.shingles import set_fingerprint, shingle_sets

#: Partitions beyond k, as a share: fewer sets need a finer partitioning.
SLACK = 0.2
#: Bins of the histograms that bound a pair's difference from below; counts are capped at 15
#: (which keeps the bound a bound), two in a byte.
BINS = 256
#: Nodes of a group in one row.
CHUNK = 1 << 16
#: Signatures that are sorted at a time.
SORTED = 1 << 22
#: Members of a group in one side of a tile pair; pairs that one task compares at a time.
TILE = 1024
BLOCK = 1 << 14
#: Candidates of one node that one task verifies.
CELL = 1024
#: Bytes of texts in a batch: a set's hashes and signatures take several times as much.
BATCH_BYTES = 4 << 20
#: Bytes of a signature that travel; the bucket says the rest, and clashes only cost tests.
SIG_BYTES = 5
#: Set names that may clash (64 bits) before the job gives up naming them apart.
MOST_CLASHES = 10_000

_I64 = pa.int64()
_PACKED = ("bucket", "sigs", "nodes", "times", "ids", "sets")
_ORDER = np.uint64(0x9E3779B97F4A7C15)
#: A document's identity, and what the first text of a set tells about the set.
_ID = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_shingles", "<i8"), ("node", "<i8"), ("row_hash", "<i8")])
_SET = np.dtype([("node", "<i8"), ("check", "<i8"), ("n", "<i8"), ("row_hash", "<i8"), ("hist", f"V{BINS // 2}")])


def band_starts(most: int) -> list[int]:
    """First size of each band: consecutive starts are at least 5:4 apart."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-5 * out[-1] // 4)))
    return out


_STARTS = np.array(band_starts(1 << 40), np.int64)


def _signatures(s: np.ndarray) -> np.ndarray:
    """The signatures that a sorted set writes."""
    n = len(s)
    own = int(np.searchsorted(_STARTS, n, "right")) - 1
    mixed = mix64(s)
    top = s >> np.uint64(32)
    out = []
    for band in (own, own + 1):
        if band > own and 5 * n < 4 * int(_STARTS[band]):
            break  # no linked set is that large
        last = int(_STARTS[band + 1]) - 1
        differ = (n + min(last, 5 * n // 4)) // 9
        parts = 1 if 2 * last < 9 else int((2 * last // 9 + 1) * (1 + SLACK)) + 1
        for level in range(64):
            # hashes are sorted, so a partition (a range of hashes) is a run of the array
            at = (top * np.uint64(parts)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            h = np.add.reduceat(mixed, first) + at[first] * np.uint64(0xA0761D6478BD642F)
            h = mix64(h ^ np.uint64((band * 64 + level) * 0xE7037ED1A0B428DB & (1 << 64) - 1))
            if len(first) > differ:
                held = np.diff(np.append(first, n))
                out.append(h[np.lexsort((h, held))[-differ - 1 :]])
                break
            out.append(h)
            if parts >= 1 << 31:
                break
            parts *= 4
    return np.concatenate(out)


def _histogram(s: np.ndarray) -> bytes:
    count = np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS), 15).astype(np.uint8)
    return (count[::2] | count[1::2] << 4).tobytes()


def _open_histograms(packed: np.ndarray) -> np.ndarray:
    """(rows, BINS / 2) bytes to (rows, BINS) counts."""
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1).astype(np.int8)


def _blobs(column: pa.Array, size: int) -> np.ndarray:
    """A binary column of equally long values as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _name(s: np.ndarray, clashes: frozenset, bits: int) -> tuple[int, int]:
    """(name, check) of a set: two 64-bit hashes; a name that two sets were given before yields to the check."""
    if not len(s):
        return 0, 0
    name, check = set_fingerprint(s) >> (64 - bits), set_fingerprint(s ^ np.uint64(0xA24BAED4963EE407))
    return (check if name in clashes else name), check


def _write_signatures(buckets: int, clashes: frozenset, bits: int):
    """(doc_id, row_hash, body) to rows by bucket: packed signatures with their nodes; identities; sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist())
            names = [_name(s, clashes, bits) for s in sets]
            ids = np.zeros(len(sets), _ID)
            ids["doc_id"] = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            ids["known"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids["n_shingles"] = [len(s) for s in sets]
            ids["node"] = _signed([a for a, _ in names])
            ids["row_hash"] = batch.column(1).to_numpy()
            first = {name: i for i, name in reversed(list(enumerate(names))) if len(sets[i])}
            own = np.zeros(len(first), _SET)
            sigs = []
            for k, ((node, check), i) in enumerate(first.items()):
                own[k] = tuple(_signed([node, check])) + (len(sets[i]), ids["row_hash"][i], _histogram(sets[i]))
                sigs.append(_signatures(sets[i]))
            spread = int(mix64(ids["row_hash"][:1].view(np.uint64))[0] % np.uint64(buckets)) if len(ids) else 0
            rows = [(spread, None, None, None, ids.tobytes(), own.tobytes())]
            if sigs:
                node = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
                sig = np.concatenate(sigs)
                bucket, sig = (sig % np.uint64(buckets)).astype(np.int64), sig // np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, node = bucket[order], node[order]
                short = sig[order].view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                for lo, hi in zip(cut[:-1], cut[1:]):
                    who, times = np.unique(node[lo:hi], return_counts=True)
                    rows.append((int(bucket[lo]), short[lo:hi].tobytes(), own["node"][who].tobytes(), times.astype(np.uint32).tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, _I64 if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], names=list(_PACKED))

    return run


def _distinct_members(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, first, last) of the groups of two and more different nodes."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node = sig[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    last = np.append(first[1:], len(sig))
    several = last - first > 1
    return node, first[several], last[several]


def _read_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed signatures of one partition to its different groups, by chunks of members, each with the group's leader."""

    def out(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        kinds = {"grp": _I64, "chunk": _I64, "leader": _I64}
        return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * n), kinds.get(c, pa.binary())) for c in _GROUP], names=list(_GROUP))

    blobs = []
    for batch in batches:
        for _, sigs, nodes, times, ids, sets in zip(*(c.to_pylist() for c in batch.columns)):
            if sigs is None:
                yield out(ids=[ids], sets=[sets])
            else:
                blobs.append((sigs, nodes, times))
    slices = 1 + sum(len(b[0]) for b in blobs) // SIG_BYTES // SORTED
    seen: set[int] = set()
    for part in range(slices):
        sig, node = [], []
        for sigs, nodes, times in blobs:
            wide = np.zeros((len(sigs) // SIG_BYTES, 8), np.uint8)
            wide[:, :SIG_BYTES] = np.frombuffer(sigs, np.uint8).reshape(-1, SIG_BYTES)
            s, n = wide.view("<u8").ravel(), np.repeat(np.frombuffer(nodes, "<i8"), np.frombuffer(times, "<u4"))
            own = s % np.uint64(slices) == part
            sig.append(s[own])
            node.append(n[own])
        if not sig:
            return
        node, first, last = _distinct_members(np.concatenate(sig), np.concatenate(node))
        rank = mix64(node.view(np.uint64) ^ _ORDER)
        salted = mix64(node.view(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        grp, chunk, leader, members = [], [], [], []
        for lo, hi in zip(first.tolist(), last.tolist()):
            name = int(mix64(np.array([salted[lo:hi].sum(dtype=np.uint64) + np.uint64(hi - lo)]))[0])
            if name in seen:
                continue
            seen.add(name)
            head = int(node[lo + int(np.argmin(rank[lo:hi]))])
            for at in range(lo, hi, CHUNK):
                grp.append(int(_signed([name])[0]))
                chunk.append((at - lo) // CHUNK)
                leader.append(head)
                members.append(node[at : min(at + CHUNK, hi)].tobytes())
            if len(grp) >= 4096:
                yield out(grp=grp, chunk=chunk, leader=leader, members=members)
                grp, chunk, leader, members = [], [], [], []
        if grp:
            yield out(grp=grp, chunk=chunk, leader=leader, members=members)


_GROUP = ("grp", "chunk", "leader", "members", "ids", "sets")
_GROUP_TYPE = "grp long, chunk long, leader long, members binary, ids binary, sets binary"


def _read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            r = np.frombuffer(raw, _ID)
            cols = [pa.array(r["doc_id"].copy(), mask=r["known"] == 0), *(pa.array(r[c].copy()) for c in ("n_shingles", "node", "row_hash"))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "node", "row_hash"])


def _read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            r = np.frombuffer(raw, _SET)
            cols = [*(pa.array(r[c].copy()) for c in ("node", "check", "n", "row_hash")), pa.array([h.tobytes() for h in r["hist"]], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "check", "n", "row_hash", "hist"])


def _leader_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups to the different (leader, member) pairs of a batch."""
    for batch in batches:
        a, b = [], []
        for head, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            members = np.frombuffer(raw, np.int64)
            others = members[members != head]
            a.append(np.full(len(others), head))
            b.append(others)
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups to (grp, node) rows."""
    for batch in batches:
        members = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
        if members:
            grp = np.repeat(batch.column(0).to_numpy(), [len(m) for m in members])
            yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(np.concatenate(members))], names=["grp", "node"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, hist_a, n_b, hist_b) to the pairs whose sizes and histograms allow a link."""
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        fits = np.flatnonzero(5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
        if not len(fits):
            continue
        some = batch.take(pa.array(fits))
        near = _distances(_open_histograms(_blobs(some.column(3), BINS // 2)), _open_histograms(_blobs(some.column(5), BINS // 2))) * 9 <= n[fits] + m[fits]
        yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(near)), some.column(1).filter(pa.array(near))], names=["a", "b"])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y).sum(1, dtype=np.int64)


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, for sorted sets that aren't empty."""
    if 5 * min(len(s), len(t)) < 4 * max(len(s), len(t)):
        return False
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    both = int((t[at] == s).sum())
    return 100 * both >= 80 * (len(s) + len(t) - both)


def _verify(clashes: frozenset, bits: int):
    """Rows sorted by (a, cell, leader first): a leader's text, then those of its candidates; to the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, s = None, None
        for batch in batches:
            a, b = [], []
            node, member = (batch.column(k).to_pylist() for k in (0, 1))
            for x, y, t in zip(node, member, shingle_sets(batch.column(2).to_pylist())):
                own = x if y is None else y
                if int(_signed([_name(t, clashes, bits)[0]])[0]) != own:
                    continue  # another row with the same 64-bit hash
                if y is None:
                    leader, s = x, t
                elif leader != x:
                    raise RuntimeError("a leader's text is missing")
                elif linked(s, t):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, _I64), pa.array(b, _I64)], names=["a", "b"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows as one table per run of equal values of the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        if held and any(held[0].column(k)[0].as_py() != key[0, k] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            if held and lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(nearest: bool):
    """Rows sorted by (grp, i, j), a pair of tiles of a group, to pairs across components that may link.

    With ``nearest``, each node's nearest candidate only and, beside them, the group's number
    where others are left. Pairs are bounded in blocks, so memory stays the same whatever the
    group's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, gap, more, held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, gap)]
            m = len(cols[0])
            grp = pa.array([None] * m + more, _I64)
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays([pa.array(c, _I64), pa.nulls(len(more), _I64)]) for c in cols), grp], names=["a", "b", "gap", "grp"])

        for t in _runs(batches, 3):
            node, comp, n, tile = (t.column(c).to_numpy() for c in ("node", "comp", "n", "tile"))
            order = np.argsort(n, kind="stable")
            node, comp, n, tile = node[order], comp[order], n[order], tile[order]
            hist = _open_histograms(_blobs(t.column("hist"), BINS // 2))[order]
            across = tile.min() != tile.max()
            reach = np.searchsorted(n, 5 * n // 4, "right")  # sizes ascend: partners are a run
            step = max(1, BLOCK // len(n))
            x, y, far = [], [], []
            for lo in range(0, len(n), step):
                hi = min(lo + step, len(n))
                to = int(reach[hi - 1])
                ok = comp[lo:hi, None] != comp[None, lo:to]
                ok &= np.arange(lo, hi)[:, None] < np.arange(lo, to)[None, :]
                ok &= 5 * n[lo:hi, None] >= 4 * n[None, lo:to]
                if across:
                    ok &= tile[lo:hi, None] != tile[None, lo:to]
                i, j = np.nonzero(ok)
                if not len(i):
                    continue
                i, j = i + lo, j + lo
                d = _distances(hist[i], hist[j]) * 9 - n[i] - n[j]
                near = d <= 0
                x.append(i[near])
                y.append(j[near])
                far.append(d[near] * 1_000_000 // (n[i[near]] + n[j[near]]))
                if nearest and sum(map(len, x)) > BLOCK:
                    x, y, far = [[c] for c in _nearest_of(*map(np.concatenate, (x, y, far)))]
                    more.append(t.column(0)[0].as_py())
            if not x:
                continue
            x, y, far = map(np.concatenate, (x, y, far))
            if nearest:
                every = len(x)
                x, y, far = _nearest_of(x, y, far)
                if len(x) < every:
                    more.append(t.column(0)[0].as_py())
            a.append(np.minimum(node[x], node[y]))
            b.append(np.maximum(node[x], node[y]))
            gap.append(far)
            held += len(x)
            if held >= CHUNK:
                yield out()
                a, b, gap, more, held = [], [], [], [], 0
        if held:
            yield out()

    return run


def _nearest_of(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that are nearest for one of their ends."""
    end, at = np.concatenate([x, y]), np.tile(np.arange(len(x)), 2)
    order = np.lexsort((at, far[at], end))
    first = np.concatenate([[True], np.diff(end[order]) != 0])[: len(order)]
    keep = np.unique(at[order[first]])
    return x[keep], y[keep], far[keep]


class _Search:
    """The tables of one search and the steps that read them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, bits: int):
        self.width, self.bits = shuffle_width(docs.sparkSession), bits
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_hash(id_col, text_col), text_bytes(text_col).alias("body"))
        self.clashes: frozenset = frozenset()
        while True:
            signed = self.rows.mapInArrow(_write_signatures(self.width, self.clashes, bits), "bucket long, " + ", ".join(f"{c} binary" for c in _PACKED[1:]))
            dealt = signed.repartitionById(self.width, F.col("bucket").cast("int"))
            self.base = materialise(dealt.mapInArrow(_read_groups, _GROUP_TYPE), "groups")
            sets = self.base.filter(F.col("sets").isNotNull()).select("sets").mapInArrow(_read_sets, "node long, check long, n long, row_hash long, hist binary")
            best = sets.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most"), F.min(F.struct("row_hash", "n", "hist")).alias("s"))
            self.nodes = materialise(best.select("node", "s.*", (F.col("least") != F.col("most")).alias("clash")), "nodes")
            clashes = frozenset(int(r[0]) & (1 << 64) - 1 for r in self.nodes.filter("clash").select("node").limit(MOST_CLASHES + 1).collect())
            if not clashes:
                break
            if len(clashes) > MOST_CLASHES or clashes & self.clashes:
                raise RuntimeError("set names clash too often")
            self.clashes |= clashes
            discard(self.base, self.nodes)

    def ids(self) -> DataFrame:
        return self.base.filter(F.col("ids").isNotNull()).select("ids").mapInArrow(_read_ids, "doc_id long, n_shingles long, node long, row_hash long")

    def groups(self, *columns: str) -> DataFrame:
        return self.base.filter(F.col("members").isNotNull()).select(*columns)

    def allowed(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs whose sizes and histograms allow a link, each once."""
        told = lambda c: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"hist_{c}")).hint("merge")
        both = join_unskewed(join_unskewed(pairs, told("b"), "b"), told("a"), "a") if pairs.limit(1).count() else pairs.join(told("b"), "b").join(told("a"), "a")
        near = both.select("a", "b", "n_a", "hist_a", "n_b", "hist_b").mapInArrow(_may_link, "a long, b long")
        return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The (a, b) pairs that link: a leader's whole text meets those of its candidates in cells of bounded size."""
        some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        reps = materialise(self.nodes.join(some, "node").select("node", "row_hash"), "reps")
        asked, hit = flagged(self.rows.select("row_hash", "body"), F.col("row_hash"), reps, "row_hash")
        texts = asked.filter(hit).drop(hit).join(reps, "row_hash").withColumn("crc", F.crc32("body"))
        texts = materialise(texts.dropDuplicates(["node", "row_hash", "crc"]).select("node", "body"), "texts")
        written, texts = texts, texts.hint("merge")  # packed files say little about the memory that a broadcast takes
        heavy = [(k, -(-n // CELL)) for k, n in heavy_keys(pairs, "a", CELL)]
        cells = F.lit(1)
        if heavy:
            cells = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in heavy for v in kv)), F.col("a")), cells)
        celled = pairs.withColumn("cell", F.pmod(F.xxhash64("b"), cells).cast("int"))
        heads = celled.select("a", "cell").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "body", "cell")
        members = celled.join(texts.withColumnRenamed("node", "b"), "b").select("a", "b", "body", "cell")
        dealt = heads.union(members).repartition(self.width, "a", "cell").sortWithinPartitions("a", "cell", F.asc_nulls_first("b"))
        out = materialise(dealt.mapInArrow(_verify(self.clashes, self.bits), "a long, b long"), name)
        discard(reps, written)
        return out

    def opened(self, comp: DataFrame, some: DataFrame | None) -> DataFrame:
        """Tile pairs of the groups (of ``some``, if given) whose members are in several components, sorted within partitions."""
        listed = self.groups("grp", "chunk", "members").dropDuplicates(["grp", "chunk"]).select("grp", "members").mapInArrow(_list_members, "grp long, node long")
        listed = listed if some is None else listed.join(some, "grp", "left_semi")
        known = materialise(listed.join(comp, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("comp")), "known")
        several = known.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
        several = several.select("grp", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
        mine = join_unskewed(known, several, "grp") if known.limit(1).count() else known.join(several, "grp")
        told = mine.join(self.nodes.select("node", "n", "hist").hint("merge"), "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        told = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        told = told.select("grp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "comp", "n", "hist")
        out = told.repartition(self.width, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        out._reads = known
        return out


def _contract(comp: DataFrame, more: DataFrame) -> DataFrame:
    """Components after more links: those known are contracted first, so few links remain."""
    root = comp.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    ends = more.join(root.select(F.col("_n").alias("a"), F.col("_c").alias("ca")), "a", "left").join(root.select(F.col("_n").alias("b"), F.col("_c").alias("cb")), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    joined = components(ends).select(F.col("node").alias("component"), F.col("component").alias("upper"))
    again = comp.join(joined, "component", "left").select("node", F.coalesce("upper", "component").alias("component"))
    fresh = joined.select(F.col("component").alias("node"), F.col("upper").alias("component")).join(comp, "node", "left_anti")
    return materialise(again.union(fresh), "components")


def _row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), text_bytes(text_col)).alias("row_hash")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest identifier reachable by links).

    Null and empty texts have no shingles and are alone: their component is their own
    identifier. Null identifiers come after all others: such a row joins its component but
    names it only if every identifier there is null (then it is null). Repeated rows are one
    node and a row each. Very long texts are hashed in blocks. Other columns of ``docs``,
    whatever their names, aren't read. An empty table gives an empty table.
    """
    return _components_of(docs, id_col, text_col).drop("row_hash")


def _components_of(docs: DataFrame, id_col: str, text_col: str, name_bits: int = 64) -> DataFrame:
    """``near_components``, with the row's hash."""
    prepare(docs.sparkSession, BATCH_BYTES)
    search = _Search(docs, id_col, text_col, name_bits)
    led = materialise(search.groups("leader", "members").mapInArrow(_leader_pairs, "a long, b long").distinct(), "led")
    first = materialise(search.allowed(led), "pairs")
    links = search.verified(first, "links")
    comp = materialise(components(links), "components")
    discard(led, links)

    tiles = search.opened(comp, None)
    found = materialise(tiles.mapInArrow(_open_pairs(True), "a long, b long, gap long, grp long"), "nearest")
    discard(tiles._reads)
    tested, left = first, found.filter("grp is not null").select("grp").distinct()
    fresh = found.filter("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    second = materialise(fresh, "pairs")
    if second.limit(1).count():
        more = search.verified(second, "links")
        comp, old = _contract(comp, more), comp
        discard(more, old)
    if left.limit(1).count():
        tiles = search.opened(comp, left)
        rest = tiles.mapInArrow(_open_pairs(False), "a long, b long, gap long, grp long").select("a", "b").distinct()
        third = materialise(rest.join(tested.union(second), ["a", "b"], "left_anti"), "pairs")
        discard(tiles._reads)
        if third.limit(1).count():
            more = search.verified(third, "links")
            comp, old = _contract(comp, more), comp
            discard(more, old)
        discard(third)
    discard(found, first, second)

    ids = materialise(search.ids(), "ids")
    discard(search.base, search.nodes)
    own = ids.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    known = materialise(own.join(comp, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(join_unskewed(known.select("node", "component"), least, "component").select("node", "component_id"), "named")
    discard(known, comp)
    out = join_unskewed(ids, named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component, and those without an identifier.

    Rows that share an identifier are judged each by its own text (a 64-bit hash tells them
    apart): one goes if a smaller identifier names its component, whatever the others do, and
    all stay that name theirs, near copies of each other and repeated rows included. The rows
    that go are written first: while they are few, whole rows aren't shuffled.
    """
    ids = _components_of(docs, id_col, text_col)
    gone = materialise(ids.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_hash")).distinct(), "gone")
    return without_rows(docs, gone, id_col, _row_hash(id_col, text_col))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
