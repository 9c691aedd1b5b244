"""Operator 12: hard negatives by blocked dense products.

Rows are packed into blocks of whole-number vectors once. Anchors, a stated set of queries,
are packed into blocks too, and a bounded number of anchor blocks at a time is broadcast
against the candidate blocks, so candidates are scanned and never shuffled. The product of an
anchor block and a candidate block is a matrix product in float64, exact while sums stay
below 2^53 (which every pair of blocks is tested for; others are multiplied in whole numbers).

* First pass: per anchor the best ``POSITIVES`` other rows of its label. A task keeps that many
  per anchor, whatever it scans; the tasks' lists merge by rank.
* Second pass: per anchor and positive score the best ``NEGATIVES`` rows of other labels whose
  score lies in the window that the positive's score spans. Lists merge as before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import materialise, prepare, table

POSITIVES = 5
NEGATIVES = 3
#: A negative scores between these percentages of its positive's score.
WINDOW = (50, 95)
SCALE = 256
#: Rows and bytes of a block.
BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20
#: Bytes of anchor blocks that are broadcast at a time.
BROADCAST_BYTES = 32 << 20

_EXACT = 2.0**53
_MOST = np.iinfo(np.int64).max
_LEAST = -_MOST  # no score: below all others, and can be negated
_BLOCK = "first long, dims int, ids binary, labels binary, vectors binary"
_HIT = "anchor long, slot int, score long, row long, id long"


def _block(first: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple:
    return first, x.shape[1], ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), np.ascontiguousarray(x, np.float64).tobytes()


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["first", "dims", "ids", "labels", "vectors"])


def _open(ids: bytes, labels: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.float64).reshape(len(ids), dims)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, id, label, vector) to blocks; a row's number is its partition's and its place there."""
    place = 0
    for batch in batches:
        for dims in sorted(set(batch.column(3).value_lengths().to_pylist())):
            own = batch.filter(pa.array(batch.column(3).value_lengths().to_numpy() == dims))
            x = np.floor(own.column(3).flatten().to_numpy().reshape(own.num_rows, dims) * SCALE)
            order = np.argsort(own.column(1).to_numpy(), kind="stable")  # by identifier, so that the first of equal scores is the smallest
            ids, labels, x = own.column(1).to_numpy()[order], own.column(2).to_numpy()[order], x[order]
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8 * dims, 1)))
            part = own.column(0)[0].as_py() << 36
            for lo in range(0, len(ids), step):
                s = slice(lo, lo + step)
                yield _batch_of([_block(part + place, ids[s], labels[s], x[s])])
                place += len(ids[s])


def _queries(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of each block, one row each."""
        for batch in batches:
            for first, dims, ids, labels, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels, x = _open(ids, labels, vectors, dims)
                for i in np.flatnonzero(ids % every == 0).tolist():
                    row = _batch_of([_block(first + i, ids[i : i + 1], labels[i : i + 1], x[i : i + 1])])
                    yield row.append_column("id", pa.array(ids[i : i + 1]))

    return run


def _gather(key: tuple, t: pa.Table) -> pa.Table:
    """Anchors of one block, by label; vectors of different lengths are filled up with zeros."""
    dims = int(max(t["dims"].to_pylist(), default=0))
    x = np.zeros((t.num_rows, dims))
    for i, v in enumerate(t["vectors"].to_pylist()):
        v = np.frombuffer(v, np.float64)
        x[i, : len(v)] = v
    rows, ids, labels = t["first"].to_numpy(), *(np.frombuffer(b"".join(t[c].to_pylist()), np.int64) for c in ("ids", "labels"))
    o = np.lexsort((rows, labels))
    packed = [[key[0].as_py()], [dims], *([a.tobytes()] for a in (rows[o], ids[o], labels[o], x[o]))]
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, k) for c, k in zip(packed, kinds)], names=["a_block", "a_dims", "a_rows", "a_ids", "a_labels", "a_vectors"])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, as int64; exact, and held at the ends of int64 beyond it."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    most = max(dims, 1) * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, _LEAST + 1, _MOST).astype(np.int64)


class Best:
    """The best few (score, smaller identifier first) of what each slot was shown."""

    def __init__(self, slots: int, keep: int):
        self.score = np.full((slots, keep), _LEAST)
        self.row = np.full((slots, keep), -1)
        self.id = np.zeros((slots, keep), np.int64)

    def show(self, slots: np.ndarray, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """scores: slots x candidates, ``_LEAST`` where they don't count; identifiers ascend. ``scores`` is used up."""
        keep = self.score.shape[1]
        most = scores.max(1, initial=_LEAST)
        open_ = np.flatnonzero((most >= self.score[slots, -1]) & (most > _LEAST))
        if not len(open_):
            return
        slots, scores = slots[open_], scores[open_]
        at = np.arange(len(slots))
        new_score, new_row, new_id = [], [], []
        for _ in range(min(keep, scores.shape[1])):
            i = scores.argmax(1)  # the first of equal ones
            new_score.append(scores[at, i])
            new_row.append(np.where(new_score[-1] > _LEAST, rows[i], -1))
            new_id.append(ids[i])
            scores[at, i] = _LEAST
        score, row, ident = (np.concatenate([old[slots], np.stack(new, 1)], 1) for old, new in ((self.score, new_score), (self.row, new_row), (self.id, new_id)))
        order = np.lexsort((row, ident, -score), axis=1)[:, :keep]
        self.score[slots], self.row[slots], self.id[slots] = (np.take_along_axis(c, order, 1) for c in (score, row, ident))

    def table(self, anchors: np.ndarray) -> pa.RecordBatch:
        slot, _ = np.nonzero(self.row >= 0)
        has = self.row >= 0
        per = len(self.score) // max(len(anchors), 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchors[slot // per]), pa.array((slot % per).astype(np.int32)), pa.array(self.score[has]), pa.array(self.row[has]), pa.array(self.id[has])],
            names=["anchor", "slot", "score", "row", "id"],
        )


def _spread(labels: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(label, places) of each label."""
    kinds, which = np.unique(labels, return_inverse=True)
    order = np.argsort(which, kind="stable")
    return list(zip(kinds.tolist(), np.split(order, np.cumsum(np.bincount(which))[:-1])))


def _scan(per: int, keep: int, show: Callable):
    """Pairs of an anchor block and a candidate block to the best of each anchor's slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # the anchor blocks that are broadcast: bounded
        for batch in batches:
            for r in batch.to_pylist():
                if r["a_block"] not in held:
                    ids, labels, x = _open(r["a_ids"], r["a_labels"], r["a_vectors"], r["a_dims"])
                    held[r["a_block"]] = np.frombuffer(r["a_rows"], np.int64), labels, x, Best(len(ids) * per, keep)
                anchors, labels, x, best = held[r["a_block"]]
                ids, c_labels, c = _open(r["ids"], r["labels"], r["vectors"], r["dims"])
                show(best, (anchors, labels, x), (r["first"] + np.arange(len(ids)), ids, c_labels, c), r)
        for anchors, _, _, best in held.values():
            yield best.table(anchors)

    return run


def _show_positives(best: Best, anchor: tuple, candidate: tuple, _: dict) -> None:
    anchors, labels, x = anchor
    rows, ids, c_labels, c = candidate
    there = dict(_spread(c_labels))
    for label, own in _spread(labels):
        if label in there:
            other = there[label]
            for lo in range(0, len(own), 256):
                a = own[lo : lo + 256]
                s = product(x[a], c[other])
                s[anchors[a][:, None] == rows[other][None, :]] = _LEAST  # not itself
                best.show(a, s, rows[other], ids[other])


def _show_negatives(best: Best, anchor: tuple, candidate: tuple, r: dict) -> None:
    anchors, labels, x = anchor
    rows, ids, c_labels, c = candidate
    windows = np.frombuffer(r["windows"], np.int64).reshape(len(anchors), -1, 2)
    per = windows.shape[1]
    there = dict(_spread(c_labels))
    for lo in range(0, len(anchors), 256):
        own = np.arange(lo, min(lo + 256, len(anchors)))
        s = product(x[own], c)
        for label, a in _spread(labels[own]):
            if label in there:
                s[np.ix_(a, there[label])] = _LEAST
        for k in range(per):
            low, high = windows[own, k, 0][:, None], windows[own, k, 1][:, None]
            best.show(own * per + k, np.where((s >= low) & (s <= high), s, _LEAST), rows, ids)


def _windows(per: int, lo: int, hi: int):
    """Positive scores of the anchors of one block to whole-number windows, in the block's order."""

    def run(key: tuple, anchors: pa.Table, scores: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(anchors["a_rows"].to_pylist()), np.int64)
        at = {r: i for i, r in enumerate(rows.tolist())}
        out = np.empty((len(rows), per, 2), np.int64)
        out[:] = (1, 0)  # nothing lies in it
        for anchor, slot, p in zip(*(scores[c].to_pylist() for c in ("anchor", "slot", "score"))):
            out[at[anchor], slot] = -((-lo * p) // 100), hi * p // 100
        return pa.table({"w_block": pa.array([key[0].as_py()], pa.int32()), "windows": pa.array([out.tobytes()])})

    return run


def _best(hits: DataFrame, keep: int) -> DataFrame:
    """The tasks' lists merged: the best ``keep`` of each anchor's slot, with their rank."""
    rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50,
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block_rows: int = BLOCK_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Hard negatives of every anchor: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each component x counts as floor(256 * x); a row's score is its inner product with the
    anchor. Anchors are the rows whose identifier ``every`` divides. An anchor's positives are
    its best ``positives`` other rows of its label; each positive's negatives the best
    ``negatives`` rows of other labels that score ``window[0]`` to ``window[1]`` per cent of it.
    Ties go to the smaller identifier.

    Rows without identifier, label or vector, and vectors with a null or non-finite component,
    take no part. A shorter vector counts as filled up with zeros, an empty one scores 0 with
    all. Rows that repeat an identifier are rows of their own, each an anchor where it is one;
    rows with equal vectors tie. Scores beyond the range of a long are held at its ends. Labels
    are whole numbers. Very long vectors make smaller blocks. Extra columns aren't read. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    x = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & fine)
    rows = rows.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("vector"))
    blocks = materialise(rows.mapInArrow(_pack, _BLOCK), "blocks")

    single = materialise(blocks.mapInArrow(_queries(every), f"{_BLOCK}, id long"), "single")
    told = single.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    n, dims = told["n"], max(1, told["dims"] or 1)
    size = max(1, min(block_rows, BLOCK_BYTES // (8 * dims)))
    count = max(1, -(-n // size))
    dealt = single.withColumn("a_block", F.pmod(F.xxhash64("first"), F.lit(count)).cast("int"))
    anchors = materialise(dealt.groupBy("a_block").applyInArrow(_gather, "a_block int, a_dims int, a_rows binary, a_ids binary, a_labels binary, a_vectors binary"), "anchors")
    at_once = max(1, broadcast_bytes // (size * 8 * (dims + 2 * positives + 3)))

    def passed(queries: DataFrame, per: int, keep: int, show: Callable, name: str) -> DataFrame:
        found = None
        for lo in range(0, count, at_once):  # a bounded number of blocks is broadcast, then the next
            hi = min(count, lo + at_once) - 1
            pairs = blocks.withColumn("a_block", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).join(F.broadcast(queries.filter(F.col("a_block").between(lo, hi))), "a_block")
            hits = materialise(pairs.mapInArrow(_scan(per, keep, show), _HIT), name)
            found = hits if found is None else found.union(hits)
        return materialise(_best(found, keep), f"{name}-best")

    best = passed(anchors, 1, positives, _show_positives, "positives")
    ranked = best.select("anchor", (F.col("rank") - 1).cast("int").alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    owner = F.pmod(F.xxhash64("anchor"), F.lit(count)).cast("int")
    spans = ranked.select(owner.alias("a_block"), "anchor", "slot", F.col("positive_score").alias("score"))
    windows = anchors.select("a_block", "a_rows").groupBy("a_block").cogroup(spans.groupBy("a_block")).applyInArrow(_windows(positives, *window), "w_block int, windows binary")
    queries = materialise(anchors.join(windows, F.col("a_block") == F.col("w_block")).drop("w_block"), "queries")
    negative = passed(queries, positives, negatives, _show_negatives, "negatives")
    names = single.select(F.col("first").alias("anchor"), F.col("id").alias("anchor_id"))
    out = negative.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(ranked, ["anchor", "slot"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


#: All pairs of anchors and rows, ranked.
OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
