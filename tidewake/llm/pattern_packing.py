"""Operator 3: best-fit packing by patterns from non-negative least squares.

1. Documents become ids; longer ones than a sequence are cut. Pieces (a few numbers each)
   go to a table in the shared folder.
2. The histogram of piece lengths has at most ``size`` rows, whatever the corpus, so it
   goes to the driver, which enumerates all patterns of two and three lengths that fill a
   sequence, fits how often each should be used (min |A x - h|, x >= 0), rounds within
   what the histogram holds and packs the rest best-fit decreasing, all in counts.
3. The plan says, for the r-th piece of each length, its sequence and place. Ranks are
   built without gathering a length in one task: pieces are numbered inside (length,
   bucket) groups, and buckets are offset by prefix sums over their counts.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import materialise, prepare, shuffle_width, table
from tidewake.llm.tokens import END, cut, document_ids

SIZE = 1024
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def patterns(size: int) -> np.ndarray:
    """All multisets of two or three lengths that fill a sequence; a 0 stands for no third."""
    out = [np.array([(a, size - a, 0) for a in range(1, size // 2 + 1)], np.int64).reshape(-1, 3)]
    for a in range(1, size // 3 + 1):
        b = np.arange(a, (size - a) // 2 + 1)
        out.append(np.stack([np.full(len(b), a), b, size - a - b], 1))
    return np.concatenate(out)


def fit_counts(hist: np.ndarray, pats: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram, by accelerated projected gradients."""
    live = (hist[pats] > 0) | (pats == 0)
    chosen = np.flatnonzero(live.all(1))
    p = pats[chosen]
    x = np.zeros(len(pats))
    if not len(p):
        return x
    used = p > 0
    h = hist.astype(np.float64).copy()
    h[0] = 0
    scale = h.max()
    b = h / scale
    forward = lambda v: np.bincount(p[used], weights=np.repeat(v, 3).reshape(-1, 3)[used], minlength=len(h))
    back = lambda r: np.where(used, r[p], 0).sum(1)
    v = np.ones(len(p))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    y = z = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        y_next = np.maximum(0, z - back(forward(z) - b) / (1.02 * top))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = y_next + (t - 1) / t_next * (y_next - y)
        y, t = y_next, t_next
    x[chosen] = y * scale
    return x


def best_fit_counts(left: dict[int, int], size: int) -> Counter:
    """Best-fit decreasing on counts: (lengths of a sequence) to how many sequences of that kind."""
    open_bins: dict[int, Counter] = defaultdict(Counter)  # space left -> contents -> sequences
    for length in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[length]
        while n:
            space = min((s for s, bins in open_bins.items() if s >= length and bins), default=None)
            if space is None:
                fits = size // length
                full, rest = divmod(n, fits)
                if full:
                    open_bins[size - fits * length][(length,) * fits] += full
                if rest:
                    open_bins[size - rest * length][(length,) * rest] += 1
                break
            contents, have = next(iter(open_bins[space].items()))
            take = min(n, have)
            each = min(space // length, n // take)  # the tightest sequences fill up first
            open_bins[space][contents] -= take
            if not open_bins[space][contents]:
                del open_bins[space][contents]
            open_bins[space - each * length][contents + (length,) * each] += take
            n -= take * each
    out: Counter = Counter()
    for bins in open_bins.values():
        out.update(bins)
    return out


def plan_sequences(hist: dict[int, int], size: int = SIZE) -> Counter:
    """Kinds of sequences (tuples of lengths) and how many of each; uses each piece once."""
    out: Counter = Counter()
    if hist.get(size):
        out[(size,)] = hist[size]
    h = np.zeros(size + 1, np.int64)
    for length, n in hist.items():
        if 0 < length < size:
            h[length] = n
    pats = patterns(size)
    x = fit_counts(h, pats)
    left = h.copy()
    for j in np.argsort(-x, kind="stable"):
        n = int(x[j] + 0.5)
        if not n:
            break
        kind = tuple(int(v) for v in pats[j] if v)
        need = Counter(kind)
        n = min([n, *(int(left[k]) // m for k, m in need.items())])
        if n > 0:
            out[kind] += n
            for k, m in need.items():
                left[k] -= n * m
    out.update(best_fit_counts({i: int(n) for i, n in enumerate(left) if n}, size))
    return out


class Slots:
    """Per length, sorted by first rank: first rank, first sequence, place. For lookups by rank."""

    def __init__(self, plan: Counter):
        rows = defaultdict(list)
        used: Counter = Counter()
        sequence = 0
        for kind, n in sorted(plan.items(), key=lambda kv: (-kv[1], kv[0])):
            at = 0
            for length in kind:
                rows[length].append((used[length], sequence, at))
                used[length] += n
                at += length
            sequence += n
        self.sequences = sequence
        self.of = {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            first, base, at = self.of[int(n)]
            here = length == n
            k = np.searchsorted(first, rank[here], "right") - 1
            sequence[here] = base[k] + rank[here] - first[k]
            offset[here] = at[k]
        return sequence, offset


def _cutter(size: int, path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = document_ids(text.as_py(), path, end)
                for i, (at, n) in enumerate(cut(len(ids), size)):
                    out.append((doc_id, i, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placer(slots: Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = slots.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Null identifiers, repeated identifiers and
    repeated rows are packed like others, each row once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_cutter(size, vocabulary, end), _PIECES), "pieces")
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    slots = Slots(plan_sequences(hist, size))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_width(spark)))
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("inside", inside).join(offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside")).cast("long").alias("rank"))
    return ranked.mapInArrow(_placer(slots), _PIECES + ", sequence_id long, offset long")


def op3_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
