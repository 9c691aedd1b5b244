"""Operator 6: character n-gram linear classifier with naive Bayes log-count ratios.

A text's features are the byte n-grams (lower-cased A-Z, orders ``ORDERS``) that occur in
it, hashed to ``2**BITS`` columns. Every column is scaled by its naive Bayes log-count
ratio between the two labels, and a logistic regression is fitted on the scaled columns,
so a weight departs from naive Bayes only where the labels ask for it. Columns whose
counts don't tell the labels apart (a likelihood-ratio test) carry no weight.

Training takes at most ``max_rows`` labelled rows, those with the smallest hashes of their
identifiers, so the sample is the same at every run. Scoring is one pass over whole texts;
the model (about 1 MB) goes with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import discard, materialise, prepare, table, text_bytes

ORDERS = (3, 4, 5)
BITS = 18
#: Most labelled rows that training reads.
MAX_ROWS = 6000
#: Regularisation: a column keeps a weight if telling the labels apart by it gains so much
#: log-likelihood over the labelled texts (about the 0.0005 level of a test). There is no other limit.
LEAST_GAIN = 6.0
#: Entries of the training matrix that a step of the regression takes at a time.
PART = 1 << 20
#: A text is cut in blocks of so many bytes (overlapping by an n-gram) to bound memory.
BLOCK = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def grams(text: bytes, most: int | None = None) -> np.ndarray:
    """Hash columns of all n-grams of the text (that start in its first ``most`` bytes), with repeats."""
    raw = np.frombuffer(text.translate(_LOWER), np.uint8)
    out = []
    for n in ORDERS:
        m = len(raw) - n + 1
        m = m if most is None else min(m, most)
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h *= np.uint32(0x01000193)
            h ^= raw[i : i + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class Model:
    """weights per column (0 for most), bias; score() gives the probability of label 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.used = self.weights != 0

    def margin(self, text: bytes) -> float:
        kept = []
        for at in range(0, max(1, len(text)), BLOCK):
            g = grams(text[at : at + BLOCK + max(ORDERS) - 1], BLOCK)
            kept.append(g[self.used[g]])
        g, times = np.unique(np.concatenate(kept), return_counts=True)
        return self.bias + float((self.weights[g] * np.log2(1 + times)).sum(dtype=np.float64))

    def score(self, text: bytes) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.margin(text), -40, 40))))


def _counted(text: bytes, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, times) of a text, block by block; with ``place``, of the columns that have one only, by place."""
    kept = []
    for at in range(0, max(1, len(text)), BLOCK):
        g = grams(text[at : at + BLOCK + max(ORDERS) - 1], BLOCK)
        if place is not None:
            g = place[g]
            g = g[g >= 0]
        kept.append(np.unique(g, return_counts=True))
    if len(kept) == 1:
        return kept[0]
    col, at = np.unique(np.concatenate([c for c, _ in kept]), return_inverse=True)
    return col, np.bincount(at, weights=np.concatenate([n for _, n in kept]), minlength=len(col)).astype(np.int64)


def choose(c0: np.ndarray, c1: np.ndarray, n0: float, n1: float) -> tuple[np.ndarray, np.ndarray]:
    """(columns that tell the labels apart, their log-count ratios) from texts per column and label."""
    p1, p0 = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
    every = (c1 + c0 + 0.5) / (n1 + n0 + 1)
    part = lambda c, n, p: c * np.log(p / every) + (n - c) * np.log((1 - p) / (1 - every))
    gain = part(c1, n1, p1) + part(c0, n0, p0)
    keep = np.flatnonzero(gain > LEAST_GAIN)
    return keep, np.log(p1 / p0)[keep]


def certain(n0: float, n1: float) -> Model:
    """The model of one label only, or of no rows: that label's rate."""
    rate = (n1 + 0.5) / (n0 + n1 + 1)
    return Model(np.zeros(1 << BITS), np.log(rate / (1 - rate)))


def train(texts: list[bytes], labels: list[int], l2: float = 8.0, steps: int = 300) -> Model:
    """Fit on a list of texts, as ``fit`` does on tables."""
    y = np.asarray(labels, np.float64)
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return certain(n0, n1)
    c = np.zeros((2, 1 << BITS))
    for t, label in zip(texts, labels):
        c[label][_counted(t, None)[0]] += 1
    keep, scale = choose(c[0], c[1], n0, n1)
    return regress([_counted(t, _places(keep)) for t in texts], y, keep, scale, l2, steps)


def _places(keep: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, np.int64)
    place[keep] = np.arange(len(keep))
    return place


def regress(found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, keep: np.ndarray, scale: np.ndarray, l2: float = 8.0, steps: int = 300) -> Model:
    """Logistic regression on the chosen columns, scaled by their ratios; both labels weigh alike."""
    n1, n0 = y.sum(), (1 - y).sum()
    row = np.repeat(np.arange(len(found), dtype=np.int32), [len(c) for c, _ in found])
    at = np.concatenate([c.astype(np.int32, copy=False) for c, _ in found])
    x = np.concatenate([(scale[c] * np.log2(1 + k)).astype(np.float32) for c, k in found])
    parts = [slice(lo, lo + PART) for lo in range(0, len(x), PART)]  # so that nothing else of this length is held
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    w, b = np.zeros(len(keep)), 0.0
    mw, vw, mb, vb = np.zeros(len(keep)), np.zeros(len(keep)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + sum((np.bincount(row[p], weights=x[p] * w[at[p]], minlength=len(y)) for p in parts), np.zeros(len(y)))
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = sum((np.bincount(at[p], weights=x[p] * g[row[p]], minlength=len(keep)) for p in parts), np.zeros(len(keep))) / len(y) + l2 * w / len(y)
        gb = g.mean()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.05 / (1 + t / 100)
        w -= step * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(1 << BITS)
    full[keep] = w * scale
    return Model(full, b)


def fold(ident: Column) -> Column:
    """crc32 of the identifier as text, mod 3; null for a null identifier."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(3)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Train on labelled rows outside the held-out fold; labels other than 0 and 1 are left out.

    Several labels of one identifier count once, as the largest.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 1))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("y"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body"))
    prepare(docs.sparkSession)
    # at most max_rows rows of two integers: a proven bound
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = materialise(joined.select("doc_id", F.xxhash64("body").alias("tag"), F.col("y").cast("int").alias("y"), "body"), "labelled")
    n0, n1 = rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not n0 or not n1:
        return certain(n0, n1)
    c = np.zeros((2, 1 << BITS))
    told = rows.select("y", "body").mapInArrow(_columns, "g int, zero int, one int").groupBy("g").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()  # 2**BITS rows at most
    for label, name in enumerate(("zero", "one")):
        c[label, told["g"].to_numpy()] = told[name].to_numpy()
    del told
    keep, scale = choose(c[0], c[1], n0, n1)
    got = sorted((r[0], r[1], r[2], bytes(r[3]), bytes(r[4])) for r in rows.mapInArrow(_chosen(keep), "doc_id long, tag long, y int, at binary, n binary").toLocalIterator())
    discard(rows)
    found = [(np.frombuffer(a, np.int32), np.frombuffer(n, np.int32)) for *_, a, n in got]
    return regress(found, np.array([r[2] for r in got], np.float64), keep, scale)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, body) to texts per column and label, added up in the task."""
    c = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for y, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            c[y][_counted(body.as_py(), None)[0]] += 1
    some = np.flatnonzero(c.any(0))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (some, c[0, some], c[1, some])], names=["g", "zero", "one"])


def _chosen(keep: np.ndarray):
    """Labelled texts to their chosen columns: each column once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(keep)
        for batch in batches:
            found = [_counted(b.as_py(), place) for b in batch.column(3)]
            blobs = [pa.array([f[k].astype(np.int32).tobytes() for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), *blobs], names=["doc_id", "tag", "y", "at", "n"])

    return run


def texts_of(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The texts of a batch of (row) or (row, body), as bytes with null for null."""
    return batch.column(1) if batch.num_columns > 1 else pc.struct_field(batch.column(0), text_col).cast(pa.binary())


def rows_with_texts(docs: DataFrame, text_col: str, carried: list[str] | None) -> DataFrame:
    """(row) of all columns, or (row, body) where the carried ones leave the text out: a text travels once."""
    if carried is None:
        return docs.select(F.struct("*").alias("row"))
    return docs.select(F.struct(*carried).alias("row"), text_bytes(text_col).alias("body"))


def _scorer(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([model.score(b.as_py() or b"") for b in texts_of(batch, text_col)], np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), batch.column(0)], names=["score", "row"])

    return run


def score_rows(docs: DataFrame, model: Model, text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """docs to (score, row), where row holds the ``carried`` columns, all by default.

    Every row is scored on its own: null and empty texts get the model's bias alone, repeated
    rows get the same score, very long texts go block by block, and other columns pass in
    ``row`` whatever their names. An empty table stays empty.
    """
    prepare(docs.sparkSession)
    rows = rows_with_texts(docs, text_col, carried)
    return rows.mapInArrow(_scorer(model, text_col), f"score double, row {rows.schema['row'].dataType.simpleString()}")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_rows(docs, model, carried=["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(fold(F.col("row.doc_id")) == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
    )
