"""Operator 5: quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades; the grades differ by ordered
thresholds only: P(grade <= k) = sigmoid(threshold[k] - w . x). A text's features are its
hashed words and its three-byte runs of character classes (case, digits, punctuation,
white space), so shouting, symbol junk and boilerplate show beside the vocabulary. The
model gives the expected grade and the probability of the grades from ``tail_from`` on,
by which documents are selected.

Training takes at most ``max_rows`` rated rows, those with the smallest hashes of their
identifiers; scoring covers whole texts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import prepare, table, text_bytes
from tidewake.llm.shingles import BLOCK, long_words
from tidewake.llm.toxicity import fold, rows_with_texts, texts_of

WORD_BITS = 16
MAX_ROWS = 4000
#: Probability of the upper grades from which a document is kept.
KEEP_FROM = 0.5

_WORDS = 1 << WORD_BITS
_CLASSES = 32


def _class_table() -> np.ndarray:
    """Character classes: lower case, upper case, digit, other bytes, then white space and common punctuation."""
    t = np.full(256, 3, np.uint16)
    t[ord("a") : ord("z") + 1] = 0
    t[ord("A") : ord("Z") + 1] = 1
    t[ord("0") : ord("9") + 1] = 2
    t[128:] = 0
    for i, c in enumerate(b" \n\t.,;:!?'\"-*#$%&@|/\\()[]<>"):
        t[c] = 4 + i % (_CLASSES - 4)
    return t


_CLASS = _class_table()
WIDTH = _WORDS + _CLASSES**3


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values): words by log count and classes by root share, each of unit length.

    Long texts go block by block: words are cut at white space, runs that straddle a block
    count in the block where they start, so blocks don't show.
    """
    runs = np.zeros(_CLASSES**3)
    for at in range(0, len(text), BLOCK):
        c = _CLASS[np.frombuffer(text[at : at + BLOCK + 2], np.uint8)]
        if len(c) > 2:
            runs += np.bincount(c[:-2] * np.uint16(_CLASSES * _CLASSES) + c[1:-1] * np.uint16(_CLASSES) + c[2:], minlength=_CLASSES**3)
    col, n = np.unique(long_words(text) >> np.uint64(64 - WORD_BITS) if text else np.empty(0, np.uint64), return_counts=True)
    v = np.log1p(n)
    at = np.flatnonzero(runs)
    r = np.sqrt(runs[at] / max(1, runs.sum()))
    v = v / (np.linalg.norm(v) or 1)
    return np.concatenate([col.astype(np.int64), _WORDS + at]), np.concatenate([v, r])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class OrdinalModel:
    """weights, ascending thresholds and the grades between them."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[float]):
        self.weights, self.thresholds, self.grades = weights.astype(np.float32), thresholds, grades

    def grade_probs(self, text: bytes) -> np.ndarray:
        col, v = features(text)
        z = float(self.weights[col] @ v)
        upto = np.concatenate([[0.0], _sigmoid(self.thresholds - z), [1.0]])
        return np.diff(upto)

    def score(self, text: bytes, tail_from: int | None = None) -> tuple[float, float]:
        """(expected grade, probability of the grades from place ``tail_from`` on; the last by default)."""
        p = self.grade_probs(text)
        k = len(p) - 1 if tail_from is None else tail_from
        return float(p @ np.array(self.grades)), float(p[k:].sum())


def train(texts: list[bytes], ratings: list[float], l2: float = 1e-4, steps: int = 200) -> OrdinalModel:
    """``train_on`` the features of texts."""
    return train_on([features(t) for t in texts], ratings, l2, steps)


def train_on(found: list[tuple[np.ndarray, np.ndarray]], ratings: list[float], l2: float = 1e-4, steps: int = 200) -> OrdinalModel:
    """Fit by accelerated gradient steps on the log-likelihood. One grade only: it is certain."""
    grades = sorted(set(ratings))
    if len(grades) < 2:
        return OrdinalModel(np.zeros(WIDTH), np.empty(0), [float(g) for g in grades] or [0.0])
    y = np.array([grades.index(r) for r in ratings])
    row = np.repeat(np.arange(len(found)), [len(c) for c, _ in found]).astype(np.int32)
    cols, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    x = np.concatenate([v for _, v in found])
    k, n = len(grades) - 1, len(y)
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n
    # thresholds as a start and positive steps keep their order
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    w = np.zeros(len(cols))
    mw, vw, mt, vt = np.zeros(len(cols)), np.zeros(len(cols)), np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(row, weights=x * w[at], minlength=n)
        upper = np.where(y < k, _sigmoid(theta[np.minimum(y, k - 1)] - z), 1.0)
        lower = np.where(y > 0, _sigmoid(theta[np.maximum(y - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) * (y < k) / p, lower * (1 - lower) * (y > 0) / p
        gz = (du - dl) / n
        gw = np.bincount(at, weights=x * gz[row], minlength=len(cols)) + l2 * w
        gt = -np.bincount(np.minimum(y, k - 1), weights=du, minlength=k) / n + np.bincount(np.maximum(y - 1, 0), weights=dl, minlength=k) / n
        gf = np.cumsum(gt[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mt, vt = 0.9 * mt + 0.1 * gf, 0.999 * vt + 0.001 * gf * gf
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.2 * (mw / a) / (np.sqrt(vw / b) + 1e-8) / (1 + t / 40)
        free -= 0.05 * (mt / a) / (np.sqrt(vt / b) + 1e-8)
    full = np.zeros(WIDTH)
    full[cols] = w
    return OrdinalModel(full, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])), [float(g) for g in grades])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rating_col: str = "quality", max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Train on rated rows outside the held-out fold; null ratings are left out, several of one row count as the least."""
    known = labels.filter(F.col(rating_col).isNotNull() & (fold(F.col(id_col)) != 1))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.min(rating_col).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body"))
    # at most max_rows rows of two numbers: a proven bound
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", F.xxhash64("body").alias("tag"), "y", "body")
    prepare(docs.sparkSession)
    got = sorted((r[0], r[1], r[2], bytes(r[3]), bytes(r[4])) for r in rows.mapInArrow(_featured, "doc_id long, tag long, y double, col binary, v binary").toLocalIterator())
    return train_on([(np.frombuffer(c, np.int64), np.frombuffer(v, np.float64)) for *_, c, v in got], [r[2] for r in got])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rated texts to their features: what goes to the driver is bounded by the model's width, not by texts."""
    for batch in batches:
        found = [features(b.as_py()) for b in batch.column(3)]
        blobs = [pa.array([f[k].astype(kind).tobytes() for f in found], pa.binary()) for k, kind in ((0, np.int64), (1, np.float64))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), *blobs], names=["doc_id", "tag", "y", "col", "v"])


def _scorer(model: OrdinalModel, tail_from: int | None, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([model.score(b.as_py() or b"", tail_from) for b in texts_of(batch, text_col)], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), batch.column(0)], names=["expected_grade", "tail_prob", "row"])

    return run


def grade_rows(docs: DataFrame, model: OrdinalModel, text_col: str = "text", tail_from: int | None = None, carried: list[str] | None = None) -> DataFrame:
    """docs to (expected_grade, tail_prob, row), where row holds the ``carried`` columns, all by default.

    Every row is graded on its own: null texts are empty, repeated rows get the same grade,
    very long texts go block by block, and other columns pass in ``row`` whatever their names.
    Without labels the grade is 0 and certain. An empty table stays empty.
    """
    prepare(docs.sparkSession)
    rows = rows_with_texts(docs, text_col, carried)
    return rows.mapInArrow(_scorer(model, tail_from, text_col), f"expected_grade double, tail_prob double, row {rows.schema['row'].dataType.simpleString()}")


def op5_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = grade_rows(docs, fit(docs, table(spark, sf_dir, "labels")), carried=["doc_id"])
    return graded.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(fold(F.col("row.doc_id")) == 1, F.lit(False)).alias("held_out"),
        "expected_grade", "tail_prob", (F.col("tail_prob") >= KEEP_FROM).alias("kept"),
    )
