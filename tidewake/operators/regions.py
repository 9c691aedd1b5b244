"""Detections over tables of lines: connected bright regions across stripes, and suppression by rounds.

A line is (raster, y, pixels): one row of an image, 0..255. No task holds more than the runs of one
stripe, so an image has no largest size, and results don't depend on the height of stripes. Lines
whose raster, y or pixels are null are left out; a pixel that is null is dark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.params import DEFAULT, Params
from tidewake.session import stable

#: Local regions of a stripe are numbered below this, so stripe and number make one identifier.
_PER_STRIPE = 1 << 31
#: Width of the blocks in which the runs on both sides of a seam meet.
_SEAM_BLOCK = 512


def bright_runs(lines: DataFrame, level: int = 200) -> DataFrame:
    """Lines to (raster, y, x1, x2, total): the maximal runs of pixels of at least ``level``, half-open, with their sum."""
    kind = lines.schema["raster"].dataType.simpleString()

    def run(batches):
        for b in batches:
            parts = []
            for raster, y, pixels in zip(b["raster"], b["y"], b["pixels"]):
                v = np.nan_to_num(np.asarray(pixels, np.float64), nan=-1.0)
                edge = np.diff((v >= level).astype(np.int8), prepend=0, append=0)
                x1, x2 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                sums = np.concatenate([[0.0], np.cumsum(v)])
                parts.append(pd.DataFrame({"raster": raster, "y": y, "x1": x1, "x2": x2, "total": sums[x2] - sums[x1]}))
            if parts:
                yield pd.concat(parts)

    known = lines.select("raster", F.col("y").cast("long").alias("y"), "pixels").dropna()
    return known.mapInPandas(run, f"raster {kind}, y long, x1 long, x2 long, total double")


def _joined_runs(y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the connected sets of runs, which are in the order of (y, x1)."""
    y = y - y.min()
    wide = int(x2.max()) + 1
    first = np.searchsorted(y * wide + x2, (y + 1) * wide + x1, "right")
    last = np.searchsorted(y * wide + x1, (y + 1) * wide + x2, "left")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    label = np.arange(len(y))
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    return np.unique(label, return_inverse=True)[1]


def stripe_regions(runs: DataFrame, rows: int = 2048) -> DataFrame:
    """Runs to the connected regions of each stripe of ``rows`` lines.

    (raster, region, x1, y1, x2, y2, n, total) and, for the seams, what the region has on the
    stripe's first line (head_at, head_to) and last line (foot_at, foot_to).
    """
    kind = runs.schema["raster"].dataType.simpleString()
    ends = ("head_at", "head_to", "foot_at", "foot_to")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x1"])
        stripe = int(pdf["_stripe"].iloc[0])
        pdf["k"] = _joined_runs(*(pdf[c].to_numpy() for c in ("y", "x1", "x2")))
        pdf["n"] = pdf["x2"] - pdf["x1"]
        out = pdf.groupby("k").agg(x1=("x1", "min"), y1=("y", "min"), x2=("x2", "max"), y2=("y", "max"), n=("n", "sum"), total=("total", "sum"))
        out["y2"] += 1
        for y, (at, to) in ((stripe * rows, ends[:2]), ((stripe + 1) * rows - 1, ends[2:])):
            met = pdf[pdf["y"] == y].groupby("k").agg(**{at: ("x1", list), to: ("x2", list)})
            for c in (at, to):
                out[c] = met[c].reindex(out.index)
                out[c] = out[c].map(lambda v: v if isinstance(v, list) else [])
        out.insert(0, "raster", pdf["raster"].iloc[0])
        out.insert(1, "region", stripe * _PER_STRIPE + out.index.to_numpy())
        return out

    schema = f"raster {kind}, region long, x1 long, y1 long, x2 long, y2 long, n long, total double, " + ", ".join(f"{c} array<long>" for c in ends)
    return runs.withColumn("_stripe", F.floor(F.col("y") / rows).cast("long")).groupBy("raster", "_stripe").applyInPandas(label, schema)


def _seam_edges(regions: DataFrame) -> DataFrame:
    """(raster, u, v): regions on both sides of a seam with a column in common, u above v."""

    def side(at: str, to: str, name: str, step: int) -> DataFrame:
        out = regions.select("raster", F.col("region").alias(name), (F.floor(F.col("region") / _PER_STRIPE) + step).cast("long").alias("_seam"), F.explode(F.arrays_zip(at, to)).alias("r"))
        block = lambda c: F.floor(c / _SEAM_BLOCK).cast("long")
        out = out.select("raster", name, "_seam", F.col(f"r.{at}").alias(f"{name}1"), F.col(f"r.{to}").alias(f"{name}2"))
        return out.withColumn("_block", F.explode(F.sequence(block(F.col(f"{name}1")), block(F.col(f"{name}2") - 1))))

    met = side("foot_at", "foot_to", "u", 1).join(side("head_at", "head_to", "v", 0), ["raster", "_seam", "_block"])
    return met.filter("u1 < v2 AND v1 < u2").select("raster", "u", "v").distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """(raster, v, u): every node that isn't the smallest of its component, with the smallest; edges have u < v.

    Alternating stars: neighbours above a node are tied to the least node around it, then
    those below. The number of rounds grows with the logarithm of a component's nodes.
    """
    state = None
    while True:
        both = edges.unionByName(edges.select("raster", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("raster", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, ["raster", "u"]).select("raster", F.col("m").alias("u"), "v").distinct()
        down = large.groupBy("raster", "v").agg(F.min("u").alias("m"))
        tied = large.join(down, ["raster", "v"])
        lower = tied.filter("u <> m").select("raster", F.col("m").alias("u"), F.col("u").alias("v"))
        edges = stable(lower.unionByName(down.select("raster", F.col("m").alias("u"), "v")).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("raster", "u", "v"))).first()
        if now == state:
            return edges
        state = now


def bright_regions(lines: DataFrame, level: int = 200, least_px: int = 4, rows: int = 2048) -> DataFrame:
    """(raster, x1, y1, x2, y2, n, confidence): boxes of connected bright pixels (by sides) with their mean brightness.

    A region that seams cut is one box. Regions are found stripe by stripe; those that touch over
    a seam are united by rounds over the table of touching pairs, and boxes and sums added up.
    """
    parts = stable(stripe_regions(bright_runs(lines, level), rows))
    roots = _roots(stable(_seam_edges(parts)))
    named = parts.join(roots.select("raster", F.col("v").alias("region"), F.col("u").alias("_root")), ["raster", "region"], "left")
    whole = named.groupBy("raster", F.coalesce("_root", "region").alias("_root")).agg(
        *(F.min(c).cast("double").alias(c) for c in ("x1", "y1")), *(F.max(c).cast("double").alias(c) for c in ("x2", "y2")), F.sum("n").alias("n"), F.sum("total").alias("_total")
    )
    return whole.filter(F.col("n") >= least_px).select("raster", "x1", "y1", "x2", "y2", "n", (F.col("_total") / F.col("n") / 255.0).alias("confidence"))


def _near(iou_threshold: float, min_px: float) -> str:
    """Whether boxes a and b exclude each other, as SQL text."""
    w, h = ("greatest(least(a.{1}, b.{1}) - greatest(a.{0}, b.{0}), 0d)".format(*c) for c in (("x1", "x2"), ("y1", "y2")))
    areas = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"
    gap = "sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2))"
    return f"({w} * {h} > 0 AND {w} * {h} / nullif({areas} - {w} * {h}, 0d) >= {iou_threshold}d OR {gap} < {min_px}d)"


def _cells(boxes: DataFrame, iou_threshold: float, min_px: float, around: bool) -> DataFrame:
    """Boxes by the cells in which those that exclude each other meet, with the cells around on request.

    Kind -1 is a grid of ``min_px`` for centres. Boxes whose overlap passes have sides within the
    threshold of each other, so they meet at the grid of the smaller one's size.
    """
    size = F.floor(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1.0)))).cast("int")
    span = math.ceil(math.log2(1 / iou_threshold))
    kinds = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(size - span, size), lambda k: k >= 0))
    out = boxes.withColumn("_size", size).withColumn("_kind", F.explode(kinds))
    side = F.when(F.col("_kind") < 0, F.lit(max(float(min_px), 1.0))).otherwise(F.pow(F.lit(2.0), F.col("_kind") + 1) / iou_threshold)
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / side).cast("long")
    out = out.withColumn("_cx", cell("x1", "x2")).withColumn("_cy", cell("y1", "y2"))
    if around:
        for c in ("_cx", "_cy"):
            out = out.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return out


def suppress_by_rounds(boxes: DataFrame, group: str = "scene_id", iou_threshold: float | None = None, min_px: float | None = None, p: Params = DEFAULT) -> DataFrame:
    """Non-maximum suppression of (group, x1, y1, x2, y2, confidence) boxes without a task that holds a scene.

    The result is the walk's from the most confident box on: a box goes when it overlaps a kept
    one by ``iou_threshold`` or its centre is nearer than ``min_px``. Ties of confidence go to the
    smaller y1, x1, y2, x2; equal rows count once; a row with a null or a number that isn't finite is left out.

    A round's candidates are the best living boxes of cells of half ``min_px``, where two centres
    exclude each other; one that is better than everything alive that it excludes is kept, as the
    walk would, and takes that away. So a pile of boxes is met by a few candidates, not by itself.
    """
    t, near_px = p.iou_threshold if iou_threshold is None else iou_threshold, p.min_separation_m / p.pixel_m if min_px is None else min_px
    cols = [group, "x1", "y1", "x2", "y2", "confidence"]
    rank = F.struct((-F.col("confidence")).alias("c"), "y1", "x1", "y2", "x2")
    finite = boxes.select(group, *(F.col(c).cast("double").alias(c) for c in cols[1:])).dropna()
    for c in cols[1:]:
        finite = finite.filter(F.abs(F.col(c)) < float("inf"))
    alive = stable(finite.distinct().withColumn("_rank", rank))
    tiny = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / (max(near_px, 1.0) / 2)).cast("long")
    kept = None
    while True:
        best = alive.groupBy(group, tiny("x1", "x2").alias("_tx"), tiny("y1", "y2").alias("_ty")).agg(F.min(F.struct("_rank", *cols[1:])).alias("b"))
        best = best.select(group, "b.*")
        a, b = _cells(best, t, near_px, True).alias("a"), _cells(alive, t, near_px, False).alias("b")
        keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (group, "_kind", "_cx", "_cy")]
        owner = F.expr("a._kind < 0 OR least(a._size, b._size) = a._kind")
        met = a.join(b, keys).filter(owner & F.expr(_near(t, near_px)))
        pairs = stable(met.select(F.col(f"a.{group}").alias(group), F.col("a._rank").alias("_rank"), F.col("b._rank").alias("_other")))
        won = stable(pairs.groupBy(group, "_rank").agg(F.min("_other").alias("_least")).filter("_least = _rank").select(group, "_rank"))
        taken = stable(alive.join(won, [group, "_rank"]).select(*cols))
        kept = taken if kept is None else kept.unionByName(taken)
        gone = pairs.join(won, [group, "_rank"]).select(group, F.col("_other").alias("_rank")).distinct()
        alive = stable(alive.join(gone, [group, "_rank"], "left_anti"))
        if alive.isEmpty():
            return kept
