"""Overlay of polygons: union as an aggregate, intersection as a function over batches.

Both cut the plane in vertical slabs at every corner and crossing. Inside a slab no two edges
cross, so the edges in order of height tell, by the even-odd rule of each polygon, where a
result begins and ends. A result is a set of trapezoids that don't overlap: their area adds
up, and they are polygons again for a next step. Edges are straight in degrees; concave
rings, holes, several parts and rings that cross themselves need nothing special.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.session import ship_package

#: Polygons of a group that the first step of a union takes at once.
FIRST = 64
#: Slabs narrower than so many degrees are rounding.
_NARROW = 1e-12
_RING = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))

Ring = list[tuple[float, float]]


def _edges(polygons: list[list[Ring]]) -> tuple[np.ndarray, np.ndarray]:
    """(x0, y0, x1, y1) of the edges that aren't vertical, from left to right, and the polygon of each."""
    parts, owner = [np.empty((0, 4))], [np.empty(0, np.int64)]
    for k, polygon in enumerate(polygons):
        for ring in polygon:
            p = np.asarray(ring, float).reshape(-1, 2)
            e = np.hstack([p, np.roll(p, -1, 0)])
            e = e[e[:, 0] != e[:, 2]]
            back = e[:, 0] > e[:, 2]
            e[back] = e[back][:, [2, 3, 0, 1]]
            parts.append(e)
            owner.append(np.full(len(e), k))
    return np.concatenate(parts), np.concatenate(owner)


def _cuts(e: np.ndarray) -> np.ndarray:
    """Longitudes of all corners and of all crossings of two edges."""
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    found = [e[:, 0], e[:, 2]]
    for i in range(len(e)):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base[i] - base[i + 1 :]) / (slope[i + 1 :] - slope[i])
        found.append(x[(x > np.maximum(e[i, 0], e[i + 1 :, 0])) & (x < np.minimum(e[i, 2], e[i + 1 :, 2]))])
    cuts = np.unique(np.concatenate(found))
    return cuts[np.concatenate([[True], np.diff(cuts) > _NARROW])] if len(cuts) else cuts


def overlay(a: list[list[Ring]], b: list[list[Ring]], keep: Callable[[bool, bool], bool]) -> np.ndarray:
    """Trapezoids (x0, low0, high0, x1, low1, high1) of where ``keep`` (in any polygon of a, in any of b) holds."""
    e, owner = _edges(a + b)
    cuts, out, open_, last = _cuts(e), [], {}, {}
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        live = np.flatnonzero((e[:, 0] <= lo + _NARROW) & (e[:, 2] >= hi - _NARROW))
        at = lambda x: e[live, 1] + (e[live, 3] - e[live, 1]) * (x - e[live, 0]) / (e[live, 2] - e[live, 0])  # noqa: B023, E731
        y0, y1 = at(lo), at(hi)
        inside, started, spans = set(), None, []
        n_a = 0
        for k in np.argsort(y0 + y1, kind="stable").tolist():
            who = int(owner[live[k]])
            n_a += (who < len(a)) * (-1 if who in inside else 1)
            inside ^= {who}
            now = keep(n_a > 0, len(inside) > n_a)
            if now and started is None:
                started = k
            elif not now and started is not None:
                if y0[k] + y1[k] > y0[started] + y1[started]:
                    spans.append((int(live[started]), int(live[k]), y0[started], y0[k], y1[started], y1[k]))
                started = None
        going = {}
        for low, high, l0, h0, l1, h1 in spans:  # between the same edges it is one trapezoid
            x0, s0, t0 = open_.pop((low, high), (lo, l0, h0))
            going[low, high] = (x0, s0, t0, hi, l1, h1)
        out += [last[k] for k in open_]
        last, open_ = going, {k: v[:3] for k, v in going.items()}
    out += [last[k] for k in open_]
    return np.array(out).reshape(-1, 6)


def areas(pieces: np.ndarray) -> float:
    """Square degrees."""
    return float(((pieces[:, 3] - pieces[:, 0]) * (pieces[:, 2] - pieces[:, 1] + pieces[:, 5] - pieces[:, 4]) / 2).sum())


def as_rings(pieces: np.ndarray) -> list[list[dict]]:
    """The trapezoids as closed rings."""
    return [[{"lon": x, "lat": y} for x, y in ((p[0], p[1]), (p[3], p[4]), (p[3], p[5]), (p[0], p[2]), (p[0], p[1]))] for p in pieces.tolist()]


def _points(rings: list | None) -> list[Ring]:
    return [[(p["lon"], p["lat"]) for p in r] for r in rings or [] if r]


def _united(keys: list[str]) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        pieces = overlay([_points(r) for r in t["rings"].to_pylist()], [], lambda a, b: a)
        named = {k: pa.array([t[k][0].as_py()], t.schema.field(k).type) for k in keys}
        return pa.table({**named, "pieces": pa.array([as_rings(pieces)], pa.list_(_RING)), "area": pa.array([areas(pieces)])})

    return run


def union_aggregate(polygons: DataFrame, keys: list[str], rings: str = "rings") -> DataFrame:
    """Per group of ``keys``: ``pieces``, the union of its polygons as rings that don't overlap, and ``area`` in square degrees.

    ``rings`` holds a polygon's rings (outer and holes); null or empty ones add nothing. In a
    first step at most about ``FIRST`` polygons of a group are united in one task, in a second
    their unions are, so overlapping polygons never meet in one task all at once.
    """
    spark = polygons.sparkSession
    ship_package(spark)
    rows = polygons.select(*keys, F.col(rings).alias("rings"))
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / FIRST).cast("int").alias("_parts"))
    joined = rows.alias("p").join(counts.alias("c"), [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]).select("p.*", "_parts")
    salted = joined.withColumn("_part", F.pmod(F.xxhash64("rings"), F.col("_parts")).cast("int")).drop("_parts")
    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kind}, pieces array<array<struct<lon: double, lat: double>>>, area double"
    first = salted.groupBy(*keys, "_part").applyInArrow(_united(keys), schema)
    again = first.select(*keys, F.explode_outer("pieces").alias("r")).select(*keys, F.when(F.col("r").isNotNull(), F.array("r")).alias("rings"))
    return again.groupBy(*keys).applyInArrow(_united(keys), schema)


def _intersected(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for p, q in zip(a.to_pylist(), b.to_pylist()):
        out.append(None if p is None or q is None else as_rings(overlay([_points(p)], [_points(q)], lambda x, y: x and y)))
    return pa.array(out, pa.list_(_RING))


def intersection(a: Column, b: Column) -> Column:
    """The intersection of two polygons (arrays of rings, outer and holes) as rings that don't overlap; null for null."""
    return F.arrow_udf(_intersected, "array<array<struct<lon: double, lat: double>>>")(a, b)


def pieces_area(pieces: Column) -> Column:
    """Square degrees of rings that don't overlap."""
    twice = lambda r: F.aggregate(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(pieces, F.lit(0.0), lambda s, r: s + F.abs(twice(r)) / 2)
