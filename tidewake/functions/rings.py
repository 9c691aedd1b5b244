"""Polygons as rings of (lon, lat): parsing, covering, distance, clipping, area and union area."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewake.functions import geo

RING = "array<struct<lon: double, lat: double>>"


def parse_wkt(wkt: Column) -> Column:
    """Outer ring of a ``POLYGON`` text, an ``SRID=...;`` prefix allowed; null for null or no polygon."""
    body = F.regexp_extract(F.regexp_replace(wkt, r"^SRID=\d+;", ""), r"^\s*POLYGON\s*\(\(([^()]*)\)", 1)
    points = F.split(F.trim(body), r"\s*,\s*")
    ring = F.transform(points, lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat")))
    return F.when(F.length(body) > 0, ring)


POLYGONS = f"array<array<{RING}>>"


def parse_polygons(wkt: Column) -> Column:
    """Polygons of a ``POLYGON`` or ``MULTIPOLYGON`` text, each an outer ring and its holes; null for anything else.

    An ``SRID=...;`` prefix and a third coordinate are allowed and dropped.
    """
    body = F.trim(F.regexp_replace(wkt, r"^SRID=\d+;", ""))
    nested = F.regexp_replace(body, r"(?i)^\s*(MULTI)?POLYGON\s*Z?\s*", "")
    listed = F.regexp_replace(nested, r"([-+\d.eE]+)\s+([-+\d.eE]+)(\s+[-+\d.eE]+)?", "[$1,$2]")
    text = F.translate(listed, "()", "[]")
    text = F.when(body.rlike(r"(?i)^MULTIPOLYGON"), text).when(body.rlike(r"(?i)^POLYGON"), F.concat(F.lit("["), text, F.lit("]")))
    every = F.from_json(text, "array<array<array<array<double>>>>")
    return F.transform(every, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))


def tidy(ring: Column) -> Column:
    """A ring closed and without repeated neighbours; null if nothing with an area is left."""
    kept = F.filter(ring, lambda p, i: (i == 0) | (p != F.element_at(ring, i.cast("int"))))
    closed = F.when(kept[0] == F.element_at(kept, -1), kept).otherwise(F.concat(kept, F.slice(kept, 1, 1)))
    return F.when((F.size(closed) >= 4) & (area(closed) > 0), closed)


def _wkt_ring(ring: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string"))), ","), F.lit(")"))


def to_ewkt(ring: Column, holes: Column | None = None, srid: int = 4326) -> Column:
    every = F.array(ring) if holes is None else F.concat(F.array(ring), holes)
    return F.concat(F.lit(f"SRID={srid};POLYGON("), F.array_join(F.transform(every, _wkt_ring), ","), F.lit(")"))


def multi_wkt(polygons: Column) -> Column:
    """``MULTIPOLYGON`` text of an array of outer rings."""
    return F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(polygons, lambda r: F.concat(F.lit("("), _wkt_ring(r), F.lit(")"))), ","), F.lit(")"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def sheared_ring(x0: Column, y0: Column, x1: Column, y1: Column, tilt: Column) -> Column:
    """A box with all four corners whose east side lies ``tilt`` farther north than its west side."""
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(corner(x0, y0), corner(x1, y0 + tilt), corner(x1, y1), corner(x0, y1 - tilt), corner(x0, y0))


def parse_geojson(text: Column) -> Column:
    """Outer ring of a GeoJSON Polygon."""
    coords = F.from_json(text, "coordinates array<array<array<double>>>")["coordinates"][0]
    return F.transform(coords, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def to_geojson(ring: Column, holes: Column | None = None) -> Column:
    every = F.array(ring) if holes is None else F.concat(F.array(ring), holes)
    coords = F.transform(every, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))


def area(ring: Column) -> Column:
    """Square degrees by the shoelace formula; 0 for fewer than three points."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"), F.slice(ring, 2, F.size(ring) - 1).alias("q"))
    twice = F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e["p"]["lon"] * e["q"]["lat"] - e["q"]["lon"] * e["p"]["lat"])
    return F.when(F.size(ring) >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def _edges(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ring, 1, n).alias("p"), F.slice(ring, 2, n).alias("q"))


def covers(ring: Column, lon: Column, lat: Column, holes: Column | None = None) -> Column:
    """Point in ring (even-odd), boundary included; what lies within a hole is outside, its edge is not.

    An edge is taken from west to east and the point's latitude is led back along it, so both
    tests round alike and a point on a slanting edge isn't lost between them.
    """
    edges = _edges(ring) if holes is None else F.concat(_edges(ring), F.flatten(F.transform(holes, _edges)))

    def led_back(e: Column) -> tuple[Column, Column]:
        """The point's latitude less the edge's rise up to it (null for an upright edge), and the latitude of the edge's west end."""
        px, py, qx, qy = e["p"]["lon"], e["p"]["lat"], e["q"]["lon"], e["q"]["lat"]
        east = px <= qx
        west_lat, rise = F.when(east, py).otherwise(qy), F.when(east, qy - py).otherwise(py - qy)
        return lat - rise * ((lon - F.least(px, qx)) / F.nullif(F.abs(qx - px), F.lit(0.0))), west_lat

    def on_edge(e: Column) -> Column:
        px, py, qx, qy = e["p"]["lon"], e["p"]["lat"], e["q"]["lon"], e["q"]["lat"]
        at, west_lat = led_back(e)
        corner, upright = (lon == px) & (lat == py), (px == qx) & (lon == px) & lat.between(F.least(py, qy), F.greatest(py, qy))
        return corner | upright | (lon.between(F.least(px, qx), F.greatest(px, qx)) & F.coalesce(at == west_lat, F.lit(False)))

    def crosses(e: Column) -> Column:
        at, west_lat = led_back(e)
        return ((e["p"]["lon"] > lon) != (e["q"]["lon"] > lon)) & F.coalesce(at < west_lat, F.lit(False))

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.exists(edges, on_edge) | odd


def distance(ring: Column, lon: str, lat: str, holes: Column | None = None) -> Column:
    """Metres to the closed polygon, 0 inside: to the nearest point of any edge, edges straight in degrees."""
    return F.when(covers(ring, F.col(lon), F.col(lat), holes), F.lit(0.0)).otherwise(edge_distance(ring, lon, lat, holes))


def edge_distance(ring: Column, lon: str, lat: str, holes: Column | None = None) -> Column:
    """Metres to the nearest point of any edge, from inside and outside alike."""
    edges = _edges(ring) if holes is None else F.concat(_edges(ring), F.flatten(F.transform(holes, _edges)))
    kx, ky = F.expr(f"{geo.prime_radius(lat)} * cos(radians({lat}))"), F.expr(geo.meridian_radius(lat))
    x, y = F.col(lon), F.col(lat)

    def foot(e: Column) -> Column:
        dx, dy = e["q"]["lon"] - e["p"]["lon"], e["q"]["lat"] - e["p"]["lat"]
        long_ = F.pow(dx * kx, F.lit(2.0)) + F.pow(dy * ky, F.lit(2.0))
        along = (x - e["p"]["lon"]) * dx * kx * kx + (y - e["p"]["lat"]) * dy * ky * ky
        t = F.when(long_ > 0, F.least(F.greatest(along / F.nullif(long_, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.struct((e["p"]["lon"] + t * dx).alias("lon"), (e["p"]["lat"] + t * dy).alias("lat"))

    metres = lambda f: geo.distance_columns(x, y, f["lon"], f["lat"])
    return F.array_min(F.transform(F.transform(edges, foot), metres))


def _metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """``geo.distance`` over arrays."""
    mid = np.radians((lat1 + lat2) / 2)
    w = 1 - float(geo.E2) * np.sin(mid) ** 2
    dx = float(geo.A) / np.sqrt(w) * np.cos(mid) * np.radians(lon2 - lon1)
    dy = float(geo.A) * (1 - float(geo.E2)) / w**1.5 * np.radians(lat2 - lat1)
    return np.sqrt(dx * dx + dy * dy)


def _within(ring: pa.Array, lon: pa.Array, lat: pa.Array, metres: pa.Array) -> pa.Array:
    """Which points lie in their ring (even-odd, edges included) or at most so many metres from it; false for a null ring."""
    size = ring.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = ring.flatten()
    px, py = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    inner = np.ones(len(px), bool)
    inner[np.cumsum(size)[size > 0] - 1] = False  # a ring's last point begins no edge
    at = np.flatnonzero(inner)
    row = np.repeat(np.arange(len(size)), size)[at]
    px, py, qx, qy = px[at], py[at], px[at + 1], py[at + 1]
    everywhere, most = np.stack([c.to_numpy(zero_copy_only=False) for c in (lon, lat)]), metres.to_numpy(zero_copy_only=False)
    x, y = everywhere[:, row]
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / (qy - py) + px)
    out = np.bincount(row[crosses], minlength=len(size)) % 2 == 1
    rest = ~out[row]
    row, px, py, qx, qy, x, y = (c[rest] for c in (row, px, py, qx, qy, x, y))
    w = 1 - float(geo.E2) * np.sin(np.radians(y)) ** 2
    kx, ky = float(geo.A) / np.sqrt(w) * np.cos(np.radians(y)), float(geo.A) * (1 - float(geo.E2)) / w**1.5
    dx, dy = qx - px, qy - py
    long_ = (dx * kx) ** 2 + (dy * ky) ** 2
    along = (x - px) * dx * kx * kx + (y - py) * dy * ky * ky
    t = np.where(long_ > 0, np.clip(along / np.where(long_ > 0, long_, 1.0), 0.0, 1.0), 0.0)
    out[row[_metres(x, y, px + t * dx, py + t * dy) <= most[row]]] = True
    return pa.array(out)


def within(ring: Column, lon: Column, lat: Column, metres: Column) -> Column:
    """Whether a point lies in a ring or at most ``metres`` from it, on Arrow batches: for very many pairs, where lambdas are slow."""
    return F.arrow_udf(_within, "boolean")(ring, lon, lat, metres)


def ring_of(wkt: str) -> list[tuple[float, float]]:
    """The outer ring of a POLYGON text, on the driver or in a worker."""
    m = re.search(r"POLYGON\s*\(\(([^()]*)\)", wkt.split(";", 1)[-1])
    return [tuple(map(float, p.split()[:2])) for p in m.group(1).split(",")] if m else []


def turn(ring: list[tuple[float, float]]) -> float:
    """Twice the signed area: negative for a clockwise ring."""
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))


def holds(ring: list[tuple[float, float]], point: tuple[float, float]) -> bool:
    """Point in ring (even-odd), corners included."""
    x, y = point
    odd = sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:] + ring[:1])) % 2 == 1
    return odd or point in ring


def clip_to_box(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """Sutherland-Hodgman clip of a ring to a box; an open ring, empty if nothing is left."""
    out = list(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
    for axis, bound, keep_low in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        inside = (lambda p: p[axis] <= bound) if keep_low else (lambda p: p[axis] >= bound)  # noqa: B023
        source, out = out, []
        for k, p in enumerate(source):
            prev = source[k - 1]
            if inside(p) != inside(prev):
                t = (bound - prev[axis]) / (p[axis] - prev[axis])
                hit = [prev[i] + t * (p[i] - prev[i]) for i in (0, 1)]
                hit[axis] = bound
                out.append(tuple(hit))
            if inside(p):
                out.append(p)
    return out


def union_area(rings: list[list[tuple[float, float]]]) -> float:
    """Area of the union of rings, by vertical slabs between all corners and crossings."""
    edges = []
    for r, ring in enumerate(rings):
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if p[0] != q[0]:
                edges.append((*(p + q if p[0] < q[0] else q + p), r))
    if not edges:
        return 0.0
    e = np.array(edges)
    xs = set(e[:, 0]) | set(e[:, 2])
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    for i in range(len(e)):
        d = slope - slope[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (e[i, 1] - slope[i] * e[i, 0] - e[:, 1] + slope * e[:, 0]) / d
        ok = (d != 0) & (x > np.maximum(e[i, 0], e[:, 0])) & (x < np.minimum(e[i, 2], e[:, 2]))
        xs |= set(x[ok])
    cuts = np.array(sorted(xs))
    total = 0.0
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        mid = (lo + hi) / 2
        live = np.flatnonzero((e[:, 0] <= lo) & (e[:, 2] >= hi))
        y = e[live, 1] + slope[live] * (mid - e[live, 0])
        order = np.argsort(y)
        open_, start, inside = 0, 0.0, set()
        for k in order:
            ring = int(e[live[k], 4])
            inside ^= {ring}
            if len(inside) and not open_:
                start, open_ = y[k], 1
            elif not inside and open_:
                total += (y[k] - start) * (hi - lo)
                open_ = 0
    return float(total)


def coverage(wkts: list[str], box: tuple[float, float, float, float]) -> float:
    """Share of a box that the union of polygons covers; 0 without polygons."""
    rings = [c for w in wkts if len(c := clip_to_box(ring_of(w), box)) > 2]
    return union_area(rings) / ((box[2] - box[0]) * (box[3] - box[1]))
