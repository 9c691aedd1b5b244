"""DuckDB text of geometry for the oracles, written apart from the engine's own expressions.

Metres on the ellipsoid by the radii at mid-latitude; footprints are the parallelograms and
land the L shapes of the test tables, told by half-planes and by two boxes.
"""

from __future__ import annotations

_BENT = "(1e0 - 0.00669437999014e0 * pow(sin(radians({0})), 2))"


def _east(lat: str) -> str:
    """Metres per radian of longitude."""
    return f"(6378137e0 * cos(radians({lat})) / sqrt({_BENT.format(lat)}))"


def _north(lat: str) -> str:
    """Metres per radian of latitude."""
    return f"(6378137e0 * (1e0 - 0.00669437999014e0) / pow({_BENT.format(lat)}, 1.5))"


def metres(x1: str, y1: str, x2: str, y2: str) -> str:
    mid = f"(({y1} + {y2}) / 2e0)"
    return f"sqrt(pow({_east(mid)} * radians({x1} - ({x2})), 2) + pow({_north(mid)} * radians({y1} - ({y2})), 2))"


def moved_lat(y: str, m: str, az: str) -> str:
    half = f"({y} + degrees({m} * cos({az}) / {_north(y)}) / 2e0)"
    return f"({y} + degrees({m} * cos({az}) / {_north(half)}))"


def moved_lon(x: str, y: str, to: str, m: str, az: str) -> str:
    return f"({x} + degrees({m} * sin({az}) / {_east(f'(({y} + {to}) / 2e0)')}))"


def off_box(x: str, y: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return metres(x, y, f"greatest({x0}, least({x}, {x1}))", f"greatest({y0}, least({y}, {y1}))")


def off_land(x: str, y: str, t: str = "l") -> str:
    """Metres to an L: the lower half of its box or the west half, whichever is nearer."""
    x0, y0, x1, y1 = (f"{t}.{c}" for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    return f"least({off_box(x, y, x0, y0, x1, f'(({y0} + {y1}) / 2e0)')}, {off_box(x, y, x0, y0, f'(({x0} + {x1}) / 2e0)', y1)})"


def in_foot(x: str, y: str, t: str) -> str:
    """Between the west and east sides and between the two slanting ones."""
    return f"({x} BETWEEN {t}.min_lon AND {t}.max_lon AND {y} - {t}.tilt * (({x} - {t}.min_lon) / ({t}.max_lon - {t}.min_lon)) BETWEEN {t}.min_lat AND {t}.max_lat - {t}.tilt)"


def _off_side(x: str, y: str, x0: str, y0: str, x1: str, y1: str) -> str:
    kx, ky, dx, dy = f"pow({_east(y)}, 2)", f"pow({_north(y)}, 2)", f"({x1} - {x0})", f"({y1} - ({y0}))"
    t = f"greatest(0e0, least(1e0, (({x} - {x0}) * {dx} * {kx} + ({y} - ({y0})) * {dy} * {ky}) / ({dx} * {dx} * {kx} + {dy} * {dy} * {ky})))"
    return metres(x, y, f"({x0} + {t} * {dx})", f"({y0} + {t} * {dy})")


def off_foot(x: str, y: str, t: str) -> str:
    """Metres to a parallelogram, 0 inside."""
    x0, y0, x1, y1, s = (f"{t}.{c}" for c in ("min_lon", "min_lat", "max_lon", "max_lat", "tilt"))
    corners = [(x0, y0), (x1, f"({y0} + {s})"), (x1, y1), (x0, f"({y1} - {s})")]
    sides = ", ".join(_off_side(x, y, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1]))
    return f"CASE WHEN {in_foot(x, y, t)} THEN 0e0 ELSE least({sides}) END"


# Publishable failure reasons, the first whose words occur.
FAILURE = """CASE WHEN {0} IS NULL OR {0} = '' THEN NULL
WHEN regexp_matches(lower({0}), 'real data|coverage') THEN 'Swath missed the box'
WHEN regexp_matches(lower({0}), 'credential|401|403') THEN 'Imagery access rejected'
WHEN regexp_matches(lower({0}), 'timeout|timed out') THEN 'Imagery fetch timed out'
WHEN regexp_matches(lower({0}), 'model checkpoint|dependencies') THEN 'Detector unavailable'
WHEN regexp_matches(lower({0}), 'killed for memory|subprocess died') THEN 'Detector ran out of memory'
WHEN contains(lower({0}), 'interrupted by restart') THEN 'Interrupted by a restart'
WHEN contains(lower({0}), 'ais') THEN 'No AIS reference in window' ELSE 'Analysis error' END"""
