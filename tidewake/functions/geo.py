"""Geographic expressions as SQL text, for ``F.expr`` and any other SQL engine alike.

Metres use the local radii of the WGS84 ellipsoid at mid-latitude: under 1 mm off the
geodesic up to 5 km and about 0.1 m at 30 km, against 0.5 % for a sphere. Everything is
closed-form and stays in generated code. Boxes and rings are planar in degrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-major axis and squared eccentricity.
A, E2 = "6378137e0", "0.00669437999014e0"


def meridian_radius(lat: str) -> str:
    return f"({A} * (1e0 - {E2}) / power(1e0 - {E2} * power(sin(radians({lat})), 2e0), 1.5e0))"


def prime_radius(lat: str) -> str:
    return f"({A} / sqrt(1e0 - {E2} * power(sin(radians({lat})), 2e0)))"


def distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Metres between two points given in degrees."""
    mid = f"(({lat1}) + ({lat2})) / 2e0"
    dx = f"({prime_radius(mid)} * cos(radians({mid})) * radians(({lon2}) - ({lon1})))"
    dy = f"({meridian_radius(mid)} * radians(({lat2}) - ({lat1})))"
    return f"sqrt(power({dx}, 2e0) + power({dy}, 2e0))"


def distance_columns(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """``distance`` over columns, for the variables of a lambda."""
    mid = F.radians((lat1 + lat2) / 2.0)
    a, e2 = float(A), float(E2)
    w = F.lit(1.0) - F.lit(e2) * F.pow(F.sin(mid), F.lit(2.0))
    dx = F.lit(a) / F.sqrt(w) * F.cos(mid) * F.radians(lon2 - lon1)
    dy = F.lit(a * (1 - e2)) / F.pow(w, F.lit(1.5)) * F.radians(lat2 - lat1)
    return F.sqrt(F.pow(dx, F.lit(2.0)) + F.pow(dy, F.lit(2.0)))


def project_lat(lat: str, metres: str, azimuth: str) -> str:
    """Latitude after ``metres`` along ``azimuth`` (radians clockwise from north)."""
    first = f"degrees(({metres}) * cos({azimuth}) / {meridian_radius(lat)})"
    mid = f"(({lat}) + {first} / 2e0)"
    return f"(({lat}) + degrees(({metres}) * cos({azimuth}) / {meridian_radius(mid)}))"


def project_lon(lon: str, lat: str, new_lat: str, metres: str, azimuth: str) -> str:
    """Longitude after the same step; ``new_lat`` is the latitude that ``project_lat`` gave."""
    mid = f"((({lat}) + ({new_lat})) / 2e0)"
    return f"(({lon}) + degrees(({metres}) * sin({azimuth}) / ({prime_radius(mid)} * cos(radians({mid})))))"


def strictly_in_box(lon: str, lat: str, box: tuple[float, float, float, float]) -> str:
    """Inside a box, its edges excluded."""
    a, b, c, d = (f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in box)
    return f"({lon} > {a} and {lon} < {c} and {lat} > {b} and {lat} < {d})"


def covered_by_box(lon: str, lat: str, box: tuple[str, str, str, str]) -> str:
    """Inside a box given by four expressions, edges included."""
    return f"({lon} >= {box[0]} and {lon} <= {box[2]} and {lat} >= {box[1]} and {lat} <= {box[3]})"


def distance_to_box(lon: str, lat: str, box: tuple[str, str, str, str]) -> str:
    """Metres to a box, 0 inside: the distance to the point clamped into it."""
    return distance(lon, lat, f"least(greatest({lon}, {box[0]}), {box[2]})", f"least(greatest({lat}, {box[1]}), {box[3]})")


def in_sheared_box(lon: str, lat: str, box: tuple[str, str, str, str], tilt: str) -> str:
    """Inside a box whose east side lies ``tilt`` degrees farther north than its west side, sides included.

    The box has all four corners. The tilt is taken as given: a ring's corners hold it rounded, so points on the slanting sides fall to either one.
    """
    a, b, c, d = box
    led_back = f"{lat} - {tilt} * (({lon} - {a}) / nullif({c} - {a}, 0e0))"
    return f"({lon} >= {a} and {lon} <= {c} and {led_back} >= {b} and {led_back} <= {d} - {tilt})"


def box_wkt(a: str, b: str, c: str, d: str) -> str:
    """Closed polygon text, counter-clockwise from the south-west corner."""
    s = lambda x: f"cast({x} as string)"
    return f"concat('POLYGON((', {s(a)}, ' ', {s(b)}, ',', {s(c)}, ' ', {s(b)}, ',', {s(c)}, ' ', {s(d)}, ',', {s(a)}, ' ', {s(d)}, ',', {s(a)}, ' ', {s(b)}, '))')"


def pixel_to_lon(col: str, width: str, box: tuple[str, ...]) -> str:
    return f"({box[0]} + ({col}) / ({width}) * ({box[2]} - {box[0]}))"


def pixel_to_lat(row: str, height: str, box: tuple[str, ...]) -> str:
    """Row 0 is the north edge."""
    return f"({box[3]} - ({row}) / ({height}) * ({box[3]} - {box[1]}))"


def lon_to_pixel(lon: str, width: str, box: tuple[str, ...]) -> str:
    return f"((({lon}) - {box[0]}) / ({box[2]} - {box[0]}) * ({width}))"


def lat_to_pixel(lat: str, height: str, box: tuple[str, ...]) -> str:
    return f"(({box[3]} - ({lat})) / ({box[3]} - {box[1]}) * ({height}))"


def box_km(box: tuple[str, ...]) -> tuple[str, str]:
    """Width and height in km on the metre grid of the imagery (111,320 m a degree)."""
    mid = f"(({box[1]} + {box[3]}) / 2e0)"
    return f"(({box[2]} - {box[0]}) * 111.32e0 * cos(radians({mid})))", f"(({box[3]} - {box[1]}) * 111.32e0)"
