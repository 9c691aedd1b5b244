"""Overlay of polygons against areas that are known, and against points drawn at random."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.functions import rings
from tidewake.operators import overlay

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
ELL = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]
BOW = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]


def shifted(ring, x, y):
    return [(a + x, b + y) for a, b in ring]


def struct(rs):
    return [[{"lon": x, "lat": y} for x, y in [*r, r[0]]] for r in rs]


@pytest.mark.parametrize(
    ("a", "b", "keep", "area"),
    [
        ([[SQUARE]], [], lambda x, y: x, 16.0),
        ([[SQUARE, HOLE]], [], lambda x, y: x, 12.0),
        ([[SQUARE], [shifted(SQUARE, 2, 2)]], [], lambda x, y: x, 28.0),
        ([[SQUARE], [SQUARE]], [], lambda x, y: x, 16.0),
        ([[ELL]], [[shifted(SQUARE, 1, 1)]], lambda x, y: x and y, 5.0),
        ([[SQUARE, HOLE]], [[shifted(HOLE, 1, 0)]], lambda x, y: x and y, 2.0),
        ([[SQUARE]], [[HOLE]], lambda x, y: x and not y, 12.0),
        ([[BOW]], [], lambda x, y: x, 2.0),
        ([[[(1.0, 1.0), (1.0, 2.0)]]], [], lambda x, y: x, 0.0),
        ([], [], lambda x, y: x, 0.0),
    ],
)
def test_known_areas(a, b, keep, area):
    assert overlay.areas(overlay.overlay(a, b, keep)) == pytest.approx(area, abs=1e-9)


def test_random_polygons_hold_the_points_that_they_should():
    rng = random.Random(4)
    draw = lambda: [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randrange(3, 8))]
    for _ in range(15):
        a, b = [[draw()] for _ in range(3)], [[draw()] for _ in range(2)]
        pieces = overlay.as_rings(overlay.overlay(a, b, lambda x, y: x and y))
        for _ in range(40):
            p = rng.uniform(0, 10), rng.uniform(0, 10)
            held = [rings.holds([(q["lon"], q["lat"]) for q in r[:-1]], p) for r in pieces]
            assert sum(held) == (any(rings.holds(r[0], p) for r in a) and any(rings.holds(r[0], p) for r in b))


def test_union_aggregate_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(overlay, "FIRST", 3)
    rows = [("a", struct([shifted(SQUARE, k, 0)])) for k in range(8)] + [("b", struct([SQUARE, HOLE])), ("b", None), (None, struct([BOW])), ("c", [])]
    frame = spark.createDataFrame(rows, "k string, rings array<array<struct<lon: double, lat: double>>>")
    out = overlay.union_aggregate(frame, ["k"]).withColumn("again", overlay.pieces_area(F.col("pieces")))
    got = {r.k: (round(r.area, 9), round(r.again, 9)) for r in out.collect()}
    assert got == {"a": (44.0, 44.0), "b": (12.0, 12.0), None: (2.0, 2.0), "c": (0.0, 0.0)}


def test_intersection_of_columns(spark):
    frame = spark.createDataFrame([(1, struct([ELL]), struct([shifted(SQUARE, 1, 1)])), (2, None, struct([SQUARE])), (3, struct([SQUARE]), struct([shifted(SQUARE, 9, 9)]))], "i int, a array<array<struct<lon: double, lat: double>>>, b array<array<struct<lon: double, lat: double>>>")
    got = {r.i: r.area for r in frame.select("i", overlay.pieces_area(overlay.intersection(F.col("a"), F.col("b"))).alias("area")).collect()}
    assert got == {1: pytest.approx(5.0), 2: None, 3: 0.0}
