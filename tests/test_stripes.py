import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import raster, stripes


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(5)
    dn = rng.integers(0, 90, (23, 17)).astype(float)
    return dn, np.array([0, 9, 15]), [np.array([2.0, 8.0, 14.0])] * 3, [rng.uniform(30, 90, 3) for _ in range(3)]


def _tables(spark, image):
    dn, lines, pixels, sigmas = image
    rows = [(name, y, v.tolist()) for name in ("a", "b") for y, v in enumerate(dn)]
    table = [(name, int(at), p.tolist(), s.tolist()) for name in ("a", "b") for at, p, s in zip(lines, pixels, sigmas) if name == "a" or at == 0]
    return spark.createDataFrame(rows, "raster string, y long, dn array<double>"), spark.createDataFrame(table, "raster string, line long, pixels array<double>, sigmas array<double>")


@pytest.mark.parametrize("rows", [1, 2, 7, 23, 2048])
def test_stripes_equal_the_whole_raster(spark, image, rows):
    dn, lines, pixels, sigmas = image
    got = {(r.raster, r.y): r.pixels for r in stripes.rendered(*_tables(spark, image), rows=rows).collect()}
    for name, n in (("a", 3), ("b", 1)):
        lut = raster.expand_lut(lines[:n], pixels[:n], sigmas[:n], *dn.shape)
        smooth = raster.lee_filter(np.where(dn != 0, (dn / lut) ** 2, 0))
        with np.errstate(divide="ignore"):
            want = np.where(dn != 0, raster.to_uint8(10 * np.log10(smooth)), 0)
        assert [got[name, y] for y in range(len(dn))] == want.tolist()


def test_missing_lines_and_no_lines(spark, image):
    lines, table = _tables(spark, image)
    some = stripes.rendered(lines.filter("y <> 5"), table, rows=4)
    assert some.count() == 44 and some.filter("y = 5").count() == 0
    assert stripes.rendered(lines.limit(0), table).count() == 0
    odd = spark.createDataFrame([("a", 0, None), ("a", 1, [5.0, None, float("nan"), 50.0]), ("a", 2, [float("inf"), 9.0, 0.0, 40.0]), ("none", 0, [1.0])], lines.schema)
    broken = spark.createDataFrame([("a", 0, [0.0, 3.0], [None, 60.0]), ("a", 4, None, None)], table.schema)
    got = {(r.raster, r.y): r.pixels for r in stripes.rendered(odd, broken, rows=1).collect()}
    assert set(got) == {("a", 1), ("a", 2)} and all(len(v) == 4 for v in got.values())
    assert [v == 0 for v in got["a", 1]][1:3] == [True, True] and [v == 0 for v in got["a", 2]] == [True, False, True, False]


def test_another_window_as_on_arrays(spark):
    df = spark.createDataFrame([(list(range(256)),)], "pixels array<int>")
    got = df.select(stripes.in_window(F.col("pixels"), (-25.0, 0.0), (-20.0, -3.0)).alias("p")).first().p
    assert got == raster.restretch(np.arange(256), (-25.0, 0.0), (-20.0, -3.0)).tolist()
    with pytest.raises(ValueError):
        stripes.in_window(F.col("pixels"), (-25.0, 0.0), (-30.0, 0.0))
