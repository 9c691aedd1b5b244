import numpy as np
import pytest

from tidewake.operators import raster, regions

LINES = "raster string, y long, pixels array<int>"


def _lines(spark, images):
    return spark.createDataFrame([(name, y, v.tolist()) for name, a in images.items() for y, v in enumerate(a)], LINES)


def _boxes(df):
    return sorted((r.raster, r.x1, r.y1, r.x2, r.y2, round(r.confidence, 12)) for r in df.collect())


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(8)
    spiral = np.zeros((25, 25), int)
    for k in range(0, 12, 2):
        spiral[k, k : 25 - k] = spiral[k : 25 - k, 24 - k] = spiral[24 - k, k : 25 - k] = 255
        spiral[k + 2 : 25 - k, k] = 255
        spiral[k + 2, k : k + 3] = 230
    return {"sparse": rng.integers(0, 256, (60, 70)) * (rng.random((60, 70)) < 0.9), "dense": np.where(rng.random((40, 31)) < 0.62, 255, 0), "spiral": spiral, "dark": np.zeros((5, 5), int)}


@pytest.mark.parametrize("rows", [1, 3, 8, 2048])
def test_regions_dont_depend_on_seams(spark, images, rows):
    want = sorted((name, *b[:4], round(b[4], 12)) for name, a in images.items() for b in raster.bright_regions(a.astype(np.uint8)))
    assert sum(w[0] == "spiral" for w in want) == 1 and len(want) > 20
    assert _boxes(regions.bright_regions(_lines(spark, images), rows=rows)) == want


def test_odd_lines(spark):
    rows = [("a", 0, [255, None, 255]), ("a", 1, [255, 255, 255]), (None, 0, [255] * 9), ("a", None, [255] * 9), ("b", 0, None), ("c", 0, []), ("d", 3, [9, 9, 9])]
    got = regions.bright_regions(spark.createDataFrame(rows, LINES), rows=1)
    assert _boxes(got) == [("a", 0, 0, 3, 2, 1.0)]
    none = regions.bright_regions(spark.createDataFrame([], LINES))
    assert none.count() == 0 and regions.suppress_by_rounds(none, "raster").count() == 0


def _walk(boxes, t, min_px):
    kept = []
    for b in sorted(set(boxes), key=lambda b: (-b[4], b[1], b[0], b[3], b[2])):
        if all(raster.iou(b, k) < t and np.hypot((b[0] + b[2] - k[0] - k[2]) / 2, (b[1] + b[3] - k[1] - k[3]) / 2) >= min_px for k in kept):
            kept.append(b)
    return sorted(kept)


@pytest.mark.parametrize("t,min_px", [(0.5, 15.0), (0.3, 4.0), (0.5, 0.0)])
def test_rounds_equal_the_walk(spark, t, min_px):
    rng = np.random.default_rng(3)
    at, side = rng.uniform(-150, 150, (400, 2)), np.exp(rng.uniform(0, 5, (400, 2)))
    boxes = [(x, y, x + w, y + h, c) for (x, y), (w, h), c in zip(at.tolist(), side.tolist(), (rng.integers(1, 40, 400) / 40).tolist())]
    boxes += boxes[:30]
    df = spark.createDataFrame([(s, *b) for s in ("s", "t") for b in boxes] + [(None, *boxes[0]), ("s", None, *boxes[0][1:]), ("s", *boxes[0][:4], float("nan"))], "scene_id string, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = regions.suppress_by_rounds(df, iou_threshold=t, min_px=min_px).collect()
    want = _walk(boxes, t, min_px)
    for s in ("s", "t"):
        assert sorted(tuple(r)[1:] for r in got if r.scene_id == s) == want
    assert len(got) == 2 * len(want) and 10 < len(want) < 400
