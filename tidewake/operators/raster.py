"""Raster kernels: tiles, detections, merging, stretches, filters and calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.params import DEFAULT, Params

# relational pieces ------------------------------------------------------------------------------


def offsets(total: Column, tile: int, overlap: int = 0) -> Column:
    """Tile starts along one side: a regular grid whose last tile is flush with the edge."""
    regular = F.when(total > tile, F.sequence(F.lit(0).cast("long"), total - tile, F.lit(tile - overlap).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return F.array_union(regular, F.array(F.greatest(total - tile, F.lit(0).cast("long"))))


def tiles(scenes: DataFrame, tile: int, overlap: int = 0) -> DataFrame:
    """Adds x_off, y_off: one row per tile of (width, height)."""
    out = scenes.withColumn("y_off", F.explode(offsets(F.col("height").cast("long"), tile, overlap)))
    return out.withColumn("x_off", F.explode(offsets(F.col("width").cast("long"), tile, overlap)))


def label_box(col: Column, row: Column, length_m: Column, default_px: float = 8.0) -> tuple[Column, ...]:
    """A square around a label: its length in pixels, at least 4; the default without a length."""
    side = F.when(length_m.isNull() | F.isnan(length_m), F.lit(default_px)).otherwise(F.greatest(length_m / 10.0, F.lit(4.0)))
    return col - side / 2, row - side / 2, col + side / 2, row + side / 2


def keep_labels(labels: DataFrame) -> DataFrame:
    """Adds keep: a certain vessel of high or medium confidence."""
    return labels.withColumn("keep", F.coalesce(F.col("is_vessel"), F.lit(False)) & F.upper(F.col("confidence")).isin("HIGH", "MEDIUM"))


def labels_in_windows(labels: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Labels per window (half-open): its kept boxes, clipped and normalised; a window with a rejected label goes."""
    key = lambda c: F.floor(F.col(c) / size).cast("long")
    w = windows.withColumn("_cx", F.explode(F.sequence(key("x_off"), F.floor((F.col("x_off") + size - 1) / size).cast("long"))))
    w = w.withColumn("_cy", F.explode(F.sequence(key("y_off"), F.floor((F.col("y_off") + size - 1) / size).cast("long"))))
    l = labels.withColumnRenamed("scene_id", "_scene")  # noqa: E741
    inside = (F.col("col") >= F.col("x_off")) & (F.col("col") < F.col("x_off") + size) & (F.col("row") >= F.col("y_off")) & (F.col("row") < F.col("y_off") + size)
    pairs = w.join(l, (F.col("scene_id") == F.col("_scene")) & (F.col("_cx") == F.floor(F.col("col") / size)) & (F.col("_cy") == F.floor(F.col("row") / size)) & inside)
    clip = lambda c, off: F.least(F.greatest(F.col(c) - F.col(off), F.lit(0.0)), F.lit(float(size)))
    x1, x2, y1, y2 = clip("x1", "x_off"), clip("x2", "x_off"), clip("y1", "y_off"), clip("y2", "y_off")
    box = F.struct(((x1 + x2) / 2 / size).alias("cx"), ((y1 + y2) / 2 / size).alias("cy"), ((x2 - x1) / size).alias("w"), ((y2 - y1) / size).alias("h"))
    out = pairs.groupBy("scene_id", "x_off", "y_off").agg(F.bool_or(~F.col("keep")).alias("reject"), F.sort_array(F.collect_list(F.when(F.col("keep"), box))).alias("boxes"))
    return out.filter(~F.col("reject")).drop("reject")


def seeded(key: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) per key and seed, from an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def pool_pixels(pixels: DataFrame, f: int) -> DataFrame:
    """(x, y, v) pixels to the maxima of f by f blocks: the relational form of ``max_pool``."""
    block = lambda c: F.floor(F.col(c) / f).cast("long").alias(c)
    return pixels.groupBy(block("x"), block("y")).agg(F.max("v").alias("v"))


def mask_share(pixels: DataFrame) -> DataFrame:
    """Per scene, the mean of a 0..255 mask as a share: how much of the fetch holds data."""
    return pixels.groupBy("scene_id").agg((F.avg("mask") / 255).alias("share"))


def cap_backgrounds(chips: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Positive chips, and as many empty ones as ``share`` of the whole allows, chosen by a seeded hash."""
    keep = chips.agg(F.floor(F.count_if("positive") * F.lit(share) / F.lit(1 - share)).cast("long").alias("_keep"))
    return chips.filter("positive").unionByName(first_by(chips.filter(~F.col("positive")), (seeded(F.col("chip_id"), seed) * (1 << 52)).cast("long"), "chip_id", keep))


#: Bits of a rank's histogram: 2 ** 16 counts at most are put in order in one task.
_RANK_BITS = 16


def first_by(rows: DataFrame, place: Column, tie: str, keep: DataFrame) -> DataFrame:
    """The ``_keep`` rows that come first by ``place`` (0 to 2 ** 52), then by ``tie``; keep: one row of one number.

    A histogram of the places' high bits shows which counts are wholly in and which one holds the
    cut, one of the next bits splits that one again; only the rest, about a row in
    2 ** 32, is put in order. No task gets the rows that are kept, none waits for a count.
    """
    out = rows.withColumn("_place", place).crossJoin(F.broadcast(keep)).withColumn("_before", F.lit(0).cast("long"))  # one row
    inside, shift, keys = None, 52, []
    for level in range(2):
        shift -= _RANK_BITS
        key = f"_b{level}"
        keys.append(key)
        out = out.withColumn(key, F.shiftright("_place", shift).bitwiseAND(F.lit((1 << _RANK_BITS) - 1)))
        counts = out.groupBy(key).agg(F.count("*").alias("_n"))
        ahead = counts.select(key, "_n", (F.sum("_n").over(Window.orderBy(key)) - F.col("_n")).alias("_ahead"))
        out = out.join(F.broadcast(ahead), key)  # 2 ** 16 rows at most
        out = out.withColumn("_before", F.col("_before") + F.col("_ahead")).filter(F.col("_before") < F.col("_keep"))
        whole = (F.col("_before") + F.col("_n")) <= F.col("_keep")
        kept = out.filter(whole).select(*rows.columns)
        inside = kept if inside is None else inside.unionByName(kept)
        out = out.filter(~whole).drop("_n", "_ahead")
    cut = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_place", tie)))
    return inside.unionByName(cut.filter(F.col("_before") + F.col("_rank") <= F.col("_keep")).select(*rows.columns))


def hold_out(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Adds split (train or val) by a seeded hash of the key: the same at every run."""
    return rows.withColumn("split", F.when(seeded(F.col(key), seed) < share, "val").otherwise("train"))


def sigma_db(dn: Column, sigma: Column) -> Column:
    """Calibrated backscatter in dB; a digital number of 0 is no data."""
    return F.when(dn != 0, 10.0 * F.log10(dn * dn / (sigma * sigma))).otherwise(F.lit(float("nan")))


# detections -------------------------------------------------------------------------------------


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def merge_boxes(boxes: pd.DataFrame, iou_threshold: float = 0.5, min_px: float = 15.0) -> pd.DataFrame:
    """Non-maximum suppression from the most confident on: a box goes when it overlaps a kept one or sits too near.

    Kept centres are looked up by grid cell, so only neighbours are compared.
    """
    if not len(boxes):
        return boxes
    ordered = boxes.sort_values("confidence", ascending=False, kind="stable")
    b = ordered[["x1", "y1", "x2", "y2"]].to_numpy()
    side = max(min_px, float(np.max(np.maximum(b[:, 2] - b[:, 0], b[:, 3] - b[:, 1])))) or 1.0
    grid: dict[tuple[int, int], list[int]] = {}
    keep = []
    for i in range(len(b)):
        cx, cy = (b[i, 0] + b[i, 2]) / 2, (b[i, 1] + b[i, 3]) / 2
        at = (int(cx // side), int(cy // side))
        near = [k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in grid.get((at[0] + dx, at[1] + dy), ())]
        if all(iou(b[i], b[k]) < iou_threshold and np.hypot(cx - (b[k, 0] + b[k, 2]) / 2, cy - (b[k, 1] + b[k, 3]) / 2) >= min_px for k in near):
            keep.append(i)
            grid.setdefault(at, []).append(i)
    return ordered.iloc[keep]


def suppress(boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``merge_boxes`` per scene over (scene_id, x1, y1, x2, y2, confidence, ...)."""
    min_px = p.min_separation_m / p.pixel_m
    return boxes.groupBy("scene_id").applyInPandas(lambda pdf: merge_boxes(pdf, p.iou_threshold, min_px), boxes.schema)


Detector = Callable[[np.ndarray], list[tuple[float, float, float, float, float]]]


def bright_regions(tile: np.ndarray, level: int = 200, least_px: int = 4) -> list[tuple[float, float, float, float, float]]:
    """Boxes of connected bright pixels with their mean brightness: a stand-in where no trained detector is given."""
    mask = tile >= level
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        grown = label.copy()
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(label, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = 0
                grown = np.maximum(grown, np.where(mask, moved, 0))
        if (grown == label).all():
            break
        label = grown
    out = []
    for k in np.unique(label[label > 0]):
        ys, xs = np.nonzero(label == k)
        if len(xs) >= least_px:
            out.append((float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1), float(tile[ys, xs].mean() / 255)))
    return out


def detect(tile_rows: DataFrame, detector: Detector = bright_regions, p: Params = DEFAULT) -> DataFrame:
    """(scene_id, x_off, y_off, w, h, pixels) tiles to merged boxes in scene pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                tile = np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w)
                rows += [(r.scene_id, x1 + r.x_off, y1 + r.y_off, x2 + r.x_off, y2 + r.y_off, c) for x1, y1, x2, y2, c in detector(tile) if c >= p.conf_threshold]
            yield pd.DataFrame(rows, columns=["scene_id", "x1", "y1", "x2", "y2", "confidence"])

    raw = tile_rows.mapInPandas(run, "scene_id string, x1 double, y1 double, x2 double, y2 double, confidence double")
    return suppress(raw, p)


def located(boxes: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, lon, lat, confidence) of merged boxes: their centres, by each scene's extent and size in pixels.

    scenes: id, width, height and the extent min_lon .. max_lat.
    """
    extent = ("min_lon", "min_lat", "max_lon", "max_lat")
    rows = boxes.join(scenes.select(F.col("id").alias("scene_id"), "width", "height", *extent), "scene_id")
    lon, lat = geo.pixel_to_lon("(x1 + x2) / 2e0", "width", extent), geo.pixel_to_lat("(y1 + y2) / 2e0", "height", extent)
    return rows.select("scene_id", F.expr(lon).alias("lon"), F.expr(lat).alias("lat"), "confidence")


# arrays -----------------------------------------------------------------------------------------


def to_uint8(db: np.ndarray, lo: float = -25.0, hi: float = 0.0) -> np.ndarray:
    """dB to 0..255 over a window; no data becomes 0."""
    scaled = np.rint((np.clip(db, lo, hi) - lo) / (hi - lo) * 255)
    return np.where(np.isfinite(db), scaled, 0).astype(np.uint8)


def from_uint8(pixels: np.ndarray, lo: float = -25.0, hi: float = 0.0) -> np.ndarray:
    return lo + pixels.astype(np.float64) / 255 * (hi - lo)


def restretch(pixels: np.ndarray, old: tuple[float, float], new: tuple[float, float]) -> np.ndarray:
    """Another dB window, which the old one must contain."""
    if new[0] < old[0] or new[1] > old[1] or new[0] >= new[1]:
        raise ValueError("the new window must lie inside the old one")
    return to_uint8(from_uint8(pixels, *old), *new)


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window, edges repeated, by running sums."""
    pad = size // 2
    out = a.astype(np.float64)
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (pad + 1, size - 1 - pad)
        c = np.cumsum(np.pad(out, width, mode="edge"), axis=axis)
        hi = np.take(c, np.arange(size, c.shape[axis]), axis)
        lo = np.take(c, np.arange(0, c.shape[axis] - size), axis)
        out = (hi - lo) / size
    return out


def lee_filter(a: np.ndarray, size: int = 5) -> np.ndarray:
    """Speckle filter: the local mean, corrected by how far the local variance outweighs the whole image's."""
    mean = box_mean(a, size)
    var = np.maximum(box_mean(a * a, size) - mean * mean, 0)
    return mean + var / (var + float(a.var()) + 1e-12) * (a - mean)


def max_pool(pixels: np.ndarray, most: int) -> np.ndarray:
    """Overview no larger than ``most`` a side: maxima over blocks, the edge repeated to fill the last."""
    f = -(-max(pixels.shape) // most)
    if f <= 1:
        return pixels
    h, w = (-(-n // f) * f for n in pixels.shape)
    padded = np.pad(pixels, ((0, h - pixels.shape[0]), (0, w - pixels.shape[1])), mode="edge")
    return padded.reshape(h // f, f, w // f, f).max((1, 3))


def split_mask(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """A fetched array to values and mask, where it has a second band."""
    if bands.ndim == 2:
        return bands, None
    return bands[..., 0], bands[..., 1] if bands.shape[-1] > 1 else None


def stitch(parts: list[tuple[int, int, np.ndarray]], width: int, height: int) -> np.ndarray:
    out = np.zeros((height, width), parts[0][2].dtype if parts else np.uint8)
    for x, y, a in parts:
        out[y : y + a.shape[0], x : x + a.shape[1]] = a
    return out


def expand_lut(lines: np.ndarray, pixels: list[np.ndarray], values: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """Calibration table to every pixel: along columns (flat beyond the ends), then along rows (linear, also beyond)."""
    cols = np.stack([np.interp(np.arange(width), p, v) for p, v in zip(pixels, values)])
    if len(lines) == 1:
        return np.repeat(cols, height, 0)
    rows = np.arange(height)
    k = np.clip(np.searchsorted(lines, rows, "right") - 1, 0, len(lines) - 2)
    w = ((rows - lines[k]) / (lines[k + 1] - lines[k]))[:, None]
    return cols[k] * (1 - w) + cols[k + 1] * w


def calibrate(dn: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(dn != 0, 10 * np.log10(dn.astype(np.float64) ** 2 / sigma**2), np.nan)


# sinks and lookups ------------------------------------------------------------------------------


def stripes(rasters: DataFrame, rows: int = 2048) -> DataFrame:
    """One row per stripe of (height): y_off and h, so a raster is never held whole."""
    out = rasters.withColumn("y_off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1, F.lit(rows).cast("long"))))
    return out.withColumn("h", F.least(F.lit(rows).cast("long"), F.col("height") - F.col("y_off")))


def write_chips(chips: DataFrame, path: str) -> None:
    """Chips and their label lines (class, centre, size) by split."""
    line = F.array_join(F.transform("boxes", lambda b: F.format_string("0 %.6f %.6f %.6f %.6f", b["cx"], b["cy"], b["w"], b["h"])), "\n")
    chips.withColumn("labels", line).select("split", "chip_id", "pixels", "labels").write.mode("overwrite").partitionBy("split").parquet(path)


def scene_for_product(products: DataFrame, labels: DataFrame) -> DataFrame:
    """(product) to scene_id by the label table's product column, suffixes off; null where none matches."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.SAFE(\.zip)?$", "")
    known = labels.select(stem(F.col("GRD_product_identifier")).alias("_stem"), "scene_id").dropDuplicates(["_stem"])
    return products.withColumn("_stem", stem(F.col("product"))).join(known, "_stem", "left").drop("_stem")
