"""Rasters as tables of lines: calibration, speckle filter and scaling by stripes, so no raster is held whole.

A line is (raster, y, dn): one row of an image, its digital numbers as doubles, 0 where there is
no data. Lines of a raster have one length and one y each. A line that is missing or null counts as
no data, as does a number that is null or not finite; entries of a calibration table that
are so are left out, and lines of a raster without a table are left out of the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.raster import box_mean


def spans_of_table(table: DataFrame) -> DataFrame:
    """(raster, line, pixels, sigmas) to the pairs of neighbouring table lines and the lines each pair serves.

    The first pair also serves what lies above it, the last what lies below; a table of one
    line is a pair with itself. A table has tens of lines a raster, by its format.
    """
    w = Window.partitionBy("raster").orderBy("line")
    pairs = table.select("raster", "line", "pixels", "sigmas", *(F.lead(c).over(w).alias(f"{c}_b") for c in ("line", "pixels", "sigmas")), F.row_number().over(w).alias("_k"), F.count("*").over(Window.partitionBy("raster")).alias("_n"))
    one = F.col("_n") == 1
    pairs = pairs.filter(F.col("line_b").isNotNull() | one)
    low, high = F.when(F.col("_k") > 1, F.col("line")), F.when(F.col("_k") < F.col("_n") - 1, F.col("line_b"))
    same = lambda c: F.when(one, F.col(c)).otherwise(F.col(f"{c}_b")).alias(f"{c}_b")
    return pairs.select("raster", "line", "pixels", "sigmas", same("line"), same("pixels"), same("sigmas"), low.alias("_low"), high.alias("_high"))


def _along(x: np.ndarray, pixels, sigmas) -> np.ndarray:
    """A table line at every column, from its entries that are numbers."""
    p, s = np.asarray(pixels, np.float64), np.asarray(sigmas, np.float64)
    good = np.isfinite(p) & np.isfinite(s)
    return np.interp(x, p[good], s[good]) if good.any() else np.full(len(x), np.nan)


def backscatter(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Lines to (raster, y, value): linear backscatter (dn / sigma) squared, 0 where there is no data.

    Sigma is interpolated along the columns of two table lines (flat beyond their ends), then
    between these lines (linear, also beyond the last one).
    """
    lines, s = lines.filter(F.col("dn").isNotNull()), spans_of_table(table.dropna(subset=["pixels", "sigmas"]))
    at = (F.col("y") >= F.coalesce("_low", "y")) & (F.col("y") < F.coalesce("_high", F.col("y") + 1))
    met = lines.join(s, "raster").filter(at).drop("_low", "_high")

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                dn = np.asarray(r.dn, np.float64)
                x = np.arange(len(dn))
                near, far = _along(x, r.pixels, r.sigmas), _along(x, r.pixels_b, r.sigmas_b)
                w = (r.y - r.line) / (r.line_b - r.line) if r.line_b != r.line else 0.0
                with np.errstate(divide="ignore", invalid="ignore"):
                    v = (dn / (near * (1 - w) + far * w)) ** 2
                out.append(np.where((dn != 0) & np.isfinite(v), v, 0.0))
            yield pd.DataFrame({"raster": b["raster"], "y": b["y"], "value": out})

    kind = lines.schema["raster"].dataType.simpleString()
    return met.mapInPandas(run, f"raster {kind}, y long, value array<double>")


def lee_lines(lines: DataFrame, size: int = 5, rows: int = 2048) -> DataFrame:
    """``lee_filter`` of whole rasters over (raster, y, value): stripes of ``rows`` lines, each with the lines it needs above and below.

    The raster's variance is an aggregate of its own; a task holds one stripe. Results don't
    depend on the height of stripes. At the raster's edges the last line repeats.
    """
    halo = size // 2
    whole = lines.select("raster", "y", F.explode("value").alias("v")).groupBy("raster").agg(F.var_pop("v").alias("_var"), F.min("y").alias("_top"), F.max("y").alias("_end"))
    part = lambda c: F.floor(c / rows).cast("long")
    first, last = part(F.greatest(F.col("y") - halo, F.col("_top"))), part(F.least(F.col("y") + halo, F.col("_end")))
    dealt = lines.join(whole, "raster").withColumn("_stripe", F.explode(F.sequence(first, last)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stripe, var = int(pdf["_stripe"].iloc[0]), float(pdf["_var"].iloc[0])
        top = max(stripe * rows - halo, int(pdf["_top"].iloc[0]))
        end = min((stripe + 1) * rows - 1 + halo, int(pdf["_end"].iloc[0]))
        a = np.zeros((end - top + 1, len(pdf["value"].iloc[0])))
        for y, v in zip(pdf["y"], pdf["value"]):
            a[y - top] = v
        mean = box_mean(a, size)
        local = np.maximum(box_mean(a * a, size) - mean * mean, 0)
        out = mean + local / (local + var + 1e-12) * (a - mean)
        own = pdf[pdf["y"] // rows == stripe]
        return pd.DataFrame({"raster": own["raster"], "y": own["y"], "value": [out[y - top] for y in own["y"]]})

    kind = lines.schema["raster"].dataType.simpleString()
    return dealt.groupBy("raster", "_stripe").applyInPandas(run, f"raster {kind}, y long, value array<double>")


def scaled(db: Column, lo: float = -25.0, hi: float = 0.0) -> Column:
    """dB to 0..255 over a window, half-even."""
    return F.rint((F.least(F.greatest(db, F.lit(lo)), F.lit(hi)) - lo) / (hi - lo) * 255).cast("int")


def in_window(pixels: Column, old: tuple[float, float], new: tuple[float, float]) -> Column:
    """An array of 0..255 over another dB window, which the old one must contain."""
    if new[0] < old[0] or new[1] > old[1] or new[0] >= new[1]:
        raise ValueError("the new window must lie inside the old one")
    return F.transform(pixels, lambda v: scaled(v / 255.0 * (old[1] - old[0]) + old[0], *new))


def rendered(lines: DataFrame, table: DataFrame, size: int = 5, rows: int = 2048, lo: float = -25.0, hi: float = 0.0) -> DataFrame:
    """Lines to (raster, y, pixels): calibrated, filtered, in dB, scaled to 0..255; 0 where there is no data."""
    smooth = lee_lines(backscatter(lines, table), size, rows)
    both = smooth.join(lines.select("raster", F.col("y").cast("long").alias("y"), "dn"), ["raster", "y"])
    pixel = lambda v, dn: F.when((dn != 0) & (F.abs(dn) < float("inf")) & (v > 0), scaled(10.0 * F.log10(v), lo, hi)).otherwise(F.lit(0))
    return both.select("raster", "y", F.zip_with("value", "dn", pixel).alias("pixels"))
