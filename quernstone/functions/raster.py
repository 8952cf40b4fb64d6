"""Small rasters as row-major arrays: higher-order functions only, folded from left to right."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.captions import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.nullif(F.size(values), F.lit(0))


def spread(values: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(variance(values))


def columns(values: Column, width: int, first: int, last: int) -> Column:
    """The pixels of the columns first to last - 1, in row order."""
    return F.filter(values, lambda _, i: (i % width >= first) & (i % width < last))


def mirrored(k: Column, n: int) -> Column:
    """An index reflected at the first and last element, which are not repeated."""
    return F.when(k < 0, -k).when(k >= n, F.lit(2 * n - 2) - k).otherwise(k)


def at(values: Column, width: int, height: int, row: Column, column: Column) -> Column:
    return F.element_at(values, (mirrored(row, height) * width + mirrored(column, width) + 1).cast("int"))


def laplacian(values: Column, width: int, height: int) -> Column:
    """Sum of the four neighbours less four times the pixel, mirrored at the border."""

    def pixel(i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), (i % width).cast("int")
        near = at(values, width, height, r - 1, c) + at(values, width, height, r + 1, c) + at(values, width, height, r, c - 1) + at(values, width, height, r, c + 1)
        return near - 4.0 * F.element_at(values, (i + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def variance(values: Column) -> Column:
    return let(values, lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: (x - m) * (x - m)))))


def saturation(red: Column, green: Column, blue: Column) -> Column:
    """Mean over pixels of the largest less the smallest channel."""
    channels = F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b"))
    return mean(F.transform(channels, lambda p: F.greatest(p["r"], p["g"], p["b"]) - F.least(p["r"], p["g"], p["b"])))


def inner_fraction(padding: float) -> float:
    """Share of a padded crop that the detection itself fills, at least one half."""
    return max(0.5, min(1.0, 1.0 / (1.0 + 2.0 * padding)))


def inner(values: Column, width: int, height: int, fraction: float) -> tuple[Column, int, int]:
    """(the central window, its width, its height)."""
    mx, my = int(width * (1 - fraction) / 2), int(height * (1 - fraction) / 2)
    rows = F.filter(values, lambda _, i: (i >= my * width) & (i < (height - my) * width))
    return columns(rows, width, mx, width - mx), width - 2 * mx, height - 2 * my


def normalised(values: Column, centre: float, scale: float) -> Column:
    return F.transform(values, lambda x: (x - centre) / scale)


def sigmoid(values: Column, most: float = 80.0) -> Column:
    return F.transform(values, lambda x: 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), x)))))


def softmax(values: Column) -> Column:
    powers = let(values, lambda v: let(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp(x - most))))
    return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda x: x / t)))


def ramp(values: Column, low: float = 0.3, width: float = 0.4) -> Column:
    """0 up to low, 1 from low + width, straight between."""
    return F.transform(values, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / width)))


def compose(person: Column, clothing: Column, face: Column, background: float = 0.1, clothing_weight: float = 0.0) -> Column:
    """Loss weights 0 to 255: the least of what background, clothing and face leave."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    kept = F.zip_with(person, clothing, lambda p, c: F.least(F.lit(1.0), background + (1.0 - background) * unit(p), 1.0 - (1.0 - clothing_weight) * unit(c)))
    return F.transform(F.zip_with(kept, face, lambda k, f: F.least(k, 1.0 - unit(f))), lambda x: F.rint(x * 255.0).cast("int"))


def union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def box(width: int, height: int, x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """1 inside a box, of the pixels it touches."""
    left, top, right, bottom = x.cast("int"), y.cast("int"), F.ceil(x2).cast("int"), F.ceil(y2).cast("int")

    def pixel(i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), (i % width).cast("int")
        return F.when((c >= left) & (c < right) & (r >= top) & (r < bottom), 1.0).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def share(values: Column, least: float = 0.5) -> Column:
    """Share of pixels of at least `least`, to three places."""
    return F.rint(F.size(F.filter(values, lambda x: x >= least)) / F.size(values) * 1000.0) / 1000.0


def pad(values: Column, width: int, height: int, by: int, mode: str) -> Column:
    """Padded by `by` pixels on all sides; reflect falls back to edge where the raster is too small for it."""
    if mode == "reflect" and by >= min(width, height):
        mode = "edge"
    wide, high = width + 2 * by, height + 2 * by

    def place(k: Column, n: int) -> Column:
        return mirrored(k, n) if mode == "reflect" else F.greatest(F.lit(0), F.least(F.lit(n - 1), k))

    def pixel(i: Column) -> Column:
        r, c = F.floor(i / wide).cast("int") - by, (i % wide).cast("int") - by
        return F.element_at(values, (place(r, height) * width + place(c, width) + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(wide * high - 1)), pixel)


def oval(width: int, height: int, x: Column, y: Column, w: Column, h: Column, margin: float = 0.35, lift: float = 0.12) -> Column:
    """0 inside the ellipse around a lifted box grown by margin of its larger side, else 255."""
    side = F.greatest(w, h)
    rx, ry = w / 2.0 + margin * side, h / 2.0 + margin * side
    cx, cy = x + w / 2.0, y + h / 2.0 - lift * h

    def pixel(i: Column) -> Column:
        dx, dy = ((i % width) + 0.5 - cx) / rx, (F.floor(i / width) + 0.5 - cy) / ry
        return F.when(dx * dx + dy * dy <= 1.0, 0).otherwise(255)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def components(on: Column, width: int, height: int) -> Column:
    """8-connected labels of a 0/1 raster (0: off; else the largest index plus one of its blob).

    Arrow batches of rasters at once: every pixel takes the largest label around it until none
    changes, and then that of its label, so that labels travel far in few sweeps. Null for a null
    raster, and an error for one of another size.
    """

    @F.pandas_udf("array<int>")
    def labels(rasters: pd.Series) -> pd.Series:
        there = rasters.notna()
        out = pd.Series([None] * len(rasters), dtype=object)
        if there.any():
            lit = np.stack([np.asarray(r, np.int32).reshape(height, width) for r in rasters[there]]) > 0
            found = blobs(lit).reshape(len(lit), -1)
            out[there.to_numpy()] = pd.Series(list(found), index=out.index[there.to_numpy()])
        return out

    return labels(on)


def blobs(lit: np.ndarray) -> np.ndarray:
    """Labels of many rasters (n, height, width) of booleans."""
    n, height, width = lit.shape
    own = np.where(lit, np.arange(1, height * width + 1, dtype=np.int32).reshape(height, width), 0)
    while True:
        wide = np.pad(own, ((0, 0), (1, 1), (1, 1)))
        near = own
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                near = np.maximum(near, wide[:, dy : dy + height, dx : dx + width])
        near = np.where(lit, near, 0).reshape(n, -1)
        # the label's own pixel may know a larger one
        near = np.where(near > 0, np.take_along_axis(near, np.maximum(near - 1, 0), 1), 0).reshape(lit.shape).astype(np.int32)
        if np.array_equal(near, own):
            return own
        own = near
