"""Crop geometry as column expressions; everything here stays inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack of the test whether a window had to move, in pixels.
TOLERANCE = 1e-6


def base_side(w: Column, h: Column, mode: str = "max") -> Column:
    """One side for a box of w x h."""
    sides = {
        "max": lambda: F.greatest(w, h),
        "mean": lambda: (w + h) / 2.0,
        "width": lambda: w,
        "height": lambda: h,
        "diag": lambda: F.sqrt(w * w + h * h) / F.sqrt(F.lit(2.0)),
    }
    if mode not in sides:
        raise ValueError(f"base side must be one of {', '.join(sides)}, not {mode!r}")
    return sides[mode]()


def choose_tier(measure: Column, sizes: Sequence[int], min_ratio: float) -> Column:
    """The largest size of which `measure` has the share min_ratio, or null."""
    out = F.lit(None).cast("int")
    for size in sorted(set(sizes)):
        out = F.when(measure >= min_ratio * size, F.lit(size)).otherwise(out)
    return out


def clamp(value: Column, low: Column, high: Column) -> Column:
    """value within [low, high]; low where the range is inverted."""
    return F.when(high < low, low).otherwise(F.greatest(low, F.least(high, value)))


def _whole_px(x: Column) -> Column:
    return F.rint(x).cast("long").cast("string")


def too_small(what: str, measure: Column, sizes: Sequence[int], min_ratio: float) -> Column:
    least = min(sizes)
    return F.concat(F.lit(f"{what} is "), _whole_px(measure), F.lit("px, needs >="), _whole_px(F.lit(min_ratio * least)), F.lit(f"px for the {least} tier"))


def plan_crops(df: DataFrame, *, padding: float = 0.2, sizes: Sequence[int] = (256, 512, 768, 1024), min_ratio: float = 0.8, mode: str = "max", offset_x: float = 0.0, offset_y: float = 0.0, edge: str = "shift") -> DataFrame:
    """Adds tier, base_side, padded_side, fitted_side, crop_x, crop_y, clamped, extends and reject.

    df has x, y, w, h of a region and iw, ih of its image. reject is null for a plan that holds;
    the plan's other columns are null where it does not.
    """
    if padding < 0 or not sizes:
        raise ValueError("padding must not be negative, and there must be a size")
    if edge not in ("shift", "extend", "skip"):
        raise ValueError(f"edge must be shift, extend or skip, not {edge!r}")
    base = base_side(F.col("w"), F.col("h"), mode)
    df = df.withColumn("base_side", base).withColumn("padded_side", F.col("base_side") * (1.0 + 2.0 * padding))
    first = choose_tier(F.col("base_side"), sizes, min_ratio)
    cx = F.col("x") + F.col("w") / 2.0 + offset_x * F.col("base_side")
    cy = F.col("y") + F.col("h") / 2.0 + offset_y * F.col("base_side")
    df = df.withColumns({"_first": first, "_cx": cx, "_cy": cy})
    small = F.when(F.col("base_side") <= 0, "degenerate detection box").when(F.col("_first").isNull(), too_small("detection", F.col("base_side"), sizes, min_ratio))
    if edge == "extend":
        df = df.withColumn("fitted_side", F.col("padded_side"))
        df = df.withColumns({"crop_x": F.col("_cx") - F.col("fitted_side") / 2.0, "crop_y": F.col("_cy") - F.col("fitted_side") / 2.0})
        out = (F.col("crop_x") < 0) | (F.col("crop_y") < 0) | (F.col("crop_x") + F.col("fitted_side") > F.col("iw")) | (F.col("crop_y") + F.col("fitted_side") > F.col("ih"))
        df = df.withColumns({"clamped": F.lit(False), "extends": out, "reject": small, "tier": F.col("_first")})
    else:
        df = df.withColumn("fitted_side", F.least(F.col("padded_side"), F.least("iw", "ih")))
        half = F.col("fitted_side") / 2.0
        df = df.withColumns({
            "crop_x": clamp(F.col("_cx") - half, F.lit(0.0), F.col("iw") - F.col("fitted_side")),
            "crop_y": clamp(F.col("_cy") - half, F.lit(0.0), F.col("ih") - F.col("fitted_side")),
        })
        moved = (F.abs(F.col("crop_x") + half - F.col("_cx")) > TOLERANCE) | (F.abs(F.col("crop_y") + half - F.col("_cy")) > TOLERANCE)
        df = df.withColumn("clamped", (F.col("fitted_side") < F.col("padded_side") - TOLERANCE) | moved)
        # only a window tighter than the detection itself needs another tier
        df = df.withColumn("tier", F.when(F.col("fitted_side") < F.col("base_side"), choose_tier(F.col("fitted_side"), sizes, min_ratio)).otherwise(F.col("_first")))
        reject = small
        if edge == "skip":
            reject = reject.when(F.col("clamped"), "padded crop does not fit inside the image")
        reject = reject.when(F.col("tier").isNull(), F.concat(F.lit("crop shrank to "), _whole_px(F.col("fitted_side")), F.lit("px to fit the image")))
        df = df.withColumns({"extends": F.lit(False), "reject": reject})
    ok = F.col("reject").isNull()
    for name in ("tier", "fitted_side", "crop_x", "crop_y", "clamped", "extends"):
        df = df.withColumn(name, F.when(ok, F.col(name)))
    return df.drop("_first", "_cx", "_cy")


def plan_whole(iw: Column, ih: Column, sizes: Sequence[int], min_ratio: float = 0.8) -> dict[str, Column]:
    """The whole image at the largest size that its long side fills."""
    long_side = F.greatest(iw, ih)
    tier = choose_tier(long_side, sizes, min_ratio)
    return {"tier": tier, "base_side": long_side, "reject": F.when(tier.isNull(), too_small("image", long_side, sizes, min_ratio))}


def plan_native(iw: Column, ih: Column, min_side: int = 256, max_side: int = 1536) -> dict[str, Column]:
    """The whole image at its own size, at most max_side."""
    long_side = F.greatest(iw, ih)
    tier = F.when(long_side >= min_side, F.least(long_side, F.lit(float(max_side))).cast("int"))
    reject = F.when(tier.isNull(), F.concat(F.lit("image is "), _whole_px(long_side), F.lit(f"px, needs >={min_side}px")))
    return {"tier": tier, "base_side": long_side, "reject": reject}


def rounded_box(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """Pixel edges, each rounded half to even; at least one pixel wide and high."""
    left, top = F.rint(x).cast("long"), F.rint(y).cast("long")
    return {"left": left, "top": top, "right": F.greatest(F.rint(x + w).cast("long"), left + 1), "bottom": F.greatest(F.rint(y + h).cast("long"), top + 1)}


def output_size(w: Column, h: Column, tier: Column) -> dict[str, Column]:
    """Output width and height: the long side is the tier, the other keeps the shape, at least 1."""
    long_side = F.greatest(w, h)
    fit = lambda side: F.when(side == long_side, tier.cast("long")).otherwise(F.greatest(F.rint(side * tier / long_side).cast("long"), F.lit(1)))
    return {"out_w": fit(w), "out_h": fit(h)}


def project_box(box: dict[str, Column], window: dict[str, Column], out_w: Column, out_h: Column) -> dict[str, Column]:
    """A source box in the pixels of an output that shows the rounded window."""
    sx = out_w / (window["right"] - window["left"])
    sy = out_h / (window["bottom"] - window["top"])
    return {"px": (box["x"] - window["left"]) * sx, "py": (box["y"] - window["top"]) * sy, "pw": box["w"] * sx, "ph": box["h"] * sy}


def iou(a: Column, b: Column) -> Column:
    """Overlap of two structs x, y, w, h over their union; 0 for empty boxes."""
    side = lambda p, q: F.greatest(F.least(a[p] + a[q], b[p] + b[q]) - F.greatest(a[p], b[p]), F.lit(0.0))
    shared = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
