"""From detections to regions: filters, ranks, suppression and the choice of regions per image.

Frames of detections have one row for a region: image_id, det (the detector's own order), x, y,
w, h, score, label. Detectors themselves are plug-ins: see `Detector`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions.geometry import iou

REGION = "struct<x:double,y:double,w:double,h:double,score:double,label:string,landmarks:map<string,struct<x:double,y:double>>>"
BOX = "struct<x:double,y:double,w:double,h:double,score:double,det:long>"


class Detector(Protocol):
    """What finds regions in one decoded image; built once for each Python worker."""

    #: Added to the vertical recentring where none is set.
    offset_y: float
    #: Whether `detect` wants its channels as blue, green, red.
    bgr: bool

    def detect(self, image: object) -> list[dict]: ...


_detectors: dict[str, Callable[..., Detector]] = {}


def register_detector(name: str, factory: Callable[..., Detector]) -> None:
    _detectors[name] = factory


def detector(name: str) -> Callable[..., Detector]:
    """The factory of a detector, looked up on the driver and sent to the workers."""
    if name not in _detectors:
        raise ValueError(f"no detector {name!r}; there are {', '.join(sorted(_detectors)) or 'none'}")
    return _detectors[name]


def regions_in(found_by: Detector, image: np.ndarray) -> list[dict]:
    return found_by.detect(np.ascontiguousarray(image[:, :, ::-1]) if getattr(found_by, "bgr", False) else image)


def detect(images: DataFrame, name: str, decode: Callable[[bytes], object], **options: object) -> DataFrame:
    """(image_id, regions array, offset_y, error) of images (image_id, content); an image's error drops all its regions."""
    import pandas as pd

    factory = detector(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = factory(**options)
        offset = float(getattr(own, "offset_y", 0.0))
        for frame in frames:
            rows = []
            for image_id, content in zip(frame["image_id"], frame["content"]):
                try:
                    rows.append((image_id, regions_in(own, decode(content)), offset, ""))
                except Exception as error:  # contained: one bad photo must not stop a run
                    rows.append((image_id, [], offset, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["image_id", "regions", "offset_y", "error"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "content").mapInPandas(run, f"image_id {kind}, regions array<{REGION}>, offset_y double, error string")


def regions_of(detected: DataFrame) -> DataFrame:
    """One row for each region, in the detector's order; images with an error have none."""
    rows = detected.where("error = ''").select("image_id", "offset_y", F.posexplode("regions").alias("det", "r"))
    return rows.select("image_id", "det", "offset_y", "r.*")


def by_score(regions: DataFrame, least: float) -> DataFrame:
    return regions.where(F.col("score") >= least)


def class_names(spec: str | Sequence[str], known: Sequence[str]) -> list[str]:
    """Names of classes: comma-separated or a list, `_` for a space; none or `all` is every class."""
    names = spec.split(",") if isinstance(spec, str) else list(spec)
    names = [n.strip().lower().replace("_", " ") for n in names if n.strip()]
    unknown = sorted({*names} - {*known} - {"all"})
    if unknown:
        raise ValueError(f"unknown classes: {', '.join(unknown)}")
    return [] if "all" in names else list(dict.fromkeys(names))


def by_class(regions: DataFrame, names: Sequence[str]) -> DataFrame:
    return regions.where(F.col("label").isin(list(names))) if names else regions


def largest_first(*more: str) -> W:
    """Within an image: by falling area, then in the detector's order."""
    return W.partitionBy("image_id").orderBy((F.col("w") * F.col("h")).desc(), "det", *more)


def with_rank(regions: DataFrame) -> DataFrame:
    return regions.withColumn("rank", F.row_number().over(largest_first()) - 1)


def pick(regions: DataFrame, multi: str = "all", most: int = 0) -> DataFrame:
    """What several regions of one image come to: all, the largest, or none; then at most `most`."""
    if multi not in ("all", "largest", "skip"):
        raise ValueError(f"multi must be all, largest or skip, not {multi!r}")
    ranked = with_rank(regions)
    if multi == "skip":
        ranked = ranked.withColumn("_n", F.count("*").over(W.partitionBy("image_id"))).where("_n = 1").drop("_n")
    limit = min([x for x in (1 if multi == "largest" else 0, most) if x], default=0)
    return ranked.where(F.col("rank") < limit) if limit else ranked


def several(regions: DataFrame) -> DataFrame:
    """Images that the skip policy drops: image_id, reason, detail."""
    counted = regions.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1")
    return counted.select("image_id", F.lit("multi").alias("reason"), F.concat(F.col("n").cast("string"), F.lit(" detections")).alias("detail"))


def undetected(images: DataFrame, regions: DataFrame) -> DataFrame:
    return images.join(regions, "image_id", "left_anti").select("image_id", F.lit("no_detection").alias("reason"))


def one_per_photo(regions: DataFrame) -> DataFrame:
    """The first region of each image with the boxes of all of them, in order."""
    boxes = F.sort_array(F.collect_list(F.struct("rank", "x", "y", "w", "h")).over(W.partitionBy("image_id")))
    return with_rank(regions).withColumn("boxes", boxes).where("rank = 0")


def whole_image(images: DataFrame) -> DataFrame:
    """One made-up region for the whole image, where detection is skipped."""
    return images.select("image_id", F.lit(0).alias("det"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("iw").alias("w"), F.col("ih").alias("h"), F.lit(0.0).alias("score"), F.lit("image").alias("label"))


def suppress(regions: DataFrame, overlap: float = 0.45) -> DataFrame:
    """Greedy suppression within (image, label): by falling score, a box goes that overlaps a kept one more.

    A fold over the sorted boxes of one image and class, which a detector bounds.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("x", "y", "w", "h", "score", "det")),
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["det"] < b["det"], -1).when(a["det"] > b["det"], 1).otherwise(0),
    )
    kept = F.aggregate("boxes", F.expr(f"cast(array() as array<{BOX}>)"), lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > overlap), acc).otherwise(F.concat(acc, F.array(b))))
    grouped = regions.select("image_id", "label", "x", "y", "w", "h", "score", F.col("det").cast("long").alias("det")).groupBy("image_id", "label").agg(ordered.alias("boxes"))
    return grouped.select("image_id", "label", F.inline(kept))


# -- detector post-processing --------------------------------------------------


def letterbox_ratio(iw: Column, ih: Column, side: float = 640.0) -> Column:
    return F.least(side / ih, side / iw)


def unletterbox(x: Column, y: Column, w: Column, h: Column, ratio: Column, iw: Column, ih: Column) -> dict[str, Column]:
    """Boxes in source pixels, clipped to the image."""
    left, top = F.greatest(x / ratio, F.lit(0.0)), F.greatest(y / ratio, F.lit(0.0))
    right, bottom = F.least((x + w) / ratio, iw), F.least((y + h) / ratio, ih)
    return {"left": left, "top": top, "width": right - left, "height": bottom - top}


def anchors(side: int = 640, strides: Sequence[int] = (8, 16, 32)) -> list[tuple[int, int, int]]:
    """(grid x, grid y, stride) of every anchor."""
    return [(c, r, s) for s in strides for r in range(side // s) for c in range(side // s)]


def decode_anchor(dx: Column, dy: Column, dw: Column, dh: Column, gx: Column, gy: Column, stride: Column) -> dict[str, Column]:
    """Centre and size of an anchor's box; exponents are clipped."""
    size = lambda d: F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), d))) * stride
    return {"cx": (dx + gx) * stride, "cy": (dy + gy) * stride, "w": size(dw), "h": size(dh)}


def best_class(objectness: Column, classes: Column) -> dict[str, Column]:
    """(index of the first of the best classes, from 0; its confidence)."""
    top = F.array_max(classes)
    return {"class_index": (F.array_position(classes, top) - 1).cast("int"), "confidence": objectness * top}


def squash(weight: Column) -> Column:
    """A cascade's weight as a score."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight / 5.0))


def offset_y(configured: float | None, default: Column) -> Column:
    """A configured offset counts, even 0; else the detector's own."""
    return F.coalesce(F.lit(configured).cast("double"), default)
