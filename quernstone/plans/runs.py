"""Whole runs: photos to numbered crops with a manifest, captions for them, and rebuilding.

A crop run is one lazy plan up to its staging table: names and metadata are filtered before
content is read, finished sources leave by an anti-join before any image is decoded, regions are
chosen and planned as columns, and each image is decoded twice at most (detection, pixels). The
staging table holds the kept crops; numbers are given over it, so that a lost task cannot number
anew. An error inside an image drops all its crops and becomes one skip.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import __version__
from quernstone.config import TEMPLATE, Settings
from quernstone.functions import captions as cap
from quernstone.functions import geometry as geo
from quernstone.functions import pixels, raster
from quernstone.operators import detection, manifest, masks, numbering
from quernstone.sources import manifest as files
from quernstone.sources import scan

MARKS = "map<string,struct<x:double,y:double>>"

_captioners: dict[str, Callable[..., object]] = {}


def register_captioner(name: str, factory: Callable[..., object]) -> None:
    """factory(settings) gives an object with describe(list of dicts) -> list of texts."""
    _captioners[name] = factory


#: What writes a crop: encode(image, quality) by file extension. Others than PNG are plug-ins.
_encoders: dict[str, Callable[[object, int], bytes]] = {"png": lambda image, quality: pixels.encode_png(image)}


def register_encoder(extension: str, encode: Callable[[object, int], bytes]) -> None:
    _encoders[extension] = encode


#: What enlarges crops that are smaller than their size; none is built in.
_upscalers: list[Callable[[], object]] = []


def register_upscaler(factory: Callable[[], object]) -> None:
    """factory() gives an object with enlarge(image) -> larger image, built once for each worker."""
    _upscalers[:] = [factory]


def _whole(s: Settings) -> bool:
    return s.keep_size or s.no_crop or s.skip_detection


def _plans(regions: DataFrame, s: Settings) -> DataFrame:
    """Plans of the chosen regions, with all their boxes beside whole images."""
    if _whole(s):
        iw, ih = F.col("iw"), F.col("ih")
        if s.keep_size:
            plan = geo.plan_native(iw, ih, s.min_side, s.max_side)
        elif s.no_crop:
            plan = geo.plan_whole(iw, ih, s.sizes, s.min_ratio)
        else:
            plan = {"tier": F.greatest(iw, ih).cast("int"), "base_side": F.greatest(iw, ih), "reject": F.lit(None).cast("string")}
        out = detection.one_per_photo(regions).withColumns(plan)
        return out.withColumns({"padded_side": F.col("base_side"), "fitted_side": F.col("base_side"), "crop_x": F.lit(0.0), "crop_y": F.lit(0.0), "clamped": F.lit(False), "extends": F.lit(False), "crop_w": iw, "crop_h": ih})
    out = geo.plan_crops(regions, padding=s.padding, sizes=s.sizes, min_ratio=s.min_ratio, mode=s.base_mode, offset_x=s.offset_x, offset_y=F.col("offset_y"), edge=s.edge)
    boxes = F.array(F.struct("rank", "x", "y", "w", "h"))
    return out.withColumns({"crop_w": F.col("fitted_side"), "crop_h": F.col("fitted_side"), "boxes": boxes})


CUT = "image_id string, rank int, sharpness double, body binary, mask binary, masked_faces int, background_mask string, masked_clothing double, fate string, error string"
#: What a subject needs of pixels on either side to be measured alone.
SUBJECT = 16


def _cut(images: DataFrame, s: Settings, decode: Callable[[bytes], object]) -> DataFrame:
    """CUT columns: the crops of each image (image_id, content, plans), measured, masked and encoded.

    fate is "written", "blurry" or "no_face"; only the first has a body.
    """
    fraction = raster.inner_fraction(s.padding)
    encode = _encoders[s.extension]
    models = masks.needed(s.mask_faces, s.face_mask == "outline", s.mask_background, s.mask_clothing)
    finder = detection.detector(masks.FACES) if s.mask_faces else None
    enlarger = _upscalers[0] if s.upscale else None

    def crop(image: object, p: dict, faces: object, own: dict, larger: object) -> tuple:
        left, top = round(p["crop_x"]), round(p["crop_y"])
        right, bottom = max(left + 1, round(p["crop_x"] + p["crop_w"])), max(top + 1, round(p["crop_y"] + p["crop_h"]))
        out = pixels.window(image, left, top, right, bottom, s.fill, s.fill_color)
        longest = max(out.shape[:2])
        if larger and longest < p["tier"]:
            out = larger.enlarge(out)
        out = pixels.resize(out, *[max(1, round(n * p["tier"] / longest)) for n in (right - left, bottom - top)])
        sx, sy = out.shape[1] / (right - left), out.shape[0] / (bottom - top)
        boxes = [((b["x"] - left) * sx, (b["y"] - top) * sy, b["w"] * sx, b["h"] * sy) for b in p["boxes"]]
        if _whole(s):
            x, y, w, h = boxes[0]
            x0, y0, x1, y1 = max(0, int(x)), max(0, int(y)), min(out.shape[1], int(x + w)), min(out.shape[0], int(y + h))
            subject = out[y0:y1, x0:x1] if min(x1 - x0, y1 - y0) >= SUBJECT else out
            sharpness = round(pixels.sharpness(subject), 1)
        else:
            sharpness = round(pixels.sharpness(out, fraction), 1)
        if not s.skip_detection and sharpness < s.min_sharpness:
            return sharpness, None, None, 0, None, 0.0, "blurry"
        if not s.masks:
            return sharpness, encode(out, s.quality), None, 0, None, 0.0, "written"
        found = [(f["x"], f["y"], f["w"], f["h"]) for f in detection.regions_in(faces, out) if f["score"] >= s.mask_min_score] if faces else None
        if found == [] and s.mask_missing == "skip":
            return sharpness, None, None, 0, None, 0.0, "no_face"
        mask = masks.crop_mask(out, boxes, own, found, s.mask_margin, s.background_weight, s.clothing_weight)
        return sharpness, encode(out, s.quality), pixels.encode_png(mask.weights), mask.faces, mask.background, mask.clothing, "written"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        faces, own = finder() if finder else None, {k: factory() for k, factory in models.items()}
        larger = enlarger() if enlarger else None
        for frame in frames:
            rows = []
            for image_id, content, plans in zip(frame["image_id"], frame["content"], frame["plans"]):
                try:
                    image = decode(bytes(content))
                    rows += [(image_id, p["rank"], *crop(image, p, faces, own, larger), "") for p in plans]
                except Exception as error:  # contained: the image is skipped as a whole
                    rows.append((image_id, *[None] * 8, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[part.strip().split(" ")[0] for part in CUT.split(",")])

    return images.mapInPandas(run, CUT)


def writer(folder: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Writes the files (path, body) below a folder that all executors reach."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for path, body in zip(frame["path"], frame["body"]):
                target = f"{base}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(bytes(body))
            yield pd.DataFrame({"written": [len(frame)]})

    return run


def _remove(folder: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Deletes the files (path) below a folder; what is not there is no error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        for frame in frames:
            n = 0
            for path in frame["path"]:
                try:
                    system.delete_file(f"{base}/{path}")
                    n += 1
                except FileNotFoundError:
                    pass
            yield pd.DataFrame({"removed": [n]})

    return run


def overwrite(spark: SparkSession, output: str) -> int:
    """Removes the files that the manifest of an old run names, and those beside them; nothing else."""
    old = files.read(spark, f"{output}/manifest.jsonl")
    names = old.select(F.explode(F.array_union(manifest.side_files(F.col("image_file")), F.filter(F.array("caption_file", "mask_file"), lambda x: x.isNotNull()))).alias("path")).distinct()
    outside = [r["path"] for r in names.where(manifest.escapes(F.col("path"))).limit(5).collect()]
    if outside:
        raise ValueError(f"the old manifest names files outside its folder: {', '.join(outside)}")
    removed = names.mapInPandas(_remove(output), "removed long").agg(F.sum("removed")).first()[0] or 0
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/manifest.jsonl")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return removed


def training_run(spark: SparkSession, settings: Settings, output: str, template: dict | None = None) -> dict | None:
    """Writes training_config.json, a template filled from the manifest; None where no configuration applies.

    Only the resolution (unless sizes are native), the epochs and, with masks, the switches of
    masked training are filled in; all else of the template stays.
    """
    rows = files.read(spark, f"{output}/manifest.jsonl").select("tier", "mask_file", "mask_dir")
    native = settings.keep_size or settings.skip_detection and not settings.no_crop
    config = dict(template or {"resolution": "", "batch_size": 2})
    row = numbering.training_config(rows, settings.sizes, batch=config.get("batch_size") or 1, native=native).first()
    if row is None:
        return None
    config |= {"epochs": row["epochs"], "masked_training": row["masked_training"]} | ({"resolution": row["resolution"]} if row["resolution"] else {})
    if row["masked_training"]:
        config |= {"unmasked_probability": 0.0, "unmasked_weight": 0.0}
    elif template and "masked_training" in template:
        config["masked_training"] = template["masked_training"]
    spark.createDataFrame([("training_config.json", bytearray(json.dumps(config, indent=2).encode()))], "path string, body binary").mapInPandas(writer(output), "written long").collect()
    return config


def _below(root: str, folder: str) -> list[str]:
    """The folder's path under root, if it lies there."""
    bare = [re.sub(r"^[a-z]+:/*", "/", x.rstrip("/")) for x in (root, folder)]
    return [bare[1][len(bare[0]) + 1 :]] if bare[1].startswith(bare[0] + "/") else []


def _free(spark: SparkSession, targets: DataFrame, folder: str) -> None:
    """Raises if a file (path) of a new run is there already."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return
    there = scan.listed(spark, folder).select("path")
    taken = [r["path"] for r in targets.join(there, "path", "left_semi").limit(5).collect()]
    if taken:
        raise FileExistsError(f"already in {folder}: {', '.join(sorted(taken))}; overwrite, resume, or take an empty folder")


def crop_run(spark: SparkSession, settings: Settings, root: str, output: str, staging: str, decode: Callable[[bytes], object] = pixels.decode, on_event: Callable[[str, str], None] = lambda level, message: None) -> dict:
    """Runs everything up to the manifest and returns the statistics. root, output and staging are URIs.

    on_event hears of stages ("info", "progress") and of images that failed ("warn", a few of them).
    """
    s = settings.checked()
    if s.upscale and not _upscalers:
        raise NotImplementedError("crop_run has no model for upscale; register_upscaler adds one")
    if s.extension not in _encoders:
        raise NotImplementedError(f"crop_run has no encoder for {s.extension}; register_encoder adds one")
    mask_root = (s.mask_dir.expanduser().resolve().as_uri() if isinstance(s.mask_dir, Path) else s.mask_dir) if s.masks and s.mask_dir else None
    skip = [*_below(root, output), *(_below(root, mask_root) if mask_root else [])]
    photos = scan.scan(spark, root, exclude=s.exclude, skip=skip, limit=s.limit, follow=s.follow_symlinks)
    manifest_path = f"{output}/manifest.jsonl"
    system = spark._jvm.org.apache.hadoop.fs.Path(manifest_path).getFileSystem(spark._jsc.hadoopConfiguration())
    exists = system.exists(spark._jvm.org.apache.hadoop.fs.Path(manifest_path))
    if exists and not (s.resume or s.overwrite):
        raise FileExistsError(f"{manifest_path} is there; resume or overwrite")
    old = files.read(spark, manifest_path) if exists and s.resume else None
    on_event("info", f"scanning {root}" + (", resuming" if old is not None else ""))
    if old is not None and old.where("recovered").limit(1).count():
        raise ValueError("a rebuilt manifest has no sources to resume from")
    sources = photos.select("file", F.col("path").alias("source"))
    left = manifest.remaining(sources, old) if old is not None else sources
    content = scan.listed(spark, root, content=True, follow=s.follow_symlinks).select("file", "content")
    images = left.join(content, "file").select(F.col("source").alias("image_id"), "content")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for image_id, body in zip(frame["image_id"], frame["content"]):
                try:
                    h, w = decode(bytes(body)).shape[:2]
                    rows.append((image_id, float(w), float(h), ""))
                except Exception as error:
                    rows.append((image_id, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["image_id", "iw", "ih", "error"])

    sizes = images.mapInPandas(measure, "image_id string, iw double, ih double, error string")
    if s.skip_detection:
        found = sizes.where("error = ''")
        regions = detection.whole_image(found).join(found.select("image_id", "iw", "ih"), "image_id").withColumns({"landmarks": F.lit(None).cast(MARKS), "offset_y": F.lit(s.offset_y or 0.0)})
        failed = sizes.where("error <> ''").select("image_id", "error")
    else:
        detected = detection.detect(images, s.detector, decode, **s.detector_opts)
        regions = detection.by_score(detection.regions_of(detected), s.min_score).join(sizes.where("error = ''").select("image_id", "iw", "ih"), "image_id")
        # a set offset counts, even 0; else the detector says how its boxes need recentring
        regions = regions.withColumn("offset_y", detection.offset_y(s.offset_y, F.col("offset_y")))
        failed = detected.where("error <> ''").select("image_id", "error")
    chosen = detection.pick(regions, s.multi, s.max_per_image)
    plans = _plans(chosen, s)
    # pass one: everything an image needs in one row, cut, measured and masked, then written
    grouped = plans.where("reject is null").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("rank", "crop_x", "crop_y", "crop_w", "crop_h", "tier", "boxes"))).alias("plans"))
    cut = _cut(images.join(grouped, "image_id"), s, decode)
    cut.write.mode("overwrite").parquet(f"{staging}/cut")
    plans.select("image_id", "rank", "label", "score", "landmarks", "offset_y", "tier", "base_side", "fitted_side", "crop_x", "crop_y", "crop_w", "crop_h", "clamped", "extends", "reject").write.mode("overwrite").parquet(f"{staging}/plans")
    on_event("progress", "crops are cut and measured")
    cut, plans = spark.read.parquet(f"{staging}/cut"), spark.read.parquet(f"{staging}/plans")
    errors = failed.select("image_id", F.lit("error").alias("reason"), F.col("error").alias("detail")).unionByName(cut.where("error <> ''").select("image_id", F.lit("error").alias("reason"), F.col("error").alias("detail")))
    measured = plans.join(cut.where("error = ''").drop("body", "mask", "error").withColumn("masked", F.lit(s.masks)), ["image_id", "rank"])
    kept = numbering.face_positions(measured.where("fate = 'written'"))
    detail = F.when(F.col("fate") == "no_face", "no face found to mask").otherwise(F.format_string("sharpness %.1f below %.1f", F.col("sharpness"), F.lit(float(s.min_sharpness))))
    skips = (
        errors.unionByName(plans.where("reject is not null").select("image_id", F.lit("too_small").alias("reason"), F.col("reject").alias("detail")))
        .unionByName(measured.where("fate <> 'written'").select("image_id", F.col("fate").alias("reason"), detail.alias("detail")))
    )
    if not s.skip_detection:
        skips = skips.unionByName(detection.undetected(detected.where("error = ''").select("image_id"), regions).withColumn("detail", F.lit("")))
        if s.multi == "skip":
            skips = skips.unionByName(detection.several(regions))
    if old is not None:
        kept = kept.withColumn("source", F.col("image_id")).join(old.select("source", F.col("face_index")), ["source", "face_index"], "left_anti").drop("source")
    start = manifest.next_index(old, s.start_index).first()[0] if old is not None else s.start_index
    # pass two: numbers and names
    numbered = numbering.number(kept.withColumn("walk", scan.walk_key(F.col("image_id"))), ["walk", "face_index"], start=start).drop("walk")
    names = numbering.names(F.col("index"), F.col("tier"), s.prefix, s.digits, s.extension, s.per_size_dirs)
    tenth = numbering.tenth
    rows = numbered.select(
        F.col("index").cast("long").alias("index"), F.col("image_id").alias("source"), names["image_file"].alias("image_file"),
        F.when(F.lit(s.captioner != "none"), names["caption_file"]).alias("caption_file"), "tier", "label", "score", tenth(F.col("base_side")).alias("base_side"), tenth(F.col("fitted_side")).alias("fitted_side"),
        (F.rint(F.col("tier") / F.col("fitted_side") * 10000.0) / 10000.0).alias("scale"), tenth(F.col("sharpness")).alias("sharpness"), F.lit(s.padding).alias("padding"), "offset_y",
        F.array(*[tenth(F.col(c)) for c in ("crop_x", "crop_y", "crop_w", "crop_h")]).alias("crop"), "clamped", F.col("extends").alias("extended"), F.col("face_index").cast("int").alias("face_index"), "faces_in_image",
        F.transform_values(F.coalesce("landmarks", F.expr(f"cast(map() as {MARKS})")), lambda _, m: F.array(tenth(m["x"]), tenth(m["y"]))).alias("landmarks"),
        F.when(F.col("masked"), F.regexp_replace(names["image_file"], r"\.[^./]*$", ".png") if mask_root else names["mask_file"]).alias("mask_file"),
        F.when(F.col("masked"), F.lit(str(s.mask_dir) if mask_root else None)).alias("mask_dir"), "masked_faces", "background_mask", "masked_clothing", "rank",
    )
    rows.write.mode("overwrite").parquet(f"{staging}/rows")
    rows = spark.read.parquet(f"{staging}/rows")
    stats = numbering.run_stats(rows, skips, photos).first().asDict() | {"by_tier": {r["tier"]: r["n"] for r in numbering.by_tier(rows).collect()}}
    tally = lambda test, name: F.count_if(test).alias(name)
    faces, ground = F.col("masked_faces") > 0, F.col("background_mask")
    tallies = rows.agg(tally(faces, "masked"), tally(~faces & F.lit(s.mask_faces), "unmasked_kept"), tally(ground.isNotNull(), "background"), tally(ground == "box", "background_box"), tally(F.col("masked_clothing") > 0, "clothing"))
    stats |= tallies.first().asDict()
    for r in errors.limit(5).collect():
        on_event("warn", f"{r['image_id']}: {r['detail']}")
    if s.dry_run:
        return stats
    if s.overwrite and exists:
        overwrite(spark, output)
    made = rows.join(cut.select(F.col("image_id").alias("source"), "rank", "body", "mask"), ["source", "rank"])
    outputs = [(output, made.select(F.col("image_file").alias("path"), "body"))]
    if s.masks:
        outputs.append((mask_root or output, made.select(F.col("mask_file").alias("path"), F.col("mask").alias("body"))))
    if not s.overwrite and old is None:
        for folder, files_ in outputs:
            _free(spark, files_.select("path"), folder)
    for folder, files_ in outputs:
        files_.mapInPandas(writer(folder), "written long").agg(F.sum("written")).collect()
    new = rows.drop("rank")
    full = spark.createDataFrame([], files.DDL).unionByName(new, allowMissingColumns=True)
    if old is not None:
        full = full.unionByName(old.drop("line"), allowMissingColumns=True)
    full.write.mode("overwrite").parquet(f"{staging}/manifest")
    if stats["written"] or old is not None:
        files.replace(spark, spark.read.parquet(f"{staging}/manifest"), manifest_path)
    skipped = skips.select(F.col("image_id").alias("source"), "reason", "detail")
    target, base = fs.FileSystem.from_uri(output)
    target.create_dir(base, recursive=True)
    with target.open_output_stream(f"{base}/manifest.json") as out:
        for piece in files.summary(__version__, s.as_dict(), stats, skipped):
            out.write(piece.encode())
    return stats


def _described(requests: DataFrame, s: Settings, decode: Callable[[bytes], object]) -> DataFrame:
    """image_file, said: what a captioner says of each crop (its manifest fields and content).

    A captioner gets each request with the decoded crop as "image"; a crop that cannot be read,
    and one that its captioner fails on alone, costs one caption.
    """
    if s.captioner == "template" and s.captioner not in _captioners:
        return _from_template(requests, s, decode)
    factory = _captioners[s.captioner]

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = factory(s)
        for frame in frames:
            asked = frame.drop(columns="content").to_dict("records")
            for request, body in zip(asked, frame["content"]):
                try:
                    request["image"] = decode(bytes(body))
                except Exception:
                    request["image"] = None
            said = {}
            live = [r for r in asked if r["image"] is not None]
            for lo in range(0, len(live), max(1, s.caption_batch)):
                some = live[lo : lo + max(1, s.caption_batch)]
                try:
                    texts = list(own.describe(some))
                    if len(texts) != len(some):
                        raise ValueError("as many texts as crops are needed")
                except Exception:  # one by one, so that one bad crop costs one caption
                    texts = []
                    for request in some:
                        try:
                            texts += list(own.describe([request]))[:1] or [""]
                        except Exception:
                            texts.append("")
                said |= {r["image_file"]: t for r, t in zip(some, texts)}
            yield pd.DataFrame({"image_file": frame["image_file"], "said": [said.get(f, "") for f in frame["image_file"]]})

    return requests.mapInPandas(describe, "image_file string, said string")


def _from_template(requests: DataFrame, s: Settings, decode: Callable[[bytes], object]) -> DataFrame:
    """Captions from measures of the pixels, the landmarks and the manifest, as column expressions."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, body in zip(frame["image_file"], frame["content"]):
                try:
                    image = decode(bytes(body))
                except Exception:
                    continue
                grey = np.rint(pixels.luma(image)) / 255.0
                third = max(1, grey.shape[1] // 3)
                rows.append((name, grey.mean(), grey.std(), grey[:, :third].mean(), grey[:, -third:].mean(), (image.max(axis=2).astype(float) - image.min(axis=2)).mean() / 255.0))
            yield pd.DataFrame(rows, columns=["image_file", "mean", "spread", "left", "right", "saturation"])

    measured = requests.select("image_file", "content").mapInPandas(measure, "image_file string, mean double, spread double, left double, right double, saturation double")
    rows = requests.drop("content").join(measured, "image_file")
    x = lambda mark: F.col("landmarks")[mark][0]
    tokens = {
        "shot": cap.shot_type(F.col("label"), s.padding), "pose": cap.head_pose(F.col("label"), x("left_eye"), x("right_eye"), x("nose")),
        "light": cap.lighting(F.col("mean"), F.col("spread"), F.col("left"), F.col("right")), "tone": cap.tone(F.col("saturation")),
        "label": F.col("label"), "tier": F.col("tier").cast("string"), "index": F.col("index").cast("string"), "source": F.col("source"),
    }
    return rows.select("image_file", cap.fill(s.caption_template or TEMPLATE, tokens).alias("said"))


def caption_run(spark: SparkSession, settings: Settings, output: str, staging: str, decode: Callable[[bytes], object] = pixels.decode) -> int:
    """Captions every crop whose text file is missing or blank, and rewrites the manifest; returns how many.

    "template" needs no model, "none" writes nothing; others are plug-ins of `register_captioner`.
    """
    s = settings
    if s.captioner == "none":
        return 0
    if s.captioner not in _captioners and s.captioner != "template":
        raise ValueError(f"no captioner {s.captioner!r}; there are {', '.join(sorted({'none', 'template', *_captioners}))}")
    rows = files.read(spark, f"{output}/manifest.jsonl").drop("line")
    if s.caption_images:
        wanted = spark.createDataFrame([(x,) for x in s.caption_images], "image_file string")
        missing = [r[0] for r in manifest.unknown(rows, wanted).limit(5).collect()]
        if missing:
            raise ValueError(f"not in the manifest: {', '.join(missing)}")
        chosen = manifest.selected(rows, wanted)
    else:
        chosen = rows
    texts = files.captions(spark, output)
    base = output.rstrip("/").split("://")[-1]
    texts = texts.select(F.regexp_replace(F.regexp_extract("file", base.replace("//", "/") + "/(.*)$", 1), "^/+", "").alias("caption_file"), F.col("caption").alias("caption_text"))
    chosen = chosen.drop("caption").withColumn("caption_file", manifest.caption_file(F.col("image_file")))
    state = manifest.pending(chosen, texts, "caption_file")
    todo = state.where("pending")
    content = scan.listed(spark, output, content=True).select(F.col("path").alias("image_file"), "content")
    requests = todo.select("image_file", "index", "source", "label", "tier", "faces_in_image", "padding", "landmarks").join(content, "image_file")
    raw = _described(requests, s, decode)
    text = cap.assemble(F.col("said"), s.trigger, s.caption_prefix, s.caption_suffix, s.caption_drop, s.caption_max_chars)
    raw = raw.select("image_file", F.when(F.trim("said") == "", "").otherwise(text).alias("new_caption"))  # nothing said: no caption
    raw.write.mode("overwrite").parquet(f"{staging}/captions")
    raw = spark.read.parquet(f"{staging}/captions").where("new_caption <> ''")
    if s.dry_run:
        return raw.count()
    written = raw.select(manifest.caption_file(F.col("image_file")).alias("path"), F.concat("new_caption", F.lit("\n")).cast("binary").alias("body"))
    written.mapInPandas(writer(output), "written long").agg(F.sum("written")).collect()
    known = state.where("not pending").select("image_file", F.col("caption").alias("old_caption"))
    full = rows.join(raw, "image_file", "left").join(known, "image_file", "left").withColumn("caption", F.coalesce("new_caption", "old_caption", "caption")).select(*files.FIELDS)
    full.write.mode("overwrite").parquet(f"{staging}/manifest")
    files.replace(spark, spark.read.parquet(f"{staging}/manifest"), f"{output}/manifest.jsonl")
    return raw.count()


def rebuild_run(spark: SparkSession, output: str, staging: str, decode: Callable[[bytes], object] = pixels.decode) -> int:
    """Writes a manifest for the crops that lie in a folder; all or nothing."""
    system = spark._jvm.org.apache.hadoop.fs.Path(output).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{output}/manifest.jsonl")):
        raise FileExistsError("there is a manifest already")
    images = scan.scan(spark, output, marker=None).select("file", F.col("path").alias("image_file"))
    shared = [r["caption_file"] for r in manifest.shared_captions(images).limit(5).collect()]
    if shared:
        raise ValueError(f"several images share {', '.join(sorted(shared))}")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(output).select(F.col("path").alias("file"), "content")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shapes = [decode(bytes(c)).shape[:2] for c in frame["content"]]
            yield pd.DataFrame({"file": frame["file"], "h": [h for h, _ in shapes], "w": [w for _, w in shapes]})

    sized = images.join(content, "file").select("file", "content").mapInPandas(measure, "file string, h long, w long").join(images, "file")
    masks = content.where(F.col("file").rlike("-masklabel\\.png$")).select("file", "content").mapInPandas(measure, "file string, h long, w long")
    masks = masks.select(F.regexp_replace("file", "-masklabel\\.png$", "").alias("stem"), F.col("h").alias("mh"), F.col("w").alias("mw"))
    texts = files.captions(spark, output).select(F.regexp_replace(F.regexp_replace("file", r"\.txt$", ""), r"^[a-z]+:/*", "/").alias("stem"), F.col("caption").alias("text"))
    bare = F.regexp_replace(F.regexp_replace("file", r"\.[^./]*$", ""), r"^[a-z]+:/*", "/")
    rows = sized.withColumn("stem", bare).join(masks.withColumn("stem", F.regexp_replace("stem", r"^[a-z]+:/*", "/")), "stem", "left").join(texts, "stem", "left")
    wrong = [r["image_file"] for r in rows.where("mh is not null and (mh <> h or mw <> w)").select("image_file").limit(5).collect()]
    if wrong:
        raise ValueError(f"masks of another size: {', '.join(sorted(wrong))}")
    rows = numbering.number(rows.withColumn("key", scan.walk_key(F.col("image_file"))), ["key"])
    side = F.greatest("h", "w").cast("double")
    full = rows.select(
        F.col("index").cast("long").alias("index"), F.col("image_file").alias("source"), "image_file", F.when(F.col("text").isNotNull(), manifest.caption_file(F.col("image_file"))).alias("caption_file"), side.cast("int").alias("tier"),
        F.lit("image").alias("label"), F.lit(0.0).alias("score"), side.alias("base_side"), side.alias("fitted_side"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("sharpness"), F.lit(0.0).alias("padding"), F.lit(0.0).alias("offset_y"),
        F.array(F.lit(0.0), F.lit(0.0), F.col("w").cast("double"), F.col("h").cast("double")).alias("crop"), F.lit(False).alias("clamped"), F.lit(False).alias("extended"), F.lit(0).alias("face_index"), F.lit(1).alias("faces_in_image"),
        F.when(F.col("mh").isNotNull(), F.regexp_replace("image_file", r"\.[^./]*$", "-masklabel.png")).alias("mask_file"), F.coalesce("text", F.lit("")).alias("caption"), F.lit(True).alias("recovered"),
    )
    spark.createDataFrame([], files.DDL).unionByName(full, allowMissingColumns=True).write.mode("overwrite").parquet(f"{staging}/rebuilt")
    done = spark.read.parquet(f"{staging}/rebuilt")
    files.replace(spark, done, f"{output}/manifest.jsonl")
    return done.count()
