"""Manifests as tables: resume, selection, pending captions, rebuilding and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resume_state(log: DataFrame) -> DataFrame:
    """By source: whether all its faces are saved. A row without positions counts as face 0 of 1."""
    face, total = F.coalesce("face_index", F.lit(0)), F.coalesce("faces_in_image", F.lit(1))
    state = log.groupBy("source").agg(F.max(total).alias("total"), F.countDistinct(F.when((face >= 0) & (face < total), face)).alias("saved"), F.count("*").alias("n_rows"))
    return state.select("source", "total", "saved", "n_rows", (F.col("saved") >= F.col("total")).alias("done"))


def next_index(log: DataFrame, start: int = 1) -> DataFrame:
    return log.agg((F.greatest(F.lit(start - 1), F.coalesce(F.max("index"), F.lit(start - 1))) + 1).alias("next_index"))


def remaining(sources: DataFrame, log: DataFrame) -> DataFrame:
    """Sources that are not done, by exact name."""
    return sources.join(resume_state(log).where("done"), "source", "left_anti")


def unsaved(faces: DataFrame, log: DataFrame) -> DataFrame:
    """Faces (source, face_index) that are not saved yet."""
    return faces.join(log.select("source", F.coalesce("face_index", F.lit(0)).alias("face_index")), ["source", "face_index"], "left_anti")


def carried(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows first and as they are, then the new ones."""
    return old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)), allowMissingColumns=True)


def caption_file(image_file: Column) -> Column:
    return F.regexp_replace(image_file, r"\.[^./]*$", ".txt")


def pending(crops: DataFrame, captions: DataFrame, key: str = "image_file") -> DataFrame:
    """crops with the caption found beside them, and whether it is still to be written."""
    text = F.trim(F.coalesce("caption_text", F.lit("")))
    return crops.join(captions, key, "left").withColumns({"caption": text, "pending": text == ""}).drop("caption_text")


def selected(crops: DataFrame, wanted: DataFrame) -> DataFrame:
    return crops.join(wanted.distinct(), "image_file", "left_semi")


def unknown(crops: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.distinct().join(crops, "image_file", "left_anti")


def shared_captions(images: DataFrame) -> DataFrame:
    """Caption paths that several images would share: an error of a rebuild."""
    return images.groupBy(caption_file(F.col("image_file")).alias("caption_file")).agg(F.count("*").alias("n")).where("n > 1")


def side_files(image_file: Column) -> Column:
    """What an overwrite removes for one image: itself, its caption and its mask."""
    stem = F.regexp_replace(image_file, r"\.[^./]*$", "")
    return F.array_distinct(F.array(image_file, F.concat(stem, F.lit(".txt")), F.concat(stem, F.lit("-masklabel.png"))))


def normal_path(path: Column) -> Column:
    """Segments of a path without `.`; `..` takes the segment before it, and stays where there is none."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its root."""
    return F.coalesce(F.get(normal_path(path), F.lit(0)) == "..", F.lit(False)) | path.startswith("/")


def missing_fields(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows that lack a required field, with the first one that is missing."""
    lack = F.coalesce(*[F.when(F.col(c).isNull(), c) for c in required])
    return rows.withColumn("missing", lack).where("missing is not null")
