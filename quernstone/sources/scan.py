"""Image paths: which files a scan takes, and in which order, as column expressions.

`path` is relative to the root, with `/`. The predicates look at names alone, so that they run
before any content is read.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of images, and those that need a further codec.
EXTENSIONS = (".jpg", ".jpeg", ".jpe", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif", ".ppm")
HEIF_EXTENSIONS = (".heic", ".heif", ".avif")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def name_of(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r".(\.[^.]+)$", 1))


def is_image(path: Column, extensions: Sequence[str] = EXTENSIONS) -> Column:
    return extension_of(path).isin(list(extensions))


def is_visible(path: Column) -> Column:
    """No file and no folder on the way starts with a dot."""
    return ~F.exists(parts(path), lambda p: p.startswith("."))


def is_side_file(path: Column) -> Column:
    return stem_of(path).rlike("-(mask|cond)label$")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression of both Python and Java; `*` also matches `/`."""
    translated = fnmatch.translate(pattern)
    body = re.fullmatch(r"\(\?s:(.*)\)\\[zZ]", translated, re.S)
    return f"(?s)^(?:{body[1] if body else translated})$"


def prefixes(path: Column) -> Column:
    """The path and all folders above it."""
    own = parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda k: F.array_join(F.slice(own, 1, k), "/"))


def is_excluded(path: Column, patterns: Sequence[str]) -> Column:
    """A pattern matches the path or the name of the file or of a folder above it."""
    out = F.lit(False)
    for pattern in patterns:
        rule = glob_regex(pattern)
        out = out | F.exists(prefixes(path), lambda p: p.rlike(rule)) | F.exists(parts(path), lambda p: p.rlike(rule))
    return out


def is_below(path: Column, folders: Sequence[str]) -> Column:
    out = F.lit(False)
    for folder in folders:
        out = out | path.startswith(folder.rstrip("/") + "/")
    return out


def without_marked(paths: DataFrame, marker: str = "manifest.jsonl") -> DataFrame:
    """Paths below no folder that holds the marker; the root itself may hold it."""
    marked = paths.where(name_of(F.col("path")) == marker).select(F.array_join(F.slice(parts(F.col("path")), 1, F.size(parts(F.col("path"))) - 1), "/").alias("folder")).where("folder <> ''").distinct()
    kept = paths.withColumn("_folders", prefixes(F.col("path"))).withColumn("_folder", F.explode("_folders")).join(marked, F.col("_folder") == F.col("folder"), "left_semi").select("path").distinct()
    return paths.join(kept, "path", "left_anti")


def walk_key(path: Column) -> Column:
    """Sorts as a walk does: by name at every level, a folder's own files before its folders."""
    own = parts(path)
    last = F.size(own)
    return F.transform(own, lambda p, i: F.struct(F.when(i + 1 == last, 0).otherwise(1).alias("folder"), p.alias("name")))


def walked(root: str, follow: bool) -> list[str] | None:
    """The files under a local root that has links to folders: without these or, if they are followed,
    each folder once. None where there are no such links, and on other file systems, which have none."""
    if not root.startswith(("file:", "/")):
        return None
    base = re.sub(r"^file:/*", "/", root)
    if not any(os.path.islink(os.path.join(here, f)) for here, folders, _ in os.walk(base) for f in folders):
        return None
    out, seen = [], set()
    for here, folders, names in os.walk(base, followlinks=follow):
        place = os.stat(here)
        if (place.st_dev, place.st_ino) in seen:
            folders.clear()
            continue
        seen.add((place.st_dev, place.st_ino))
        folders.sort()
        out += [f"file://{here}/{name}" for name in names]
    return out


def listed(spark: SparkSession, root: str, content: bool = False, follow: bool = False) -> DataFrame:
    """file, path (relative to root), length of all files under root, and content if asked for."""
    names = ["path", "length", *(["content"] if content else [])]
    found = walked(root, follow)  # a listing by Spark would follow links, and go round in loops
    if found == []:
        files = spark.createDataFrame([], "path string, length long" + (", content binary" if content else ""))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root if found is None else found).select(*names)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    return files.select(F.col("path").alias("file"), relative.alias("path"), *names[1:])


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, exclude: Sequence[str] = (), skip: Sequence[str] = (), marker: str | None = "manifest.jsonl", limit: int = 0, follow: bool = False) -> DataFrame:
    """path (relative), file, length of the images under root, in walk order if limited.

    Only metadata is read: `content` stays out of the plan until a later join or read.
    """
    rows = listed(spark, root, follow=follow)
    if marker:
        rows = without_marked(rows, marker)
    path = F.col("path")
    rows = rows.where(is_visible(path) & is_image(path, extensions) & ~is_side_file(path) & ~is_excluded(path, exclude) & ~is_below(path, skip))
    return rows.orderBy(walk_key(path)).limit(limit) if limit else rows
