"""JSON-lines manifests and caption files: reading with checks, writing in place of the old one."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a manifest row, in file order; the first REQUIRED ones must be there.
DDL = """index BIGINT, source STRING, image_file STRING, caption_file STRING, tier INT, label STRING, score DOUBLE,
base_side DOUBLE, fitted_side DOUBLE, scale DOUBLE, sharpness DOUBLE, padding DOUBLE, offset_y DOUBLE, crop ARRAY<DOUBLE>,
clamped BOOLEAN, extended BOOLEAN, face_index INT, faces_in_image INT, landmarks MAP<STRING,ARRAY<DOUBLE>>,
mask_file STRING, mask_dir STRING, masked_faces INT, background_mask STRING, masked_clothing DOUBLE, caption STRING, recovered BOOLEAN"""
FIELDS = [part.strip().split(" ")[0] for part in DDL.replace("MAP<STRING,ARRAY<DOUBLE>>", "MAP").split(",")]
REQUIRED = 18
NULLABLE = ("caption_file",)


class ManifestError(ValueError):
    """A manifest that cannot be used, with the line where it breaks."""


def _torn(spark: SparkSession, path: str) -> bool:
    """Whether the last byte of the file is no line end."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    size = system.getFileStatus(file).getLen()
    if not size:
        return False
    stream = system.open(file)
    try:
        stream.seek(size - 1)
        return stream.read() != 10
    finally:
        stream.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of one manifest, with defaults; line numbers are kept in `line`.

    Blank lines do not count. Only a last line without a line end may be torn; it is left out.
    Anything else that is no JSON object, and a row that lacks a required field, is an error.
    """
    text = spark.read.option("wholetext", False).text(path)
    lines = text.withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parsed = lines.select("line", "value", F.from_json("value", DDL + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    bad = parsed.where("r is null or r._corrupt is not null or not startswith(trim(value), '{')").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).first()
    if bad["n"]:
        end = lines.agg(F.max("line")).first()[0]
        if bad["n"] > 1 or bad["first"] != end or not _torn(spark, path):
            raise ManifestError(f"broken manifest row after {lines.where(F.col('line') < bad['first']).count()} whole ones")
        parsed = parsed.where(F.col("line") < end)
    rows = parsed.select("line", *[F.col("r").getField(c).alias(c) for c in FIELDS])
    needed = [c for c in FIELDS[:REQUIRED] if c not in NULLABLE]
    broken = rows.where(" or ".join(f"`{c}` is null" for c in needed)).agg(F.min("line")).first()[0]
    if broken is not None:
        raise ManifestError(f"a manifest row lacks a required field, after {lines.where(F.col('line') < broken).count()} others")
    return rows.withColumns({
        "landmarks": F.coalesce("landmarks", F.expr("cast(map() as map<string,array<double>>)")), "masked_faces": F.coalesce("masked_faces", F.lit(0)),
        "masked_clothing": F.coalesce("masked_clothing", F.lit(0.0)), "caption": F.coalesce("caption", F.lit("")), "recovered": F.coalesce("recovered", F.lit(False)),
    })


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row, null keys included, fields in file order."""
    return rows.select("index", F.to_json(F.struct(*[F.col(c) for c in FIELDS if c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes a manifest beside the old one and renames it into its place, ordered by index.

    The file is one sorted stream, written by one task that holds a row at a time.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    system.delete(staged, True)
    to_json(rows).orderBy("index").select("value").coalesce(1).write.text(staged.toString())
    part = next(f.getPath() for f in system.listStatus(staged) if f.getPath().getName().startswith("part-"))
    # one step, so that the old manifest is there until the new one is
    nested = jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(nested, "Options$Rename"), 1)
    how[0] = getattr(nested, "Options$Rename").OVERWRITE
    files = nested.FileContext.getFileContext(system.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    files.rename(system.makeQualified(part), system.makeQualified(target), how)
    system.delete(staged, True)


def captions(spark: SparkSession, root: str) -> DataFrame:
    """(file, caption) of the text files under root, stripped."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    return texts.select(F.input_file_name().alias("file"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("caption"))


def summary(version: str, config: dict, stats: dict, skipped: DataFrame) -> Iterator[str]:
    """The summary file of a run in pieces: its statistics, then what was skipped, a row at a time."""
    head = json.dumps({"version": version, "config": config, "stats": stats}, indent=2)
    yield head[:-2] + ',\n  "skipped": ['
    for k, line in enumerate(skipped.toJSON().toLocalIterator()):
        yield ("," if k else "") + "\n    " + line
    yield "\n  ]\n}\n"
