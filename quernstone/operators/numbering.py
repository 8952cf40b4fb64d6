"""Numbers, names and counts of kept crops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number(df: DataFrame, order: Sequence[str | Column], start: int = 1, name: str = "index", tasks: int | None = None) -> DataFrame:
    """Contiguous numbers in a total order, without a window over one partition.

    Rows are range-sorted; the counts of the partitions before (one row a partition) are added
    to each row's place in its own partition. The range-sorted rows are checkpointed between the
    two passes where the session has a checkpoint folder, as recomputed partitions might differ;
    `order` must be total for the same reason. `tasks`: how many partitions, where the session's choice would make them too large.
    """
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    part, place = f"_{name}_part", f"_{name}_place"
    dealt = df.repartitionByRange(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys).withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()})
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        spark.sparkContext.setCheckpointDir(folder)
        dealt = dealt.checkpoint()
    else:
        dealt = dealt.persist()
    counts = dealt.groupBy(part).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = dealt.join(F.broadcast(before.select(part, "_before", "_first")), part)  # one row a partition
    return joined.withColumn(name, F.col(place) - F.col("_first") + F.col("_before") + F.lit(start)).drop(part, place, "_before", "_first")


def face_positions(df: DataFrame, order: str = "rank") -> DataFrame:
    """face_index (from 0) and faces_in_image among the kept crops of an image."""
    one = W.partitionBy("image_id")
    return df.withColumns({"face_index": F.row_number().over(one.orderBy(order)) - 1, "faces_in_image": F.count("*").over(one).cast("int")})


def padded(index: Column, digits: int) -> Column:
    """At least `digits` digits; a longer number stays whole."""
    return F.format_string(f"%0{digits}d", index)


def names(index: Column, tier: Column, prefix: str = "", digits: int = 4, extension: str = "png", per_size: bool = False) -> dict[str, Column]:
    stem = F.concat(F.lit(prefix), padded(index, digits))
    folder = F.concat(tier.cast("string"), F.lit("/")) if per_size else F.lit("")
    return {
        "image_file": F.concat(folder, stem, F.lit(f".{extension}")),
        "caption_file": F.concat(folder, stem, F.lit(".txt")),
        "mask_file": F.concat(folder, stem, F.lit("-masklabel.png")),
    }


def tenth(x: Column) -> Column:
    """One decimal place, half to even on the scaled value."""
    return F.rint(x * 10.0) / 10.0


REASONS = ("no_detection", "multi", "too_small", "blurry", "no_face", "error")


def run_stats(crops: DataFrame, skips: DataFrame, images: DataFrame) -> DataFrame:
    """One row: what a run scanned, kept and skipped, in one aggregation over all three."""
    events = (
        images.select(F.lit("scanned").alias("what"), F.lit(False).alias("clamped"))
        .unionAll(crops.select(F.lit("written"), F.col("clamped")))
        .unionAll(skips.select(F.col("reason"), F.lit(False)))
    )
    count = lambda name: F.count_if(F.col("what") == name).alias(name)
    return events.agg(count("scanned"), count("written"), F.count_if("clamped").alias("clamped"), *map(count, REASONS))


def stats_of_fates(images: DataFrame, fates: DataFrame) -> DataFrame:
    """The row of `run_stats` from the fate of every region (image_id, fate, clamped), in one join:
    "written" or a reason. An image without regions is one without a detection."""
    of = lambda name: F.count_if(F.col("fate") == name).alias(name)
    own = images.select("image_id").join(fates, "image_id", "left").groupBy("image_id").agg(
        of("written"), F.count_if((F.col("fate") == "written") & F.col("clamped")).alias("clamped"), F.count_if(F.col("fate").isNull()).alias("no_detection"), *map(of, REASONS[1:])
    )
    return own.agg(F.count("*").alias("scanned"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("written", "clamped", *REASONS)])


def by_tier(crops: DataFrame) -> DataFrame:
    return crops.groupBy("tier").agg(F.count("*").alias("n"))


def training_config(crops: DataFrame, sizes: Sequence[int], batch: int = 2, native: bool = False) -> DataFrame:
    """One row with the settings of a training run; none for no crops, or where masks have a folder of their own.

    crops: tier, mask_file, mask_dir.
    """
    totals = crops.agg(
        F.count("*").alias("n"), F.min("tier").alias("least"), F.count_if(F.col("mask_file").isNotNull()).alias("masked"),
        F.count_if(F.col("mask_dir").isNotNull()).alias("outside"), F.count_if(~F.col("tier").isin(list(sizes))).alias("odd"),
    )
    wanted = F.lit(4000.0 * batch) / F.nullif(F.col("n"), F.lit(0))
    epochs = F.rint(F.least(F.lit(300.0), F.greatest(F.lit(10.0), wanted))).cast("int")
    free = F.lit(native) | (F.col("odd") > 0)
    return totals.where((F.col("n") > 0) & (F.col("outside") == 0)).select(
        F.when(~free, F.col("least").cast("string")).alias("resolution"), epochs.alias("epochs"), F.lit(batch).alias("batch_size"),
        (F.col("masked") > 0).alias("masked_training"), ((F.col("masked") > 0) & (F.col("masked") < F.col("n"))).alias("partly_masked"),
    )
