"""Incremental runs: new manifest rows as a file stream, appended once each.

An extension of `--resume`: instead of comparing a listing with the manifest, the stream's own
checkpoint knows what it has taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.manifest import DDL


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the JSON-lines files that appear in a folder."""
    return spark.readStream.schema(DDL).json(folder)


def append(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes all that is there, keeps the first row of each (source, face_index) of a batch, and ends.

    A batch that is tried again overwrites its own folder, so that every row lands once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["source", "face_index"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_by_tier(stream: DataFrame) -> DataFrame:
    return stream.groupBy("tier").agg(F.count("*").alias("n"))
