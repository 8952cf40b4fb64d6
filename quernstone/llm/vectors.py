"""What the vector searches share: checked vectors, packed blocks of rows, the best few of each query.

Vectors of another length than the commonest one (ties: the shorter) take no part, nor null,
empty ones or such with null or non-finite components. Rows that repeat an id are candidates
of their own, except to a query of that id; a query id that several rows have is one query,
its vector the least of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_SCHEMA = "list long, ids binary, rows binary, extra binary"


def checked(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(rows (vec_id long, vector array<double>) that take part, their dimension; 0: none)."""
    v = df[vector].cast("array<double>")
    sound = df.select(df[vec_id].cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    )
    lengths = sound.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return sound.where(F.size("vector") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column whose rows all have d values, as n x d."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def cut_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From rows (list, vec_id, row bytes, extra bytes), lists together: blocks of up to `most` rows of one list."""
    held: pa.Table | None = None

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = rows.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)] if len(lists) else []
        for a, b in zip(edges, edges[1:]):
            for lo in range(a, b, most):
                part = rows.slice(lo, min(most, b - lo)).combine_chunks()
                packed = [part.column(1).to_numpy().astype("<i8").tobytes(), b"".join(part.column(2).to_pylist()), b"".join(part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([lists[lo]], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], names=["list", "ids", "rows", "extra"])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        lists = held.column(0).to_numpy()
        whole = int(np.searchsorted(lists, lists[-1])) if len(lists) else 0
        whole += (len(lists) - whole) // most * most
        yield from emit(held.slice(0, whole))
        held = held.slice(whole)
    if held is not None:
        yield from emit(held)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def queries_of(rows: DataFrame, wanted: Column) -> DataFrame:
    """One (vec_id, vector) for each query id."""
    return rows.where(wanted).groupBy("vec_id").agg(F.min("vector").alias("vector"))
