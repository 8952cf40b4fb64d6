"""Best-fit packing of tokenised documents into fixed-length sequences, planned on a length histogram.

Tokens come first: every document becomes pieces of at most `size` tokens, of which only
the first may be shorter. The driver then plans best-fit decreasing over the counts of
the `size` possible lengths, never over documents: bins of one filling are a class, so
the plan is a table of runs (length, first rank, count, first sequence, offset). Pieces are
range-sorted by length and id, so that a length that a third of all pieces share lies in many
tasks; the rows of each partition before (one number a partition) and of each length before give
a piece its rank within its length. Pieces join the runs by length and rank: a run stands once for
each STEP ranks it reaches, so that the join is an equal one.

Defined results: a null or empty text is one piece, the end id alone. Repeated rows are
documents of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Staging, lean
from .tokens import byte_characters

#: Ranks of a length that one row of the runs' table stands for.
STEP = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


class Encoder:
    """Ids of a `tokenizers` file; its merges run in the rank-driven library, which is several
    times as fast and gives the same ids (tests compare both)."""

    def __init__(self, path: str, pattern: str):
        with open(path) as file:
            spec = json.load(file)
        of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.plain = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode(text, allowed_special=self.special), np.uint32)
        except ValueError:  # the pattern's backtracking limit, on a very long run of white space
            return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, after a first one of the rest."""
    rest = n % size or min(n, size)
    starts = [0, *range(rest, n, size)]
    return [(s, (e - s)) for s, e in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of each document's ids followed by end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(own.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for out, x in zip(rows, (doc_id, k, start, length, crc, crc ^ length)):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(rows)], names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lean(run), PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram: runs (length, first rank, count, first sequence, offset).

    Pieces of a run have consecutive ranks within their length and take one slot each, at the
    same offset, in consecutive sequences. Open bins are classes (room, first sequence, count).
    """
    runs, opened = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges of sequences
    sizes: list[int] = []  # the keys of room, sorted

    def release(free: int, first: int, count: int) -> None:
        if free and count:
            if free not in room:
                room[free] = []
                insort(sizes, free)
            room[free].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(sizes, length)
            if k == len(sizes):  # no open bin has room: open as many as are needed
                free, first, count = size, opened, -(-left // (size // length))
                opened += count
            else:
                free = sizes[k]
                first, count = room[free].pop()
                if not room[free]:
                    del room[free]
                    sizes.pop(k)
            # a bin that took the length fits it more tightly than before, so it is filled before the next
            slots = free // length
            full = min(count, left // slots)
            for bins, n in ((full, slots), (min(1, count - full), min(slots, left - full * slots))):
                if bins and n:
                    for slot in range(n):
                        runs.append((length, rank, bins, first, size - free + slot * length))
                        rank += bins
                    release(free - n * length, first, bins)
                    first, count, left = first + bins, count - bins, left - bins * n
            release(free, first, count)
    return runs


def pack(spark: SparkSession, docs: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: where it comes from and the sequence and offset it takes."""
    staged = Staging(spark, "packing")
    rows = staged.put("pieces", pieces(docs, path, pattern, size, end_id))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = spark.createDataFrame(plan(counts, size), "length long, first long, count long, first_sequence long, offset long")
    block = lambda rank: F.floor(rank / F.lit(float(STEP))).cast("long")
    runs = staged.put("runs", runs.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("first") + F.col("count") - 1)))))

    order = ["length", "doc_id", "piece", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = staged.put("ranged", ranged.drop("tie"))
    part, local = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    held = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    parts = np.concatenate([[0], np.cumsum([held.get(k, 0) for k in range(max(held, default=0) + 1)])])
    lengths = np.concatenate([[0], np.cumsum([counts.get(k, 0) for k in range(size + 1)])])
    at = lambda values, key: F.get(F.lit([int(v) for v in values]).cast("array<long>"), key.cast("int"))
    ranked = ranged.withColumn("rank", local + at(parts, part) - at(lengths, F.col("length"))).withColumn("block", block(F.col("rank")))
    slots = ranked.join(runs, ["length", "block"]).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count")))
    staged.drop("pieces")
    return slots.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
