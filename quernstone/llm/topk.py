"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integer term weights. Rows are dealt into document ranges of about GROUP rows: the
leaves of a tree that halves SEED sampled rows by their most spread term, and within a leaf parts
by a hash of the id, so that a range holds like rows where there are such. A range is cut in the
same way into blocks of BLOCK rows. A block keeps, for every term, the largest and the smallest
weight, and its rows as a forward index (a rows x terms matrix). The sum over the query's terms of
weight times that extreme bounds every score in the block. A query visits the blocks of a range by
falling bound and scores them through the forward index until the bound falls below its k-th
score so far; a bound equal to it is still scored, for ties. Vectors without any structure have
no block that a bound excludes: all their blocks are scored.

A query starts from the k-th best score over SEED rows (a bounded broadcast), a lower bound of
its final one, so that most ranges are cut from the start. The executors choose these rows, so that
the driver gets SEED of them however many tasks read the table. Ranges are gathered in at most
MEETINGS groups by number, and each block of queries is sent to every group once: a stated query set
against all rows, in blocks. These copies are shuffled, never broadcast: together they are MEETINGS
times the queries, while Spark judges them by the file before they are copied. Results are exact
whatever the seed.

Defined results: see vectors.py. Zero vectors take part. Scores are exact up to 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, lean
from .vectors import BLOCK_SCHEMA, best, checked, cut_blocks, matrix, queries_of

GROUP = 4096
BLOCK = 64
QUERY_BLOCK = 256
SEED = 2048
LEAVES = 128
MEETINGS = 256


def weights(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x).astype(np.int64)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where every sum stays below 2**53."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def floors(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th score, from some rows."""
    low = np.full(len(q), np.iinfo(np.int64).min)
    score = product(q, x)
    for j in range(len(q)):
        others = score[j][ids != q_ids[j]]
        if len(others) >= k:
            low[j] = np.partition(others, len(others) - k)[len(others) - k]
    return low


def halved(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of like rows, most at a time, halved by the most spread term (ties in their order)."""
    todo, out = [np.arange(len(x))], []
    while todo:
        some = todo.pop()
        if len(some) <= most:
            out.append(some)
            continue
        term = int(np.argmax(x[some].astype(np.float64).var(axis=0)))
        some = some[np.argsort(x[some, term], kind="stable")]
        middle = -(-len(some) // (2 * most)) * most
        todo += [some[middle:], some[:middle]]
    return out


class Tree:
    """Leaves of like rows, by splits learned from some rows."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.splits: list[tuple[int, int, int, int]] = []  # term, edge, place of the lower and of the upper side (a leaf below 0)
        self.leaves = 0
        self.root = self._grow(x, leaves)

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        term = int(np.argmax(x.astype(np.float64).var(axis=0))) if len(x) else 0
        edge = int(np.median(x[:, term])) if len(x) else 0
        low = x[:, term] <= edge if len(x) else np.zeros(0, bool)
        if leaves < 2 or low.all() or not low.any():
            self.leaves += 1
            return -self.leaves
        at = len(self.splits)
        self.splits.append((0, 0, 0, 0))
        self.splits[at] = (term, edge, self._grow(x[low], leaves // 2), self._grow(x[~low], leaves - leaves // 2))
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            term, edge, low, high = np.array(self.splits)[at[inner]].T
            at[inner] = np.where(x[inner, term] <= edge, low, high)
        return -at - 1


def search_range(q_ids: np.ndarray, q: np.ndarray, low: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """(query ids, row ids, scores, blocks scored): the best k of one range that reach the floor."""
    order = np.concatenate([np.zeros(0, np.int64), *halved(x, BLOCK)])
    ids, x = ids[order], x[order]
    starts = np.arange(0, len(x), BLOCK)
    high, least = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bound = product(np.maximum(q, 0), high) + product(np.minimum(q, 0), least)
    order = np.argsort(-bound, axis=1, kind="stable")
    out: tuple[list, list, list] = ([], [], [])
    scored = 0
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) < 2**53
    qx, xx = (q.astype(np.float64), x.astype(np.float64)) if exact else (q, x)
    for j in range(len(q)):
        floor = low[j]
        best_scores, best_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in order[j]:
            if bound[j, b] < floor:
                break
            scored += 1
            a = b * BLOCK
            score, own = (xx[a : a + BLOCK] @ qx[j]).astype(np.int64), ids[a : a + BLOCK]
            keep = (score >= floor) & (own != q_ids[j])
            if not keep.any():
                continue
            best_scores, best_ids = np.append(best_scores, score[keep]), np.append(best_ids, own[keep])
            if len(best_scores) > k:
                top = np.lexsort((best_ids, -best_scores))[:k]
                best_scores, best_ids = best_scores[top], best_ids[top]
            if len(best_scores) == k:
                floor = max(floor, best_scores.min())
        out[0].extend([q_ids[j]] * len(best_ids))
        out[1].extend(best_ids)
        out[2].extend(best_scores)
    return *out, scored


def seed_of(rows: DataFrame, total: int) -> DataFrame:
    """SEED of `total` rows, the first by a hash; rows far from the first stay in their tasks."""
    turn = F.xxhash64("vec_id")
    if total > 4 * SEED:
        rows = rows.where(turn < F.lit(4 * SEED * (1 << 64) // total - (1 << 63)))
    return rows.orderBy(turn, "vec_id").limit(SEED)


def search(spark: SparkSession, embeddings: DataFrame, wanted: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products; queries are the rows where `wanted`."""
    staged = Staging(spark, "topk")
    rows, d = checked(embeddings)
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = rows.count()
    seed = staged.put("seed", seed_of(rows, total)).collect()  # at most SEED rows
    staged.drop("seed")
    seed_ids, seed_rows = np.array([r[0] for r in seed], np.int64), weights(np.array([r[1] for r in seed], np.float64).reshape(-1, d))

    tree = Tree(seed_rows, min(LEAVES, max(1, total // GROUP)))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = weights(matrix(batch.column(1), d))
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(x), pa.int64()), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([b""] * len(x), pa.binary())], names=["list", "vec_id", "row", "extra"])

    fields = "list long, vec_id long, row binary, extra binary"
    dealt = staged.put("rows", rows.mapInArrow(lean(forward), fields))
    parts = [0] * tree.leaves
    for r in dealt.groupBy("list").count().collect():  # at most LEAVES rows
        parts[r["list"]] = -(-r["count"] // GROUP)
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    meetings = max(1, min(MEETINGS, first[-1]))

    def of_leaf(values: list[int]) -> Column:
        return F.array(*[F.lit(int(v)).cast("long") for v in values])[F.col("list").cast("int")]

    numbered = dealt.withColumn("list", of_leaf(first[:-1]) + F.pmod(F.xxhash64("vec_id"), of_leaf(parts)))
    ranges = numbered.repartition("list").sortWithinPartitions("list", "vec_id").mapInArrow(lambda batches: cut_blocks(batches, 2 * GROUP), BLOCK_SCHEMA)
    groups = staged.put("ranges", ranges.withColumn("meeting", F.pmod("list", F.lit(meetings))))
    asked = queries_of(rows, wanted).repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(lean(forward), fields)
    asked = asked.withColumn("list", F.lit(0).cast("long")).mapInArrow(lambda batches: cut_blocks(batches, QUERY_BLOCK), BLOCK_SCHEMA)
    copies = staged.put("queries", asked.select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")))
    copies = copies.withColumn("meeting", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(meetings - 1).cast("long"))))
    pairs = copies.hint("merge").join(groups, "meeting")
    staged.drop("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, ids, x in zip(*[c.to_pylist() for c in batch.columns]):
                q_ids, q, ids, x = np.frombuffer(q_ids, "<i8"), np.frombuffer(q, "<i8").reshape(-1, d), np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i8").reshape(-1, d)
                low = floors(q_ids, q, seed_ids, seed_rows, k)
                found = search_range(q_ids, q, low, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found[:3]], names=["query_id", "vec_id", "score"])

    found = pairs.select("q_ids", "q_rows", "ids", "rows").mapInArrow(lean(run), "query_id long, vec_id long, score long")
    return best(found, k)
