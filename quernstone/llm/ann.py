"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids (the square root of the number of rows, at most SAMPLE) and the codebooks of
residuals are trained by k-means on SAMPLE rows at most, in the order of a hash of the id; every
row is indexed. An index row is its list, its code of one byte a subspace, the distance that the
code loses, and its vector. Lists are cut into blocks of BLOCK rows after a range sort on (list,
hash), so that a list that holds a third of all rows lies in many tasks.

Each query has its own probes. Its k-th best score among the sampled rows is a floor of its k-th
best of all. It probes the nearest list, and each one whose centroid's inner product with it, plus
a share of the list's radius (over all rows), reaches the floor. With the whole radius that loses
nothing; the share is at least LEAST_SLACK / sqrt(dimensions), as a row at that distance in a random direction
adds about that little, and at least the least with which TARGET of the true neighbours of TRIALS rows, kept out of the
training and searched by brute force in one pass, are in a probed list. So a query among clusters
probes few lists, one apart from them many, whatever most rows need.

Lists are dealt to at most SHARDS shards, and a query goes once to each shard in which it probes a
list, with a bit for each of these, so that its copies have a bound; blocks of queries meet blocks
of rows by an equi-join on the shard. Within a pair of blocks, for the queries that probe the
block's list, asymmetric distance tables give each row's estimate, which the lost distance turns
into bounds. Rows whose upper bound is below the k-th lower bound go; the others are scored
exactly, and the best k stay; a window takes the best k over all blocks. However alike rows are
for the codes, none that is among the best of a probed list is lost.

Nearness is the largest cosine of the original vectors in double precision, so unit vectors
are indexed. Defined results: see vectors.py; zero vectors take no part either. With fewer
candidates than k, all are returned. Equal vectors have equal estimates and scores, and the
smaller ids win. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Staging, lean
from .vectors import BLOCK_SCHEMA, best, checked, cut_blocks, matrix, queries_of

SAMPLE = 16_384
BLOCK = 2048
QUERY_BLOCK = 256
TARGET = 0.99
LEAST_SLACK = 3.0
ROUNDING = 1e-9
TRIALS = 256
CODES = 256
SHARDS = 128


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; an emptied centroid stays where it was."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    """Coarse centroids and codebooks."""

    def __init__(self, sample: np.ndarray, rows: int, known: np.ndarray | None = None, known_ids: np.ndarray | None = None):
        """Trained on `sample`; the rows `known` give queries their floors."""
        sample = unit(sample)
        d = sample.shape[1]
        self.centres = kmeans(sample, max(1, round(rows**0.5)))
        rest = sample - self.centres[nearest(sample, self.centres)]
        parts = next(m for m in (16, 8, 4, 2, 1) if d % m == 0)
        self.spans = [(a, a + d // parts) for a in range(0, d, d // parts)]
        self.books = [kmeans(rest[:, a:b], CODES, 5) for a, b in self.spans]
        self.radii = np.full(len(self.centres), -np.inf)  # of the rows of each list; none: never probed
        self.slack = 1.0
        self.sample = unit(known) if known is not None else np.zeros((0, d))
        self.sample_ids = known_ids if known_ids is not None else np.zeros(0, np.int64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, distance from the centroid, distance from what the code stands for) of each row."""
        x = unit(x)
        of = nearest(x, self.centres)
        rest = x - self.centres[of]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.spans, self.books)], axis=1).astype(np.uint8)
        lost = rest - np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return of, codes, np.sqrt((rest * rest).sum(axis=1)), np.sqrt((lost * lost).sum(axis=1))

    def floors(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each unit query among the sampled rows, which is no better than that among all."""
        score = q @ self.sample.T
        score[q_ids[:, None] == self.sample_ids] = -np.inf
        return np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)

    def calibrate(self, ids: np.ndarray, trials: np.ndarray, near: list[np.ndarray], k: int) -> None:
        """The share of a list's radius with which TARGET of each trial's nearest others are in a probed list."""
        floors = self.floors(ids, trials, k)
        needs = [np.zeros(0)]
        for q, floor, own in zip(trials, floors, near):
            of = nearest(own, self.centres)
            needs.append((floor - self.centres[of] @ q) / np.maximum(self.radii[of], 1e-9))
        needs = np.sort(np.concatenate(needs))
        enough = needs[min(len(needs) - 1, int(np.ceil(len(needs) * TARGET)))] if len(needs) else 1.0
        self.slack = float(min(1.0, max(enough, LEAST_SLACK / len(self.centres[0]) ** 0.5)))

    def probe(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Lists to search, as one bool a list: the nearest one, and all that can reach the floor of the query."""
        out = np.zeros((len(q), len(self.centres)), bool)
        half = np.where(np.isfinite(self.radii), (self.centres * self.centres).sum(axis=1) / 2, np.inf)
        for lo in range(0, len(q), QUERY_BLOCK):
            own = unit(q[lo : lo + QUERY_BLOCK])
            score = own @ self.centres.T
            out[lo : lo + QUERY_BLOCK] = score + self.slack * self.radii >= self.floors(q_ids[lo : lo + QUERY_BLOCK], own, k)[:, None] - ROUNDING
            out[np.arange(lo, lo + len(own)), np.argmax(score - half, axis=1)] = True
        return out

    def estimates(self, q: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of unit queries and rows of list `of`, from tables of query parts and code words."""
        out = np.repeat((q @ self.centres[of])[:, None], len(codes), axis=1)
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books)):
            out += (q[:, a:b] @ book.T)[:, codes[:, m]]
        return out


def at_least(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, as a column; below all where there are fewer."""
    return np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] >= k else np.full((len(score), 1), -np.inf)


def search_block(index: Index, of: int, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, lost: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query ids, row ids, scores): the k best rows of the block for each query, exactly scored.

    A row's score is within `lost` of its estimate, so only rows that can be among the k best are scored.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, codes, lost = ids[order], x[order], codes[order], lost[order]
    norm = np.sqrt((x * x).sum(axis=1))
    own = q_ids[:, None] == ids
    guess = index.estimates(unit(q), of, codes)
    guess[own] = -np.inf
    can = guess + lost >= at_least(guess - lost, k) - ROUNDING
    can &= ~own
    some = np.flatnonzero(can.any(axis=0))
    score = unit(q) @ (x[some] / norm[some, None]).T
    score[~can[:, some]] = -np.inf
    can = (score >= at_least(score, k) - ROUNDING) & np.isfinite(score)
    out: tuple[list, list, list] = ([], [], [])
    for j in range(len(q)):
        take = some[can[j]]
        score = (x[take] * q[j]).sum(axis=1) / (norm[take] * np.sqrt((q[j] * q[j]).sum()))
        top = np.lexsort((ids[take], -score))[:k]
        out[0].extend([q_ids[j]] * len(top))
        out[1].extend(ids[take][top])
        out[2].extend(score[top])
    return out


def brute(rows: DataFrame, trials: np.ndarray, d: int, k: int) -> list[np.ndarray]:
    """The k unit vectors nearest to each trial among all rows but its equals: a bounded set of queries, the best few by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, vectors = np.zeros((len(trials), 0)), np.zeros((len(trials), 0, d))
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = unit(matrix(batch.column(1).slice(lo, BLOCK), d))
                score = trials @ x.T
                score[score > 1 - 1e-12] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                scores = np.concatenate([scores, np.take_along_axis(score, top, 1)], axis=1)
                vectors = np.concatenate([vectors, x[top]], axis=1)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                scores, vectors = np.take_along_axis(scores, top, 1), np.take_along_axis(vectors, top[:, :, None], 1)
        for j in range(len(trials)):
            keep = np.isfinite(scores[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), j)), pa.array(scores[j, keep]), pa.array([v.tobytes() for v in vectors[j, keep]], pa.binary())], names=["trial", "score", "row"])

    found = rows.mapInArrow(lean(run), "trial long, score double, row binary")
    w = W.partitionBy("trial").orderBy(F.desc("score"), "row")
    near: list[list] = [[] for _ in trials]
    for r in found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("trial", "row").collect():  # at most TRIALS * k
        near[r["trial"]].append(np.frombuffer(r["row"]))
    return [np.array(x).reshape(-1, d) for x in near]


def search(spark: SparkSession, embeddings: DataFrame, wanted: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; queries are the rows where `wanted`."""
    staged = Staging(spark, "ann")
    rows, d = checked(embeddings)
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    n = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "vector").collect()  # bounded
    ids, sample = np.array([r[0] for r in sample], np.int64), np.array([r[1] for r in sample], np.float64)
    held = min(TRIALS, len(sample) // 4)
    trials, index = unit(sample[:held]), Index(sample[held:], n, sample, ids)
    shards = min(SHARDS, len(index.centres))
    parts = len(index.spans)
    width = -(-len(index.centres) // (8 * shards))  # bytes of a query's bits in a shard

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), d)
                of, codes, far, lost = index.encode(x)
                extra = np.concatenate([codes, lost[:, None].view(np.uint8)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in extra], pa.binary()), pa.array(far)], names=["list", "vec_id", "row", "extra", "far"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), d)
                query, lists = np.nonzero(index.probe(batch.column(0).to_numpy(), x, k))
                wanted = np.zeros((len(x), shards, width * 8), bool)
                wanted[query, lists % shards, lists // shards] = True
                query, shard = np.nonzero(wanted.any(axis=2))
                packed, bits = [r.tobytes() for r in x], np.packbits(wanted[query, shard], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).take(pa.array(query)), pa.array([packed[j] for j in query], pa.binary()), pa.array([r.tobytes() for r in bits], pa.binary())], names=["list", "vec_id", "row", "extra"])

    fields = "list long, vec_id long, row binary, extra binary"

    def packed(df: DataFrame, most: int) -> DataFrame:
        dealt = df.withColumn("turn", F.xxhash64("vec_id")).repartitionByRange("list", "turn").sortWithinPartitions("list", "turn").drop("turn")
        return dealt.mapInArrow(lambda batches: cut_blocks(batches, most), BLOCK_SCHEMA)

    indexed = staged.put("index", rows.mapInArrow(lean(encode), f"{fields}, far double"))
    for r in indexed.groupBy("list").agg(F.max("far").alias("far")).collect():  # one a list, at most SAMPLE
        index.radii[r["list"]] = r["far"]
    index.calibrate(ids[:held], trials, brute(rows, trials, d, k), k)
    blocks = staged.put("blocks", packed(indexed.drop("far"), BLOCK))
    asked = staged.put("queries", packed(queries_of(rows, wanted).mapInArrow(lean(probe), fields), QUERY_BLOCK))
    staged.drop("index")
    asked = asked.select(F.col("list").alias("shard"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("extra").alias("q_bits"))
    pairs = asked.join(blocks.withColumn("shard", F.pmod("list", F.lit(shards))), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, q_ids, q, bits, ids, x, extra in zip(*[c.to_pylist() for c in batch.columns]):
                probes = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=1)[:, of // shards] > 0
                if not probes.any():
                    continue
                extra = np.frombuffer(extra, np.uint8).reshape(-1, parts + 8)
                codes, lost = extra[:, :parts], np.ascontiguousarray(extra[:, parts:]).view(np.float64)[:, 0]
                found = search_block(index, of, np.frombuffer(q_ids, "<i8")[probes], np.frombuffer(q).reshape(-1, d)[probes], np.frombuffer(ids, "<i8"), np.frombuffer(x).reshape(-1, d), codes, lost, k)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = pairs.select("list", "q_ids", "q_rows", "q_bits", "ids", "rows", "extra").mapInArrow(lean(run), "query_id long, vec_id long, score double")
    return best(found, k)
