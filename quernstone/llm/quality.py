"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), so that
all pairs of features interact through `rank` factors at linear cost. Features of a whole text:
its distinct words, hashed; STATISTICS of its structure, each as a value and as one of BINS
steps; the declared number of characters (`n_chars`; a null, and a table without it, is one of
its own) as metadata, in the same way. Labels, language, source and ids are never inputs.

Training runs on the driver over at most `most` labelled rows outside the held-out fold, taken
in the order of a hash of the id (a documented bound; `most` feature rows of a few kB each).
Scoring is one map over all rows, without a shuffle.

Defined results: null texts count as empty, and empty texts get a score from the model like
any other. A document with several labels takes the mean, 0.5 counting as 1; null labels and
null ids teach nothing; of rows that share an id one does. A null id is not held out. Without labels of both kinds the score is
the smoothed share of label 1. Repeated rows are scored one by one; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, U64, bounded, chunks, fresh, lean, mix, text_buffer, word_spans

WORDS = 1 << 15
BINS = 8
#: The column of metadata.
CHARS = "n_chars"
STATISTICS = ("log_words", "log_chars", "symbols", "digits", "capitals", "spaces", "not_ascii", "word_length", "distinct_words", "distinct_lines", "line_words", "repeats_in_row", "bars", "declared_chars", "declared_none")
SIZE = WORDS + len(STATISTICS) * (BINS + 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# -- features ----------------------------------------------------------------

_words: Rolling | None = None
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray, declared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices of distinct hashed words, how many for each text, statistics by text).

    declared: numbers of characters by metadata, NaN where there is none.
    """
    global _words
    _words = _words or Rolling(71)
    n = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    hashed = _words.ranges(_words.prefix(data), start, end)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    chars = np.diff(offsets).astype(np.float64)
    at = np.searchsorted(doc, np.arange(n + 1))
    index, counts, kinds = [], np.zeros(n, np.int64), np.zeros(n)
    for k in range(n):
        distinct = np.unique(hashed[at[k] : at[k + 1]])
        kinds[k] = len(distinct)
        slots = np.unique((distinct % U64(WORDS)).astype(np.int32))
        index.append(slots)
        counts[k] = len(slots)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1)
        np.cumsum(mask, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(chars, 1)

    digit = (data >= 48) & (data <= 57)
    capital = (data >= 65) & (data <= 90)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    same = np.zeros(n)
    if len(hashed):
        again = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:][again], minlength=n) / np.maximum(words, 1)
    line_ends = np.flatnonzero(data == 10)
    lines = np.bincount(np.searchsorted(offsets, line_ends, side="right") - 1, minlength=n) + 1.0
    different = np.ones(n)
    for k in np.flatnonzero(lines > 1):
        parts = data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
        different[k] = len(set(parts)) / len(parts)
    length = np.bincount(doc, weights=end - start, minlength=n) / np.maximum(words, 1)
    declared = np.full(n, np.nan) if declared is None else declared
    none = ~np.isfinite(declared)
    stats = np.stack([np.log1p(words), np.log1p(chars), share(~(_LETTER[data] | digit | space)), share(digit), share(capital), share(space), share(data >= 128), length, kinds / np.maximum(words, 1), different, np.log1p(words / lines), same, share(data == 124), np.log1p(np.where(none, 0.0, np.maximum(declared, 0.0))), none.astype(np.float64)], axis=1)
    return np.concatenate(index) if index else np.zeros(0, np.int32), counts, stats


# -- the model ---------------------------------------------------------------


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x rank
    edges: np.ndarray  # statistics x (BINS - 1)
    centre: np.ndarray
    scale: np.ndarray

    def rows(self, index: np.ndarray, counts: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, value, start of each text's features): words share one unit of norm."""
        n, k = stats.shape
        z = np.clip((stats - self.centre) / self.scale, -3, 3)
        step = np.stack([np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(k)], axis=1) if n else np.zeros((0, k), np.int64)
        base = WORDS + np.arange(k) * (BINS + 2)
        dense = np.concatenate([np.broadcast_to(base, (n, k)), base + 1 + step], axis=1)
        dense_x = np.concatenate([z / 3, np.ones((n, k))], axis=1) * 0.5
        total = counts + 2 * k
        start = np.concatenate([[0], np.cumsum(total)])
        out, x = np.empty(start[-1], np.int64), np.empty(start[-1])
        words = np.concatenate([[0], np.cumsum(counts)])
        place = np.arange(len(index)) + np.repeat(start[:-1] - words[:-1], counts)
        out[place], x[place] = index, np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)
        tail = start[:-1, None] + counts[:, None] + np.arange(2 * k)
        out[tail], x[tail] = dense, dense_x
        return out, x, start

    def parts(self, feature: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(raw score, sum of v x by factor), by the sum-of-squares identity."""
        vx = self.factors[feature] * x[:, None]
        s = np.add.reduceat(vx, start[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), start[:-1])
        linear = np.add.reduceat(self.weights[feature] * x, start[:-1])
        return self.bias + linear + 0.5 * ((s * s).sum(axis=1) - squares), s

    def scores(self, index: np.ndarray, counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        raw = self.parts(*self.rows(index, counts, stats))[0]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(index: list[np.ndarray], stats: np.ndarray, label: np.ndarray, rank: int = 6, passes: int = 8, steps: int = 400, batch: int = 256, rate: float = 0.08, decay: float = 2e-4) -> Machine:
    """Adagrad on the logistic loss; 0.5 stays the point where both labels are as likely.

    `passes` over the rows, or more until there were `steps` steps."""
    share = (label.sum() + 1) / (len(label) + 2)
    edges = np.zeros((len(STATISTICS), BINS - 1))
    model = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, rank)), edges, np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if not 0 < label.sum() < len(label):
        return model
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy()
    model.centre, model.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    model.factors = (stream_unit(SIZE * rank).reshape(SIZE, rank) - 0.5) * 0.1
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-3), np.full((SIZE, rank), 1e-3), 1e-3
    counts = np.array([len(x) for x in index])
    for turn in range(max(passes, -(-steps * batch // len(label)))):
        order = np.argsort(stream_unit(len(label), turn + 11))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            feature, x, start = model.rows(np.concatenate([index[i] for i in some]), counts[some], stats[some])
            raw, s = model.parts(feature, x, start)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[some])
            each = np.repeat(error, np.diff(start)) * x / len(some)
            touched, inverse = np.unique(feature, return_inverse=True)
            g = np.bincount(inverse, each, len(touched)) + decay * model.weights[touched]
            seen_w[touched] += g * g
            model.weights[touched] -= rate * g / np.sqrt(seen_w[touched])
            pulled = np.bincount(inverse, each * x, len(touched))
            for f in range(rank):
                own = model.factors[touched, f]
                g = np.bincount(inverse, each * np.repeat(s[:, f], np.diff(start)), len(touched)) - pulled * own + decay * own
                seen_v[touched, f] += g * g
                model.factors[touched, f] -= 0.5 * rate * g / np.sqrt(seen_v[touched, f])
            g = float(error.mean())
            seen_b += g * g
            model.bias -= rate * g / np.sqrt(seen_b)
    return model


def stream_unit(n: int, seed: int = 3) -> np.ndarray:
    """n fixed numbers in [0, 1)."""
    with np.errstate(over="ignore"):
        return (mix(np.arange(n, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) >> U64(11)).astype(np.float64) / (1 << 53)


# -- Spark -------------------------------------------------------------------


def _examples(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features of (text, declared, label) rows, computed where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            declared, label = numbers(batch.column(1)), batch.column(2)
            for lo, hi in chunks(offsets):
                index, counts, stats = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], declared[lo:hi])
                ends = np.concatenate([[0], np.cumsum(counts)])
                packed = [index[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary()), label.slice(lo, hi - lo)], names=["words", "stats", "label"])

    got = sorted(rows.mapInArrow(lean(run), "words binary, stats binary, label double").collect())
    index = [np.frombuffer(r[0], "<i4") for r in got]
    stats = np.array([np.frombuffer(r[1]) for r in got]).reshape(len(got), len(STATISTICS))
    return index, stats, np.array([r[2] for r in got], np.float64)


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, text: str = "text") -> Machine:
    """Fits on at most `most` labelled documents outside the held-out fold."""
    taught = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # at most `most` ids: a bounded side for the broadcast; of rows that share an id one teaches, the least by a hash of its text
    rows = docs.select(docs["doc_id"], docs[text].alias("_text"), declared_of(docs).alias("_chars")).join(F.broadcast(taught), "doc_id")
    one = F.min_by(F.struct("_text", "_chars"), F.xxhash64("_text", "_chars")).alias("_row")
    rows = rows.groupBy("doc_id").agg(one, F.first("_label").alias("_label"))
    return fit(*_examples(rows.select("_row._text", "_row._chars", "_label")))


def declared_of(docs: DataFrame) -> Column:
    return (docs[CHARS] if CHARS in docs.columns else F.lit(None)).cast("double")


def numbers(column: pa.Array) -> np.ndarray:
    """A column of doubles, NaN for nulls."""
    return column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def score(docs: DataFrame, model: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score column; all other columns stay."""
    name, chars = fresh(docs, name), fresh(docs, "declared_chars")
    at, width = docs.columns.index(text), len(docs.columns)
    bounded(docs.sparkSession)
    docs = docs.withColumn(chars, declared_of(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            declared, out = numbers(batch.column(width)), np.zeros(batch.num_rows)
            for lo, hi in chunks(offsets):
                out[lo:hi] = model.scores(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], declared[lo:hi]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out)], names=[*batch.schema.names[:width], name])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields[:width], T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, most)
    slim = docs.select(docs["doc_id"].cast("long"), docs["text"], declared_of(docs).alias(CHARS))
    scored = score(slim, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
