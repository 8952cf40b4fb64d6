"""Language-model scores by stupid backoff, over n-gram count tables partitioned by hash.

Every document is scored by the n-grams of all other documents (its own counts are taken off),
so that a text does not vouch for itself. With `order` 2:

    S(w | v) = c(v w) / c(v)                where another document has v w,
               BACKOFF * c(w) / N           where another document has w,
               BACKOFF * UNSEEN / (N + 1)   else.

v is the word before, or START for the first word; N counts the words of all other documents.
A higher order begins with longer contexts (of fewer words near the start) and backs off in the
same way, by BACKOFF each time.

1. Documents are written as chunks of about CHUNK bytes of text (compressed), to be read again.
2. Each chunk is exploded into n-grams: rows (gram, chunk, n), the gram as a 64-bit hash. A
   frequent n-gram comes once from a chunk, so that no key has more rows than there are chunks.
3. The rows are partitioned by gram. Grouped by gram, they give the count table; joined to it,
   they bring each chunk the counts of those of its n-grams that other chunks have too, by their
   places in the chunk's sorted n-grams. The hash range is done in PASSES parts, one after the
   other, so that the shuffle files of one part are on disk at a time.
4. A chunk meets the lists of its counts, and the scores are summed per document.

Rows are at most the distinct n-grams of each chunk: they grow as the text does.

Words are runs of other than white space with A-Z lower-cased. Defined results: a null, empty
or blank text has no words and score 0. Repeated rows are documents of their own. Ids may be
null. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, Staging, U64, chunks, lean, mix, stream, word_spans

BACKOFF = 0.4
UNSEEN = 0.5
ORDER = 2
CHUNK = 6 << 20
#: Text whose n-grams one task of a pass counts, in bytes; passes over the hash range.
SLICE = 8 << 20
PASSES = 4
#: Rows that a task packs at once.
PACK = 1 << 20
NAMES = {1: "n_word", 2: "n_bigram", 3: "n_trigram"}

_START = U64(0x243F6A8885A308D3)
_pair = stream(17, 2) | U64(1)
_words: Rolling | None = None


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """chunk, bytes, words, ids, ends, body: documents packed by the partition they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            body = b"".join(texts)
            words = len(word_spans(np.frombuffer(body, np.uint8), np.append(0, ends))[0])
            body = pa.compress(body, codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([part * (1 << 32) + k]), pa.array([held], pa.int64()), pa.array([words], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([body], pa.binary())], names=["chunk", "bytes", "words", "ids", "ends", "body"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                if texts and held + len(raw) > size:
                    yield out()
                    k, ids, texts, held = k + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                held += len(raw)
        if texts:
            yield out()

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lean(run), "chunk long, bytes long, words long, ids array<long>, ends array<long>, body binary")


class Grams:
    """The n-grams of a chunk up to some order, as hashes at the word that each ends in.

    of[m]: hashes of the m-grams, at the words `at[m]`; START counts as a word before the first.
    """

    def __init__(self, body: bytes, ends: list[int], size: int, order: int):
        global _words
        _words = _words or Rolling(61, LOWER)
        data = np.frombuffer(pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
        offsets = np.concatenate([[0], np.asarray(ends, np.int64)])
        start, end, self.doc = word_spans(data, offsets)
        # short ranges one after the other keep the powers small
        word = np.concatenate([self._hash(data, offsets, start, end, lo, hi) for lo, hi in chunks(offsets)] or [np.zeros(0, U64)])
        n = len(word)
        first = np.ones(n, bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.first, self.starts = first, int(first.sum())
        self.of, self.at = {1: word}, {1: np.arange(n)}
        for m in range(2, order + 1):
            # what stands before a word: the (m-1)-gram that ends in the one before it
            before = np.full(n, _START) if m == 2 else np.zeros(n, U64)
            inner = self.at[m - 1][:-1] if len(self.at[m - 1]) and self.at[m - 1][-1] == n - 1 else self.at[m - 1]
            before[inner + 1] = self.of[m - 1][: len(inner)]
            if m == 2:
                before[first] = _START
            self.at[m] = np.flatnonzero(place >= m - 2)
            self.of[m] = mix(before[self.at[m]] * _pair[0] + word[self.at[m]] * _pair[1])

    @staticmethod
    def _hash(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, lo: int, hi: int) -> np.ndarray:
        a, b = offsets[lo], offsets[hi]
        some = slice(*np.searchsorted(start, [a, b]))
        return _words.ranges(_words.prefix(data[a:b]), start[some] - a, end[some] - a)

    def hashes(self, m: int) -> np.ndarray:
        """Of the m-grams; those of words with a START for each text behind them."""
        return np.append(self.of[1], np.full(self.starts, _START)) if m == 1 else self.of[m]

    def counts(self, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(distinct hashes, their counts) of each order, in one part of the hash range."""
        for m in self.of:
            hashes = self.hashes(m)
            yield np.unique(hashes[part_of(hashes, parts) == U64(part)], return_counts=True)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash range, which grows with the hash."""
    return (hashes >> U64(32)) * U64(parts) >> U64(32)


def exploded(packs: DataFrame, order: int, part: int, parts: int) -> DataFrame:
    """gram, chunk, n, place: the distinct n-grams of each chunk in one part of the hash range, and their places among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, size, ends, body in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                first = 0
                for hashes, n in Grams(body, ends, size, order).counts(part, parts):
                    for lo in range(0, len(hashes), 1 << 17):
                        some = hashes[lo : lo + (1 << 17)].view(np.int64)
                        place = np.arange(first + lo, first + lo + len(some), dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), chunk)), pa.array(n[lo : lo + (1 << 17)].astype(np.int64)), pa.array(place)], names=["gram", "chunk", "n", "place"])
                    first += len(hashes)

    return packs.select("chunk", "bytes", "ends", "body").mapInArrow(lean(run), "gram long, chunk long, n long, place long")


def shared(grams: DataFrame, partitions: int) -> DataFrame:
    """chunk, n, steps, elsewhere: which of each chunk's n-grams other chunks have too, and how often there.

    Both sides of the join read one exchange. What a task finds for one chunk is packed, so that
    it is moved without a row for each n-gram.
    """
    dealt = grams.where("gram is not null").repartition(partitions, "gram")
    # the least place is of no use but that both sides have the same columns, and so one exchange
    counts = dealt.groupBy("gram").agg(F.sum("n").alias("total"), F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.min("place").alias("least"))
    counts = counts.where("low <> high and least >= 0").select("gram", "total")
    met = dealt.join(counts, "gram").select("chunk", "place", (F.col("total") - F.col("n")).alias("elsewhere"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            chunk, place, often = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
            held.clear()
            order = np.lexsort((place, chunk))
            chunk, place, often = chunk[order], place[order], often[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
            spans = list(zip(edges, edges[1:]))
            steps = [packed(np.diff(place[a:b], prepend=0)) for a, b in spans]
            return pa.RecordBatch.from_arrays([pa.array(chunk[edges[:-1]]), pa.array(np.diff(edges)), pa.array(steps, pa.binary()), pa.array([packed(often[a:b]) for a, b in spans], pa.binary())], names=["chunk", "n", "steps", "elsewhere"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield out()
        if held:
            yield out()

    return met.mapInArrow(lean(run), "chunk long, n long, steps binary, elsewhere binary")


def packed(counts: np.ndarray) -> bytes:
    """Counts as bytes, with 255 for a larger one that follows in full at the end."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], "<i8")
    return out


def own_counts(doc: np.ndarray, place: np.ndarray, kinds: int) -> np.ndarray:
    """How often the n-gram at each position stands in its own document."""
    if not len(doc):
        return np.zeros(0, np.int64)
    _, inverse, n = np.unique(doc * np.int64(kinds) + place, return_inverse=True, return_counts=True)
    return n[inverse]


def scored(grams: Grams, documents: int, found: list[list[tuple[np.ndarray, np.ndarray]]], corpus: int) -> tuple[np.ndarray, ...]:
    """(words, by order from the highest, unseen, log score) of each document of a chunk.

    found: for each part of the hash range, lists of places of n-grams that other chunks have too
    and how often these have them.
    """
    doc, order = grams.doc, max(grams.of)
    words = np.bincount(doc, minlength=documents)
    rest = (corpus - words)[doc]
    tables = {m: np.unique(grams.hashes(m), return_inverse=True, return_counts=True) for m in grams.of}
    totals = {m: n.astype(np.int64) for m, (_, _, n) in tables.items()}
    starts = {m: np.searchsorted(part_of(distinct, len(found)), np.arange(len(found) + 1)) for m, (distinct, _, _) in tables.items()}
    for k, lists in enumerate(found):
        first = 0  # the places of a part: those of each order, one after the other
        for m in grams.of:
            a, b = starts[m][k : k + 2]
            for place, often in lists:
                own = slice(*np.searchsorted(place, [first, first + b - a]))
                totals[m][a + place[own] - first] += often[own]
            first += b - a
    left = {}  # counts in other documents, by order and word
    for m, (distinct, place, _) in tables.items():
        place = place[: len(grams.at[m])]
        left[m] = np.zeros(len(doc), np.int64)
        left[m][grams.at[m]] = totals[m][place] - own_counts(doc[grams.at[m]], place, len(distinct))
    start = int(totals[1][np.searchsorted(tables[1][0], _START)]) if grams.starts else 0
    share, factor, open_ = np.ones(len(doc)), np.ones(len(doc)), np.ones(len(doc), bool)
    per = []
    for m in range(order, 1, -1):
        tried = np.zeros(len(doc), bool)
        tried[grams.at[m]] = True
        tried &= open_
        hit = tried & (left[m] > 0)
        before = np.zeros(len(doc), np.int64)
        before[1:] = left[m - 1][:-1]
        if m == 2:
            before[grams.first] = start - 1
        share[hit] = factor[hit] * left[m][hit] / before[hit]
        factor[tried & ~hit] *= BACKOFF
        open_ &= ~hit
        per.append(hit)
    seen = open_ & (left[1] > 0)
    share[seen] = factor[seen] * left[1][seen] / rest[seen]
    unseen = open_ & ~seen
    share[unseen] = factor[unseen] * UNSEEN / (rest[unseen] + 1)
    per = [np.bincount(doc, x, documents).astype(np.int64) for x in (*per, seen, unseen)]
    return words, *per, np.bincount(doc, np.log(share), documents).astype(np.float64)


def score(spark: SparkSession, docs: DataFrame, order: int = ORDER, chunk: int = CHUNK, part: int = SLICE, passes: int = PASSES) -> DataFrame:
    """doc_id, n_words, the words found by each order, n_unseen, log_score (natural logarithm, summed) of every document."""
    if order < 1:
        raise ValueError("the order is at least 1")
    staged = Staging(spark, "ngrams")
    packs = staged.put("chunks", chunked(docs, chunk))
    size, corpus = packs.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    partitions = max(1, -(-size // (part * passes)))
    rows = packs.drop("words").withColumns({"pass": F.lit(-1), **{c: F.lit(None).cast(t) for c, t in (("n", "long"), ("steps", "binary"), ("elsewhere", "binary"))}})
    for k in range(passes):
        found = staged.put(f"shared-{k}", shared(exploded(packs, order, k, passes), partitions), slim=True)
        rows = rows.unionByName(found.withColumn("pass", F.lit(k)), allowMissingColumns=True)
    names = ["doc_id", "n_words", *[NAMES.get(m, f"n_{m}gram") for m in range(order, 0, -1)], "n_unseen", "log_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, lists = None, []

        def out() -> pa.RecordBatch:
            size, ids, ends, body = pack
            values = scored(Grams(body, ends, size, order), len(ids), lists, corpus)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(x) for x in values]], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column(4)[k].as_py()
                if part < 0:  # a chunk begins
                    if pack is not None:
                        yield out()
                    pack, lists = [batch.column(c)[k].as_py() for c in range(4)], [[] for _ in range(passes)]
                else:
                    n, steps, often = (batch.column(c)[k].as_py() for c in (5, 6, 7))
                    lists[part].append((np.cumsum(unpacked(steps, n)), unpacked(often, n)))
        if pack is not None:
            yield out()

    # behind each chunk's text its lists
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "pass").select("bytes", "ids", "ends", "body", "pass", "n", "steps", "elsewhere")
    kinds = {"doc_id": "long", "log_score": "double"}
    return dealt.mapInArrow(lean(run), ", ".join(f"{x} {kinds.get(x, 'long')}" for x in names))
