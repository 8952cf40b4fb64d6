"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation, components.

1. One pass over whole texts gives each document's set of five-word shingles as 64-bit hashes:
   its size, a 128-bit key of the set, MINS minima in BANDS bands of ROWS, and an odd sketch:
   the minima folded into a bitmap by parity. The XOR of two sketches has about
   n/2 (1 - exp(-4 k (1 - J) / n)) bits, which gives the similarity J back.
2. Documents of one set key are one class; only classes go on.
3. First round, over the first CHAIN bands, to bring large groups together cheaply: classes of one
   band value are sorted in a random order, and within a task neighbours are compared, and in
   crowds of CROWD or more (up to MOST at once) all with their pivot, the class nearest to the
   majority of their odd sketches' bits (the original, where all are copies of one). Each class
   keeps its nearest partner and its least pivot. What this round misses, the second finds.
4. Second round, over all bands: in every band value whose classes are still in several components,
   all classes outside the largest of these (probes) are compared with all its classes, in blocks.
   A pair of one component needs no test, so nothing is lost, and large groups of copies never
   make all pairs. A pair is tested in the first band that it shares. It passes if its odd sketches
   are within MARGIN of the threshold, and then if odd sketches of the whole sets (4 bits a shingle)
   are within SIGMAS deviations of it. Of the pairs of a probe with one component that are beyond
   the threshold by SIGMAS deviations, one is enough. Rows of crowded band values (MANY classes or
   more, PROBES of them probes) carry their full sets, and what the sketches leave open is decided
   there, so that the pairs that leave a band value do not grow with the square of its classes.
5. What passes is confirmed on the full sets. Components by contraction, in the second round of
   the first round's components; every document gets the smallest id of its component.

With 24 bands of 3, a pair at exactly 0.75 shares no band with probability 2e-6.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a
text of fewer than five words is one shingle. Rows that repeat an id are one document to the
`kept` rule (all rows with the least id of a component are kept). Null ids count as the
largest; a component of null ids only has a null id and keeps nothing. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Rolling, Staging, U64, chunks, fresh, lean, mix, stream, text_buffer, word_spans
from .components import components

WIDTH = 5
BANDS, ROWS, CHAIN = 24, 3, 8
MINS = 96
BITS = 512
MARGIN, CLOSE = 0.25, 0.05
SIGMAS = 5.5
BLOCK = 64
CROWD, MOST = 16, 4096
MANY, PROBES = 64, 16
#: Slots of the table of wanted ids that is sent to all tasks: its size bound.
SLOTS = 1 << 18
LAST = (1 << 63) - 1

_words: Rolling | None = None
_shift, _factor, _fold = stream(5, MINS), stream(6, MINS) | U64(1), stream(7, MINS)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one after the other; how many each has)."""
    global _words
    _words = _words or Rolling(41, LOWER)
    n = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    hashed = _words.ranges(_words.prefix(data), start, end)
    words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    weight = stream(8, WIDTH)
    total = hashed[: max(0, len(hashed) - WIDTH + 1)] * weight[0]
    for k in range(1, WIDTH):
        total = total + hashed[k : len(total) + k] * weight[k]
    total = mix(total)
    out, sizes = [], np.zeros(n, np.int64)
    for k in range(n):
        a, w = first[k], words[k]
        if w >= WIDTH:
            found = np.unique(total[a : a + w - WIDTH + 1])
        elif w:
            found = mix((hashed[a : a + w] * weight[:w]).sum(keepdims=True) + U64(w))
        else:
            continue
        out.append(found)
        sizes[k] = len(found)
    return np.concatenate(out) if out else np.zeros(0, U64), sizes


def set_keys(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit keys of whole sets, n x 16 bytes; zeros for empty ones."""
    full = np.flatnonzero(sizes)
    keys = np.zeros((len(sizes), 2), U64)
    if len(full):
        start = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
        keys[full, 0] = mix(np.add.reduceat(mix(found + U64(1)), start))
        keys[full, 1] = mix(np.add.reduceat(mix(found ^ U64(0x5851F42D4C957F2D)), start) + sizes[full].astype(U64))
    return keys.view(np.uint8)


def signatures(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set keys as n x 16 bytes, band values n x BANDS, odd sketches n x BITS/8) of texts with shingles."""
    full = np.flatnonzero(sizes)
    n = len(sizes)
    bands, odd = np.zeros((n, BANDS), np.int64), np.zeros((n, BITS // 8), np.uint8)
    if not len(full):
        return set_keys(found, sizes), bands, odd
    start = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
    mins = np.stack([np.minimum.reduceat((found ^ _shift[k]) * _factor[k], start) for k in range(MINS)], axis=1)
    for b in range(BANDS):
        part = mins[:, b * ROWS : (b + 1) * ROWS]
        bands[full, b] = mix((part * stream(9, ROWS)).sum(axis=1, dtype=U64) + U64(b)).view(np.int64)
    bit = (mix(mins ^ _fold) % U64(BITS)).astype(np.int64) + np.arange(len(full))[:, None] * BITS
    parity = (np.bincount(bit.ravel(), minlength=len(full) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
    odd[full] = np.packbits(parity, axis=1)
    return set_keys(found, sizes), bands, odd


def whole_sketches(found: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Odd sketches of full sets, of a power of two of bits: at least 4 a shingle and 512."""
    bits = np.left_shift(512, np.ceil(np.log2(np.maximum(sizes / 128, 1))).astype(np.int64))
    place = mix(found ^ U64(0xA24BAED4963EE407)) & np.repeat(bits - 1, sizes).astype(U64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [np.packbits((np.bincount(place[a:b].astype(np.int64), minlength=n) & 1).astype(np.uint8)).tobytes() if b > a else b"" for a, b, n in zip(ends, ends[1:], bits)]


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows x bytes) folded to `width` bytes."""
    while rows.shape[-1] > width:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def excess(x: np.ndarray, width: int, total: np.ndarray, threshold: float) -> np.ndarray:
    """By how much XOR counts of whole sketches exceed the most that a pair at the threshold may have."""
    return excesses(x, width, total, threshold)[0]


def excesses(x: np.ndarray, width: int, total: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """By how much XOR counts of whole sketches exceed the most and the least that a pair at the threshold may have.

    total: sums of the two set sizes. A pair at the threshold differs in d = total (1 - t)/(1 + t)
    shingles, whose parity bits have this mean and this deviation.
    """
    n = width * 8
    d = total * (1 - threshold) / (1 + threshold)
    shrunk = np.exp(-2 * d / n)
    mean, variance = n / 2 * (1 - shrunk), n / 4 * (1 - shrunk**2) - d * shrunk**2
    spread = SIGMAS * np.sqrt(np.maximum(variance, 0)) + 1
    return x - mean - spread, x - mean + spread


def similarity(distance: np.ndarray) -> np.ndarray:
    """The similarity that XOR population counts of odd sketches stand for."""
    return 1 + BITS / (4 * MINS) * np.log(np.maximum(1 - 2 * distance / BITS, 1e-9))


_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[a ^ b].sum(axis=-1, dtype=np.int64)


def most_bits(threshold: float, margin: float) -> int:
    """The largest XOR count of odd sketches that a pair within the margin below the threshold may have."""
    return int(BITS / 2 * (1 - np.exp(-4 * MINS * (1 - threshold + margin) / BITS)))


def _fixed(x: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return text_buffer(column)[0].reshape(-1, width)


def alike(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """Whether two sorted sets have a similarity of `share` hundredths."""
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
    return 100 * both >= share * (len(x) + len(y) - both)


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes that tell rows apart by id and text."""
    return [F.xxhash64(F.lit(k), docs["doc_id"].cast("long"), docs["text"]) for k in (1, 2)]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, row keys, n_shingles, set_key (null: no shingles), bands, marks (their low 32 bits), odd, whole of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(3))
            for lo, hi in chunks(offsets):
                found, sizes = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keys, bands, odd = signatures(found, sizes)
                key = pc.if_else(pa.array(sizes > 0), _fixed(keys), pa.scalar(None, pa.binary()))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:3], pa.array(sizes), key, flat, _fixed(bands.astype("<u4").view(np.uint8).reshape(hi - lo, -1)), _fixed(odd), pa.array(whole_sketches(found, sizes), pa.binary())], names=["doc_id", "row_1", "row_2", "n_shingles", "set_key", "bands", "marks", "odd", "whole"])

    return docs.select(docs["doc_id"].cast("long"), *row_keys(docs), docs["text"]).mapInArrow(lean(run), "doc_id long, row_1 long, row_2 long, n_shingles long, set_key binary, bands array<long>, marks binary, odd binary, whole binary")


def _sorted(doc_id: Column) -> Column:
    """8 bytes that sort by id; a null id is the largest."""
    return F.unhex(F.lpad(F.hex(F.coalesce(doc_id, F.lit(LAST)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def node_of(doc_id: Column, set_key: Column) -> Column:
    """24 bytes that sort by id, then by set."""
    return F.concat(_sorted(doc_id), set_key)


def id_of(node: Column) -> Column:
    value = F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.nullif(value.cast("long"), F.lit(LAST))


def partners(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of near neighbours and pivots within the values of the first CHAIN bands."""
    limit = most_bits(threshold, CLOSE)
    rows = classes.select(F.explode(F.slice("bands", 1, CHAIN)).alias("band"), "node", "odd").withColumn("turn", F.xxhash64("band", "node"))
    # a frequent band value spans partitions; other bands sort its classes in another order
    dealt = rows.repartitionByRange("band", "turn").sortWithinPartitions("band", "turn").select("band", "node", "odd")

    def found(band: np.ndarray, node: np.ndarray, odd: np.ndarray) -> pa.RecordBatch:
        x = np.flatnonzero(band[1:] == band[:-1])
        far = distances(odd[x], odd[x + 1])
        x, far = x[far <= limit], far[far <= limit]
        own, other, by, central = [x, x + 1], [x + 1, x], [far, far], [np.zeros(2 * len(x), bool)]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(band)) + 1, [len(band)]])
        for k in np.flatnonzero(np.diff(edges) >= CROWD):
            for lo in range(edges[k], edges[k + 1], MOST):
                hi = min(lo + MOST, edges[k + 1])
                bits = np.zeros(BITS, np.int64)
                for at in range(lo, hi, 256):
                    bits += np.unpackbits(odd[at : min(at + 256, hi)], axis=1).sum(axis=0, dtype=np.int64)
                pivot = lo + int(np.argmin(distances(odd[lo:hi], np.packbits(2 * bits > hi - lo))))
                far = distances(odd[lo:hi], odd[pivot])
                near = np.flatnonzero(far <= limit)
                near = near[near != pivot - lo]
                own.append(near + lo)
                other.append(np.full(len(near), pivot))
                by.append(far[near])
                central.append(np.ones(len(near), bool))
        own, other = np.concatenate(own), np.concatenate(other)
        return pa.RecordBatch.from_arrays([_fixed(node[own]), _fixed(node[other]), pa.array(np.concatenate(by)), pa.array(np.concatenate(central))], names=["node", "partner", "far", "central"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), _matrix(batch.column(1), 24), _matrix(batch.column(2), BITS // 8)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last value may go on
            last += (len(held[0]) - last) // MOST * MOST
            if last:
                yield found(*[x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield found(*held)

    near = dealt.mapInArrow(lean(run), "node binary, partner binary, far long, central boolean")
    kept = near.groupBy("node").agg(F.min(F.struct("far", "partner"))["partner"].alias("nearest"), F.min(F.when(F.col("central"), F.col("partner"))).alias("pivot"))
    pairs = kept.select("node", F.explode(F.array_compact(F.array("nearest", "pivot"))).alias("partner"))
    return pairs.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()


def blocks(rows: DataFrame) -> DataFrame:
    """band, place, probing and lists of nodes, components, sketches, sizes, sets, probes: up to BLOCK rows of one band value."""
    mixed = rows.withColumn("turn", F.xxhash64("node"))
    # probes first, so that they share few blocks; a frequent band value spans partitions
    dealt = mixed.repartitionByRange("band", "rest", "turn").sortWithinPartitions("band", "rest", "turn").drop("turn")
    names = ["node", "label", "marks", "odd", "whole", "n_shingles", "set", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(x: pa.Table) -> pa.RecordBatch:
            band = x.column("band").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(band)] if len(band) else []
            spans = [(lo, min(lo + BLOCK, b)) for a, b in zip(edges, edges[1:]) for lo in range(a, b, BLOCK)]
            ends = pa.array([0, *[b for _, b in spans]], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x.column(c).combine_chunks()) for c in names]
            probing = [not all(x.column("rest").slice(a, b - a).to_pylist()) for a, b in spans]
            place = x.column("place").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array([band[a] for a, _ in spans], pa.int64()), pa.array([place[a] for a, _ in spans], pa.int32()), pa.array(probing, pa.bool_()), *lists], names=["band", "place", "probing", *names])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            band = held.column("band").to_numpy()
            last = int(np.searchsorted(band, band[-1])) if len(band) else 0
            last += (len(band) - last) // BLOCK * BLOCK
            yield emit(held.slice(0, last))
            held = held.slice(last)
        if held is not None:
            yield emit(held)

    fields = "band long, place int, probing boolean, node array<binary>, label array<long>, marks array<binary>, odd array<binary>, whole array<binary>, n_shingles array<long>, set array<binary>, rest array<boolean>"
    return dealt.select("band", "place", *names).mapInArrow(lean(run), fields)


class Side:
    """One block's rows, with whole sketches by width, and sets where the band value is crowded."""

    def __init__(self, node: pa.Array, label: pa.Array, marks: pa.Array, odd: pa.Array, whole: pa.Array, sizes: pa.Array, sets: pa.Array):
        self.node, self.label, self.odd = _matrix(node, 24), label.to_numpy(), _matrix(odd, BITS // 8)
        self.marks = _matrix(marks, 4 * BANDS).view("<u4")
        self.whole, self.sizes = [np.frombuffer(x, np.uint8) for x in whole.to_pylist()], sizes.to_numpy()
        self.sets = [None if x is None else np.frombuffer(x, U64) for x in sets.to_pylist()]
        self.widths = np.array([len(x) for x in self.whole])
        self.by_width = {w: np.stack([self.whole[k] for k in np.flatnonzero(self.widths == w)]) for w in np.unique(self.widths)}

    def excesses(self, whole: np.ndarray, size: int, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Of one sketch against some rows."""
        most, least = np.empty(len(rows)), np.empty(len(rows))
        for width, held in self.by_width.items():
            mine = np.flatnonzero(self.widths[rows] == width)
            if len(mine):
                common = min(width, len(whole))
                place = np.searchsorted(np.flatnonzero(self.widths == width), rows[mine])
                x = distances(folded(whole, common), folded(held[place], common))
                most[mine], least[mine] = excesses(x, common, self.sizes[rows[mine]] + size, threshold)
        return most, least


def across(dealt: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of a probe and a row of another component that pass both sketches and, where
    their band value is crowded, the test of full sets; of those of one component that are surely
    linked to the probe, one."""
    limit = most_bits(threshold, MARGIN)
    share = round(threshold * 100)
    names = ["node", "label", "marks", "odd", "whole", "n_shingles", "set", "rest"]
    left = dealt.where("probing").select("band", "place", *[F.col(c).alias(f"l_{c}") for c in names])
    joined = left.join(dealt.select("band", *names[:-1]), "band").drop("band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure: dict[tuple[bytes, int], tuple[float, bytes]] = {}  # the best of a probe and component
        open_: dict[tuple[bytes, int], list[bytes]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(probe, label, other, False) for (probe, label), others in open_.items() if (probe, label) not in sure for other in others]
            rows += [(probe, label, other, True) for (probe, label), (_, other) in sure.items()]
            sure.clear()
            open_.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.bool_()))], names=["probe", "label", "other", "sure"])

        for batch in batches:
            for k in range(batch.num_rows):
                place, row = batch.column(0)[k].as_py(), [batch.column(c)[k].values for c in range(1, batch.num_columns)]
                left, right = Side(*row[:7]), Side(*row[8:])
                for j in np.flatnonzero(~row[7].to_numpy(zero_copy_only=False)):
                    near = np.flatnonzero((distances(left.odd[j], right.odd) <= limit) & (right.label != left.label[j]))
                    near = near[np.argmax(right.marks[near] == left.marks[j], axis=1) == place]
                    if not len(near):
                        continue
                    most, least = right.excesses(left.whole[j], left.sizes[j], near, threshold)
                    probe = left.node[j].tobytes()
                    for i in np.flatnonzero(most <= 0):
                        key, other = (probe, int(right.label[near[i]])), right.node[near[i]].tobytes()
                        if least[i] <= 0:
                            own = (float(most[i] / (right.sizes[near[i]] + left.sizes[j])), other)
                            sure[key] = min(sure.get(key, own), own)
                        elif key in sure:
                            continue
                        elif left.sets[j] is not None and right.sets[near[i]] is not None:
                            if alike(left.sets[j], right.sets[near[i]], share):
                                sure[key] = (-np.inf, other)
                        else:
                            open_.setdefault(key, []).append(other)
                            held += 1
            if held > 1 << 17:
                yield out()
                held = 0
        yield out()

    found = joined.mapInArrow(lean(run), "probe binary, label long, other binary, sure boolean")
    # tasks that share a probe and a component may each have found one that is sure
    kept = found.groupBy("probe", "label", F.when(~F.col("sure"), F.col("other")).alias("open")).agg(F.min("other").alias("other"))
    return kept.select(F.least("probe", "other").alias("a"), F.greatest("probe", "other").alias("b")).distinct()


def texts_of(staged: Staging, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """own (8 bytes of the id), text of the documents whose id falls in a slot of some node; the slots are at most SLOTS."""
    slot = lambda own: F.pmod(F.xxhash64(own), F.lit(SLOTS))
    wanted = staged.put("slots", nodes.select(slot(F.substring("node", 1, 8)).alias("slot")).distinct())
    rows = docs.select(_sorted(docs["doc_id"].cast("long")).alias("own"), docs["text"]).withColumn("slot", slot(F.col("own")))
    return rows.join(F.broadcast(wanted), "slot", "left_semi").select("own", "text")


def sets_of(staged: Staging, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, set (its sorted shingle hashes, 8 bytes each) of some nodes, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            own = _matrix(batch.column(0), 8)
            for lo, hi in chunks(offsets):
                found, sizes = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                node = _fixed(np.hstack([own[lo:hi], set_keys(found, sizes)]))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sets = pa.array([found[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([node, sets], names=["node", "set"])

    found = texts_of(staged, nodes, docs).mapInArrow(lean(run), "node binary, set binary")
    # rows that repeat an id and a set are one
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def confirm(staged: Staging, pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity.

    Only texts whose id falls in a slot that some pair wants are read on.
    """
    share = round(threshold * 100)
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).withColumn("side", F.col("node") != F.col("a"))
    rows = texts_of(staged, sides, docs)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            own = _matrix(batch.column(0), 8)
            for lo, hi in chunks(offsets):
                found, sizes = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                node = _fixed(np.hstack([own[lo:hi], set_keys(found, sizes)]))
                yield pa.RecordBatch.from_arrays([node, batch.column(1).slice(lo, hi - lo)], names=["node", "text"])

    # rows that repeat an id and a set are one
    texts = rows.mapInArrow(lean(named), "node binary, text string").groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the first side of a pair whose second comes next
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows // 2 * 2
            held = batch.slice(n) if n < batch.num_rows else None
            data, offsets = text_buffer(batch.column(2).slice(0, n))
            keep = np.zeros(n // 2, bool)
            for lo, hi in chunks(offsets[::2]):
                some = offsets[2 * lo : 2 * hi + 1]
                found, sizes = shingles(data[some[0] : some[-1]], some - some[0])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(hi - lo):
                    x, y = (found[ends[j] : ends[j + 1]] for j in (2 * k, 2 * k + 1))
                    keep[lo + k] = alike(x, y, share)
            first = batch.slice(0, n).take(pa.array(np.flatnonzero(keep) * 2))
            yield first.select([0, 1])

    met = sides.join(texts, "node").select("a", "b", "side", "text")
    dealt = met.repartition("a", "b").sortWithinPartitions("a", "b", "side").select("a", "b", "text")
    return dealt.mapInArrow(lean(run), "a binary, b binary")


def groups(spark: SparkSession, docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, row_1, row_2 (its keys), n_shingles, set_key, least (the least node of its component) of every document."""
    staged = Staging(spark, "minhash")
    rows = staged.put("rows", sketch(docs))
    grouped = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "marks", "odd", "whole")])
    classes = staged.put("classes", grouped.select("*", node_of(F.col("doc_id"), F.col("set_key")).alias("node")).drop("doc_id"))

    pairs = staged.put("pairs-1", partners(classes, threshold))
    links = staged.put("links-1", confirm(staged, pairs, docs, threshold))
    labels = components(staged, links, "components-1")

    # band values with several components; components are told apart by a hash of their labels
    named = classes.join(labels, "node", "left").select("node", "bands", F.xxhash64(F.coalesce("label", "node")).alias("label"))
    named = staged.put("named", named)
    tally = named.select(F.explode("bands").alias("band"), "label").groupBy("band", "label").agg(F.count("*").alias("n"))
    several = tally.groupBy("band").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    several = several.select("band", F.col("most.label").alias("largest"), ((F.col("n") >= MANY) & (F.col("n") - F.col("most.n") >= PROBES)).alias("crowded"))
    placed = named.select(F.posexplode("bands").alias("place", "band"), "node", "label").join(several, "band")
    at = staged.put("placed", placed.select("band", "place", "node", "label", "crowded", (F.col("label") == F.col("largest")).alias("rest")))
    sets = staged.put("sets", sets_of(staged, at.where("crowded").select("node").distinct(), docs))
    held = classes.select("node", "marks", "odd", "whole", "n_shingles").join(sets, "node", "left")
    dealt = staged.put("blocks", blocks(at.join(held, "node").withColumn("set", F.when(F.col("crowded"), F.col("set")))))
    staged.drop("placed", "sets")
    pairs = staged.put("pairs-2", across(dealt, threshold))
    found = staged.put("links-2", confirm(staged, pairs, docs, threshold))
    for x in "ab":
        found = found.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")), x, "left").withColumn(x, F.coalesce(f"{x}_label", x)).drop(f"{x}_label")
    merged = components(staged, found, "components-2").select(F.col("node").alias("label"), F.col("label").alias("beyond"))

    final = classes.join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("label")).join(merged, "label", "left")
    final = staged.put("final", final.select(F.col("set_key").alias("class_key"), F.coalesce("beyond", "label").alias("least")))
    staged.drop("pairs-1", "links-1", "components-1", "named", "blocks", "pairs-2", "links-2", "slots", "components-2", "classes")
    out = rows.select("doc_id", "row_1", "row_2", "n_shingles", "set_key").join(final, F.col("set_key") == F.col("class_key"), "left")
    return out.drop("class_key")


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    found = groups(spark, docs, threshold)
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(id_of(F.col("least")))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_copies(spark: SparkSession, docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs with one row of each component: of its least id, and of several texts of one id and set
    the least by a hash. Rows without words stay, each distinct id and text once; null ids count as the largest."""
    found = groups(spark, docs, threshold)
    named = [fresh(docs, x) for x in ("row_1", "row_2")]
    first = F.col("set_key").isNull() | (node_of(F.col("doc_id"), F.col("set_key")) == F.col("least"))
    own = F.coalesce(F.hex("set_key"), F.concat_ws(" ", "row_1", "row_2"))
    kept = found.where(first).groupBy("doc_id", own.alias("own")).agg(F.min(F.struct("row_1", "row_2")).alias("row"))
    kept = kept.select(*[F.col(f"row.{x}").alias(name) for x, name in zip(("row_1", "row_2"), named)])
    keyed = docs.withColumns(dict(zip(named, row_keys(docs))))
    return keyed.join(kept, named).dropDuplicates(named).select(*docs.columns)
