"""Repeated passages over a corpus, by prefix-free parsing: every byte of a 400-byte string that starts twice.

A rolling hash of TRIGGER bytes sets phrase ends wherever it is 0 modulo a period (the sparsest
of PERIODS with a trigger in reach of a window), so that equal passages are cut alike wherever
they stand. As in a prefix-free parse, the order of two positions is that of the phrase suffix
up to the next trigger, then of what follows the trigger. Removal asks of that order only which
neighbours share `length` bytes, so suffixes get names in place of ranks, level by level, and
equal names meet as neighbours in a range sort:

1. Windows of `length` bytes are grouped into cells by their next trigger and their distance
   to it, CELL distances together. A cell has two names: `core`, of the bytes that all windows
   at these distances share, and `whole`, of the bytes that its own windows cover. A window
   without a trigger in reach is a cell of its own.
2. All cells are sorted by core, then by whole, and read in runs. A core that stands alone has no
   repeated window. Where neighbours have the same whole, all their windows are repeated.
3. Cores with several wholes go on: of each whole, one occurrence (a unit) is taken apart into
   windows, which are named in turn. A window of a whole that stands alone is repeated where its
   name comes from two units, or from one that occurs twice.

A run may be cut, by the end of a partition or of what a task holds at once, so no task has to
hold a run. Cores at a cut count as ones with several wholes: both sides give units, and a whole
whose two occurrences lie on either side of a cut gives two, whose windows then meet by name.

Names are 64-bit hashes, always compared in pairs (core and whole, core and window) of two
independent ones. Marked windows are gathered per document, which bounds each list.

Defined results: a null text is empty; texts shorter than `length` keep all. Repeated rows are
copies of each other, so they remove each other's windows. Other columns are ignored by
`digests` and kept by `remove`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, Staging, U64, chunks, fresh, lean, text_buffer

LENGTH = 400
TRIGGER = 16
#: From sparse to dense: text that repeats itself may lack the sparse triggers for long.
PERIODS = (128, 32, 4)
CELL = 120
#: Cells that a task reads at once.
HELD = 1 << 16

_core: Rolling | None = None
_whole: Rolling | None = None


def _hashes() -> tuple[Rolling, Rolling]:
    global _core, _whole
    if _core is None:
        _core, _whole = Rolling(101), Rolling(202)
    return _core, _whole


def rolled(core: Rolling, prefix: np.ndarray) -> np.ndarray:
    """Short rolling hashes of the TRIGGER bytes from each position on."""
    n = max(0, len(prefix) - TRIGGER)
    rolling = (prefix[TRIGGER:] - prefix[:n]) * core.down[:n]
    return ((rolling * U64(0x9E3779B97F4A7C15)) >> U64(48)).astype(np.uint16)


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n positions the inclusive ranges cover."""
    edge = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last + 1, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def cells(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, core, whole) of the cells of some texts.

    Windows take the sparsest of PERIODS that has a trigger in their reach.
    """
    core, whole = _hashes()
    n, reach = len(data), length - TRIGGER  # the farthest trigger that a window still holds
    p1 = core.prefix(data)
    has = offsets[1:] - length >= offsets[:-1]
    left = _covered(n, offsets[:-1][has], (offsets[1:] - length)[has])  # windows without a cell so far
    starts, ends, anchors = [], [], []
    hashed = rolled(core, p1)
    for period in PERIODS:
        places = np.flatnonzero(left)
        if not len(places):
            break
        at = np.flatnonzero(hashed & np.uint16(period - 1) == 0)  # periods are powers of two
        own = np.searchsorted(offsets, at, side="right") - 1
        inside = at + TRIGGER <= offsets[own + 1]
        at, own = at[inside], own[inside]
        lo = np.maximum(np.append(-1, at[:-1])[: len(at)] + 1, offsets[own])
        for q in range(-(-reach // CELL)):
            a = np.maximum(lo, at - np.minimum(CELL * q + CELL - 1, reach - 1))
            b = at - CELL * q
            # windows left over in [a, b]; they are neighbours, as taken ones lie `reach` apart
            i, j = np.searchsorted(places, a), np.searchsorted(places, b, side="right") - 1
            keep = (i <= j) & (a <= b)
            starts.append(places[i[keep]])
            ends.append(places[j[keep]])
            anchors.append(b[keep])
        left &= ~_covered(n, np.concatenate(starts), np.concatenate(ends))
    bare = np.flatnonzero(left)
    start, end, anchor = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (starts, ends, anchors))
    p2 = whole.prefix(data)
    names = [
        np.concatenate([core.ranges(p1, anchor, anchor - CELL + 1 + length), core.ranges(p1, bare, bare + length)]),
        np.concatenate([whole.ranges(p2, start, end + length), whole.ranges(p2, bare, bare + length)]),
    ]
    start, end = np.concatenate([start, bare]), np.concatenate([end, bare])
    doc = np.searchsorted(offsets, start, side="right") - 1
    return doc, start - offsets[doc], end - start + 1, names[0].view(np.int64), names[1].view(np.int64)


def _keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[Column, Column]:
    """What tells documents apart: the id (null: the least long) and a hash of the text. Rows alike in both are copies."""
    return F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(docs[text], F.lit("")))


def _cell_places(docs: DataFrame, length: int) -> DataFrame:
    """id, hash, place (start * 128 + windows), core, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in chunks(offsets):
                doc, start, n, core, whole = cells(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[lo:hi][doc], hashes[lo:hi][doc], start * 128 + n, core, whole)], names=["id", "hash", "place", "core", "whole"])

    key, hashed = _keyed(docs)
    return docs.select(key.alias("id"), hashed.alias("hash"), "text").mapInArrow(lean(run), "id long, hash long, place long, core long, whole long")


def _windows(units: DataFrame, length: int) -> DataFrame:
    """core, name, id, hash, start, often of each window of the units listed beside a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _hashes()[1]
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for k, (doc_id, hashed, listed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                prefix = whole.prefix(data[offsets[k] : offsets[k + 1]])
                place = np.array([u["place"] for u in listed], np.int64)
                n = place % 128
                start = np.repeat(place // 128, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                name = whole.ranges(prefix, start, start + length).view(np.int64)
                core = np.repeat(np.array([u["core"] for u in listed], np.int64), n)
                often = np.repeat(np.array([u["often"] for u in listed], bool), n)
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(name), pa.array(np.full(len(start), doc_id)), pa.array(np.full(len(start), hashed)), pa.array(start), pa.array(often)], names=["core", "name", "id", "hash", "start", "often"])

    return units.mapInArrow(lean(run), "core long, name long, id long, hash long, start long, often boolean")


def _marked(cells: DataFrame) -> DataFrame:
    """id, hash, place, core, often, unit of every cell: whether its whole stands beside its like, and whether it is a unit."""
    dealt = cells.repartitionByRange("core", "whole", "id", "place").sortWithinPartitions("core", "whole", "id", "place")

    def mark(rows: pa.Table) -> pa.RecordBatch:
        ids, hashes, place, core, whole = (rows.column(c).to_numpy() for c in ("id", "hash", "place", "core", "whole"))
        n = len(core)
        new_core = np.concatenate([[True], core[1:] != core[:-1]])
        first = new_core | np.concatenate([[True], whole[1:] != whole[:-1]])  # of a whole
        starts = np.flatnonzero(first)
        times = np.diff(np.append(starts, n))
        of_core = np.cumsum(new_core) - 1
        several = np.bincount(of_core[starts]) > 1
        several[[0, -1]] = True  # what lies beyond the cut is not seen here
        often = np.repeat(times > 1, times)
        unit = first & several[of_core]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, hashes, place, core, often, unit)], names=["id", "hash", "place", "core", "often", "unit"])

    def sliced(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, rows.num_rows, 1 << 13):  # what the JVM gets at once
            yield rows.slice(lo, 1 << 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield from sliced(mark(pa.Table.from_batches(held)))
                held.clear()
        if held:
            yield from sliced(mark(pa.Table.from_batches(held)))

    return dealt.mapInArrow(lean(run), "id long, hash long, place long, core long, often boolean, unit boolean")


def marks(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, spans array<struct<start, end>>): windows that start twice in the corpus, by document."""
    if length < CELL + TRIGGER:
        raise ValueError(f"passages must have at least {CELL + TRIGGER} bytes")
    staged = Staging(spark, "repeats")
    cells = staged.put("cells", _cell_places(docs, length))  # the sort reads them twice
    marked = staged.put("marked", _marked(cells).where("often or unit"), slim=True)
    staged.drop("cells")
    listed = marked.where("unit").groupBy("id", "hash").agg(F.collect_list(F.struct("core", "place", "often")).alias("units"))
    listed = staged.put("listed", listed)
    key, hashed = _keyed(docs)
    # rows alike in id and text come twice here; all their wholes occur twice too, so no count changes
    texts = docs.select(key.alias("id"), hashed.alias("hash"), "text")
    held = texts.join(listed, ["id", "hash"]).select("id", "hash", "text", "units")
    windows = staged.put("windows", _windows(held, length))
    named = windows.groupBy("core", "name").agg(F.sum(F.when(F.col("often"), 2).otherwise(1)).alias("n")).where("n > 1").select("core", "name")
    named = staged.put("named", named)
    found = windows.where(~F.col("often")).join(named, ["core", "name"]).select("id", "hash", "start", (F.col("start") + length).alias("end"))
    cell = F.shiftright("place", 7)
    end = cell + F.col("place").bitwiseAND(F.lit(127)) - 1 + length
    spans = marked.where("often").select("id", "hash", cell.alias("start"), end.alias("end")).unionAll(found)
    out = staged.put("spans", spans.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    staged.drop("marked", "listed", "windows", "named")
    return out


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for run in runs for x in run], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _beside(spark: SparkSession, docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """docs with the spans of each row, and that column's name."""
    name = fresh(docs, "repeated_spans")
    key, hashed = _keyed(docs)
    own_id, own_hash, span_id, span_hash = (fresh(docs, x) for x in ("own_id", "own_hash", "span_id", "span_hash"))
    found = marks(spark, docs, length).select(F.col("id").alias(span_id), F.col("hash").alias(span_hash), F.col("spans").alias(name))
    own = docs.withColumns({own_id: key, own_hash: hashed})
    joined = own.join(found, (F.col(own_id) == F.col(span_id)) & (F.col(own_hash) == F.col(span_hash)), "left")
    return joined.select(*docs.columns, name), name


def remove(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of text, and their runs in repeated_spans.

    Half a character left at an edge is dropped, as text must stay UTF-8.
    """
    beside, name = _beside(spark, docs, length)
    at, last = docs.columns.index("text"), len(docs.columns)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, runs = [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()):
                found = union(spans)
                texts.append(text if not found else _kept(text.encode(), found).decode("utf-8", "ignore"))
                runs.append([{"start": a, "end": b} for a, b in found])
            columns = list(batch.columns)
            columns[at], columns[last] = pa.array(texts, batch.schema.field(at).type), pa.array(runs, kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return beside.mapInArrow(lean(run), schema)


def digests(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    beside, _ = _beside(spark, docs.select("doc_id", "text"), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw, found = (text.as_py() or "").encode(), union(spans)
                for out, x in zip(rows, (len(raw), sum(b - a for a, b in found), len(found), hashlib.sha256(_kept(raw, found)).hexdigest())):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in rows[:3]], pa.array(rows[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    typed = beside.select(F.col("doc_id").cast("long").alias("doc_id"), *beside.columns[1:])
    return typed.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
