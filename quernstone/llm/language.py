"""Language identification by fusing text likelihoods with declared language, address suffix and host.

All tables are counts over all rows, by grouped aggregation:

1. Hashed byte trigrams by declared language give naive Bayes text models. Each distinct trigram
   of a text counts once, and the sum is scaled down to at most EVIDENCE trigrams' worth, as
   neighbouring trigrams are no independent evidence.
2. Rows classed by text alone, counted by (class, declared language), (class, suffix) and
   (class, host), give the likelihoods of a declaration and of a suffix, and the host priors:
   a host's share is drawn to its parent domain's, which is drawn to the overall share.
3. The posterior is the normalised product. Class UNKNOWN has uniform trigrams, for texts that
   no learned language explains.

Every declared language is learned, however rare. A declaration is its primary subtag, in lower
case: en, en-US and en_GB are en; empty ones and UNKNOWN's name count as null. Models of more
than BLOCK languages are applied a block at a time, each to the written result of the one before,
so that neither driver nor worker holds more than a block; a row then holds a number a language.
Only rows with a declared language teach the text models; without any, everything is UNKNOWN.
Counts by task are summed as (language, slot) rows, so that no key gathers more than one row
a task. Host tables are joined after being written, so that Spark knows their size.

Defined results: null, empty and letterless texts are UNKNOWN with confidence from the other
evidence alone, and are rejected. A null declaration, suffix or host adds nothing. Ties go to
the alphabetically first language. Repeated rows are judged one by one; all columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staging, chunks, fresh, lean, text_buffer

SLOTS = 1 << 14
EVIDENCE = 60.0
#: Classes whose text models are in memory at once (SLOTS doubles each), and by task their counts.
BLOCK = 128
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text * SLOTS + slot, sorted and distinct; whether each text has a letter)."""
    n = len(offsets) - 1
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    lower[~_LETTER[data]] = 32
    doc = np.repeat(np.arange(n), np.diff(offsets))
    letters = np.bincount(doc[_LETTER[data]], minlength=n) > 0
    if len(data) < 3:
        return np.zeros(0, np.int64), letters
    code = lower[:-2].astype(np.int64) * 65536 + lower[1:-1].astype(np.int64) * 256 + lower[2:]
    keep = (doc[:-2] == doc[2:]) & ((lower[:-2] != 32) | (lower[1:-1] != 32)) & ((lower[1:-1] != 32) | (lower[2:] != 32))
    slot = ((code * 2654435761) >> 16) & (SLOTS - 1)
    return np.unique(doc[:-2][keep] * SLOTS + slot[keep]), letters


def count_trigrams(df: DataFrame, text: Column, declared: Column) -> DataFrame:
    """(language, slot, n): texts of each declared language that hold each trigram; slot -1 counts texts."""

    def emptied(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == SLOTS, -1, at), pa.int32()), pa.array(row[at], pa.int64())], names=["language", "slot", "n"])
        total.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            said = batch.column(1).to_pylist()
            for lo, hi in chunks(offsets):
                found, _ = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                doc, slot = found // SLOTS, found % SLOTS
                names = sorted(set(said[lo:hi]))
                place = {x: k for k, x in enumerate(names)}
                number = np.array([place[x] for x in said[lo:hi]])
                held, texts = number[doc], np.bincount(number, minlength=len(names))
                for first in range(0, len(names), BLOCK):
                    some = names[first : first + BLOCK]
                    if len(names) > BLOCK:
                        ours = (held >= first) & (held < first + BLOCK)
                        key = (held[ours] - first) * SLOTS + slot[ours]
                    else:
                        key = held * SLOTS + slot
                    table = np.bincount(key, minlength=len(some) * SLOTS).reshape(-1, SLOTS)
                    for name, row, n in zip(some, table, texts[first:]):
                        total[name] = total.get(name, 0) + np.append(row, n)
                    if len(total) > BLOCK:
                        yield from emptied(total)
        yield from emptied(total)

    some = df.select(text.cast("string"), declared.cast("string")).where(declared.isNotNull())
    return some.mapInArrow(lean(run), "language string, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n"))


def declaration(said: Column) -> Column:
    """The primary subtag of a declared language in lower case; null where there is none."""
    primary = F.lower(F.regexp_extract(said.cast("string"), r"^\s*([^\s_-]*)", 1))
    return F.when(~primary.isin("", UNKNOWN), primary)


def text_models(counts: DataFrame) -> tuple[list[str], Iterator[np.ndarray]]:
    """(classes, their log-probabilities by class and slot in blocks of BLOCK classes); every declared language is one."""
    names = sorted(r[0] for r in counts.where("slot = -1").select("language").collect())
    classes = [*names, UNKNOWN]

    def blocks() -> Iterator[np.ndarray]:
        for lo in range(0, len(classes), BLOCK):
            some = [x for x in classes[lo : lo + BLOCK] if x != UNKNOWN]
            logs = np.full((len(classes[lo : lo + BLOCK]), SLOTS), -np.log(SLOTS))
            if some:
                found = counts.where(F.col("language").isin(some) & (F.col("slot") >= 0)).select("language", "slot", "n").toArrow()  # at most BLOCK * SLOTS rows
                place = {x: k for k, x in enumerate(some)}
                n = np.zeros((len(some), SLOTS))
                n[[place[x] for x in found["language"].to_pylist()], found["slot"].to_numpy()] = found["n"].to_numpy()
                logs[: len(some)] = np.log((n + 0.1) / (n.sum(axis=1, keepdims=True) + 0.1 * SLOTS))
            yield logs

    return classes, blocks()


def text_likelihoods(df: DataFrame, text: str, logs: np.ndarray, name: str) -> DataFrame:
    """df with array<double> of log-likelihoods by class; null where the text has no letter."""
    at = df.columns.index(text)
    by_slot = np.ascontiguousarray(logs.T)
    rows = max(1, (1 << 20) // len(logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for first, last in chunks(offsets):
                for lo in range(first, last, rows):
                    hi = min(lo + rows, last)
                    found, letters = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    doc = found // SLOTS
                    n = np.bincount(doc, minlength=hi - lo)
                    scale = np.minimum(1.0, EVIDENCE / np.maximum(n, 1))
                    sums = np.stack([np.bincount(doc, by_slot[found % SLOTS, k], hi - lo) for k in range(len(logs))], axis=1) * scale[:, None]
                    starts = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(logs))
                    out = pa.ListArray.from_arrays(starts, pa.array(sums.ravel()), mask=pa.array(~letters))
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, out], names=[*batch.schema.names, name])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def parent_of(host: Column) -> Column:
    """The host without its first label, where that leaves at least two."""
    return F.regexp_replace(host, r"^[^.]+\.(?=[^.]+\.)", "")


def markup_language(html: Column) -> Column:
    """The primary subtag of the lang attribute of <html>, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """The text of a page without scripts, styles and tags, for trigrams."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")


def identify(spark: SparkSession, df: DataFrame, text: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, least: float = 0.5, pull: float = 20.0) -> DataFrame:
    """df with language, confidence and accepted (a known language with confidence >= least).

    `pull` is the number of rows' worth by which a host's prior is drawn to its parent's.
    """
    null = F.lit(None).cast("string")
    names_in = list(df.columns)
    lang, sure, ok = fresh(df, "language"), fresh(df, "confidence"), fresh(df, "accepted")
    own = {k: fresh(df, f"_lid_{k}") for k in ("text", "said", "suffix", "host", "ll", "total", *(f"{x}_{c}" for x in ("by", "log") for c in ("said", "suffix", "host")))}
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    work = df.withColumns({own["said"]: declaration(declared if declared is not None else null), own["suffix"]: suffix if suffix is not None else null, own["host"]: host if host is not None else null})
    staged = Staging(spark, "language")
    counts = staged.put("trigrams", count_trigrams(work, work[text], F.col(own["said"])))
    classes, models = text_models(counts)
    if len(classes) <= BLOCK:
        logs = next(models)
        scored = text_likelihoods(work, text, logs, own["ll"])
        slim = text_likelihoods(work.select(text, own["said"], own["suffix"], own["host"]), text, logs, own["ll"])
    else:
        more = fresh(work, "_lid_more")
        scored = work
        for k, logs in enumerate(models):
            part = text_likelihoods(scored, text, logs, more if k else own["ll"])
            if k:
                part = part.withColumn(own["ll"], F.concat(own["ll"], more)).drop(more)
            scored = staged.put(f"block{k}", part)
            if k:
                staged.drop(f"block{k - 1}")
        slim = scored

    # what rows classed by their text alone say about the other evidence
    best = F.array_position(F.col(own["ll"]), F.array_max(own["ll"])).cast("int") - 1
    tallies = staged.put("tallies", slim.where(F.col(own["ll"]).isNotNull()).groupBy(best.alias("k"), F.col(own["said"]).alias("said"), F.col(own["suffix"]).alias("suffix"), F.col(own["host"]).alias("host")).agg(F.count("*").alias("n")))
    overall = np.ones(len(classes))
    for r in tallies.groupBy("k").agg(F.sum("n").alias("n")).collect():
        overall[r["k"]] += r["n"]
    share = overall / overall.sum()
    share[-1] = min(share[-1], 1e-3)

    def numbers(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(x)) for x in values])

    def evidence(column: str) -> DataFrame:
        """(value, array of log P(value | class) by class), add-one smoothed."""
        seen = tallies.where(F.col(column).isNotNull()).groupBy(column, "k").agg(F.sum("n").alias("n"))
        by = seen.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
        smooth = F.transform(numbers(overall + 1.0), lambda n, k: F.log((F.coalesce(F.col("m")[k], F.lit(0)) + F.lit(0.5)) / n))
        return by.select(F.col(column).alias(own[f"by_{column}"]), smooth.alias(own[f"log_{column}"]))

    flat = numbers(share)

    def prior(own_counts: Column, total: Column, above: Column) -> Column:
        return F.transform(above, lambda x, k: (F.coalesce(own_counts[k], F.lit(0)) + F.lit(pull) * x) / (total + F.lit(pull)))

    def grouped(key: Column, name: str) -> DataFrame:
        seen = tallies.where(F.col("host").isNotNull()).groupBy(key.alias(name), "k").agg(F.sum("n").alias("n"))
        return seen.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias(f"_m_{name}"), F.sum("n").alias(f"_t_{name}"))

    parents = grouped(parent_of(F.col("host")), "parent").select("parent", prior(F.col("_m_parent"), F.col("_t_parent"), flat).alias("_above"))
    hosts = grouped(F.col("host"), "host").withColumn("parent", parent_of(F.col("host"))).join(parents, "parent", "left")
    hosts = hosts.select(F.col("host").alias(own["by_host"]), F.transform(prior(F.col("_m_host"), F.col("_t_host"), F.col("_above")), lambda x: F.log(x)).alias(own["log_host"]))
    fused = scored
    for column, side in (("said", evidence("said")), ("suffix", evidence("suffix")), ("host", hosts)):
        fused = fused.join(staged.put(column, side), F.col(own[column]) == F.col(own[f"by_{column}"]), "left")
    zero, base = numbers(np.zeros(len(classes))), numbers(np.log(share))
    total = F.coalesce(F.col(own["ll"]), zero)
    for other in (F.coalesce(F.col(own["log_said"]), zero), F.coalesce(F.col(own["log_suffix"]), zero), F.coalesce(F.col(own["log_host"]), base)):
        total = F.zip_with(total, other, lambda x, y: x + y)
    top = F.array_max(own["total"])
    fused = fused.withColumn(own["total"], total)
    at = F.array_position(F.col(own["total"]), top).cast("int")
    found = F.when(F.col(own["ll"]).isNull(), UNKNOWN).otherwise(F.element_at(F.array(*[F.lit(c) for c in classes]), at))
    chance = 1 / F.aggregate(F.transform(own["total"], lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)
    fused = fused.withColumns({lang: found, sure: chance})
    return fused.select(*names_in, lang, sure, ((F.col(lang) != UNKNOWN) & (F.col(sure) >= least)).alias(ok))


def identify_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents: `lang` is the declaration and `source` the host."""
    return identify(spark, docs, "text", F.col("lang"), F.col("source"))


def identify_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages: the lang attribute, the suffix and the host of the address, and the visible text."""
    name = fresh(pages, "visible")
    host = host_of(F.col("url"))
    out = identify(spark, pages.withColumn(name, visible_text(F.col("html"))), name, markup_language(F.col("html")), F.nullif(host, F.lit("")), suffix_of(host))
    return out.drop(name)
