"""What the operators share: staged tables, raw text buffers and 64-bit hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once by one Python worker, in bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: Arrow batches to and from Python workers, in bytes.
BATCH = "8m"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# -- staged tables -----------------------------------------------------------


#: Removes the shuffle files of a finished write; the written table takes their place.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder if all runs on this machine, else an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own_folder()
    return named.rstrip("/")


@lru_cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='quernstone-')}"


def bounded(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches of whole texts small, as worker memory grows with them."""
    spark.conf.set(BATCH_BYTES, BATCH)
    return spark


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system at its end: workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


class Staging:
    """Tables written to the shared folder, to cut lineage and to survive lost executors.

    Lazy results read some of them, so what is not dropped goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = bounded(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, slim: bool = False) -> DataFrame:
        """Writes df and returns the written table; the shuffle files of the write go with its end.

        slim: many small rows go to Python, so batches are bounded by their rows alone; weighing
        every row costs more than moving it.
        """
        wanted = {CLEANUP: "true"} | ({BATCH_BYTES: str((1 << 31) - 1)} if slim else {})
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        root, files = self._at()
        files.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that no plan reads any more."""
        for name in names:
            path, files = self._at(f"/{name}")
            files.delete(path, True)

    def _at(self, name: str = "") -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# -- raw text ----------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about `limit` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


# -- hashing -----------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Rolling:
    """Polynomial hashes of any byte range, by differences of one prefix sum modulo 2**64.

    The sum of value(byte i) * base**i over a range, divided by base**start: equal byte
    ranges have equal hashes wherever they stand. Powers are kept for the longest text so far.
    """

    def __init__(self, seed: int, fold: np.ndarray | None = None):
        self.values = stream(seed, 256)
        if fold is not None:
            self.values = self.values[fold]
        self.base = int(stream(seed + 1, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, U64)
        while len(out) < n:
            out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
        return out[:n].copy()

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            self.up, self.down = self._powers(self.base, n + 1), self._powers(self.inverse, n + 1)
        out = np.zeros(n + 1, U64)
        np.cumsum(self.values[data] * self.up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end); lengths enter, so that ranges of other lengths differ."""
        raw = (prefix[end] - prefix[start]) * self.down[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Folds A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word contract: the space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of other than white space; none crosses documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
