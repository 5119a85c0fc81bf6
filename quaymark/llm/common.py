"""Helpers shared by the training-data operators: tables, shared storage and byte-level Arrow access."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds a worker's memory whatever the batch.
CHUNK_BYTES = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets local Python workers import this package wherever the driver was started from, and hands them texts in
    batches of fewer rows than the default, if that is what the session has."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), _ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quaymark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and continues from there, so lost executors cost no lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: like ``cut``, but compressed and read by columns."""
    home = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(home)
    return df.sparkSession.read.schema(df.schema).parquet(home)


def settled(df: DataFrame) -> DataFrame:
    """``written``, after which the driver looks for shuffles that nothing refers to any more, so that executors delete them."""
    out = written(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores until no column of ``taken`` is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its len+1 offsets into them; null reads as empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about ``limit`` text bytes; a longer text has a slice of its own and is never cut."""
    for batch in batches:
        _, off = text_view(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # idle workers keep nothing
    if _trim is not None:
        _trim(0)


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z to a-z, all else as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_pow: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _pow.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
        if size > CHUNK_BYTES + 1:
            return have
        _pow[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of one buffer, from prefix sums of its symbols' values; equal spans have equal hashes everywhere."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTE):
        n = len(data)
        self._pinv = _powers("pinv", _PINV, n + 1)
        with np.errstate(over="ignore"):
            self._sum = np.zeros(n + 1, np.uint64)
            own = values[data]
            own *= _powers("p", _P, n + 1)[:n]
            np.cumsum(own, out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sum[end] - self._sum[start]) * self._pinv[start])

    def each(self, k: int) -> np.ndarray:
        """Those of the spans of k symbols that start at 0, 1 and so on."""
        return mix(self.raw(k))

    def raw(self, k: int) -> np.ndarray:
        """``each`` before the finaliser."""
        n = max(0, len(self._sum) - k)
        with np.errstate(over="ignore"):
            out = self._sum[k:] - self._sum[:n]
            out *= self._pinv[:n]
        return out


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of each maximal run of word bytes; runs end at document ends."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = is_word[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (~before | first[:n]))
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def token_hashes(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_spans with a hash of each."""
    start, end, doc = word_spans(data, off, is_word)
    return start, end, doc, SpanHash(data)(start, end) if len(start) else np.zeros(0, np.uint64)
