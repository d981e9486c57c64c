"""Shared pieces: the shared folder, staged tables, vectorised word hashing.

Words are maximal runs of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``), which is also what ``bytes.split()`` yields.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._stage import checkpoint_dir

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random value for each place in a word and byte there (tabulation hashing); white space adds nothing.  Longer words are hashed by blake2b.
_PLACES = 48
_VALUES = np.random.default_rng(20240611).integers(0, (1 << 64) - 1, (_PLACES, 256), dtype=np.uint64)
_VALUES[:, _SPACE] = 0
_VALUES = _VALUES.ravel()

#: Bytes of text that one vectorised step handles at once; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's; a folder of our own only where all runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = checkpoint_dir(spark)
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/huegrid/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    for x in _scratch:
        x.paths.append(path)
    return path


class scratch:
    """Within it, keep() removes all staged tables made since but the given one, whose source has been written out."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "scratch":
        _scratch.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scratch.remove(self)

    def keep(self, table: DataFrame) -> None:
        for p in self.paths:
            if not table._staged_at.startswith(p):
                remove(self.spark, p)
        self.paths = [p for p in self.paths if table._staged_at.startswith(p)]


_scratch: list[scratch] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{new_path(spark, name)}/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._staged_at)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of one Arrow batch where texts go through Python; Spark's own limit is 64 MB, of which a task holds several copies.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless they are smaller.  Queries and stages call this; operators leave the session alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(now[-1:])
    if not 0 < (int(now[:-1]) << unit if unit else int(now)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """run over a task's batches, giving free memory back to the system at the end, since Python workers outlive their tasks."""

    def ran(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return ran


def need(df: DataFrame, *columns: str) -> None:
    """Check an operator's input."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def packed(columns: list[str]) -> Column:
    """The columns as one struct, which has a field even if there are none."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("_"))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 arrays."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The words of some texts: byte bounds, 64-bit hashes and the index of the text each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        """data: UTF-8 bytes of all texts; offsets: n + 1 bounds of the texts, from 0. lower: fold A-Z first."""
        n = len(data)
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begin[inner] = word[inner]
        end = np.zeros(n + 1, bool)
        end[n] = n > 0 and word[-1]
        end[1:n] = word[:-1] & ~word[1:]
        end[inner] |= word[inner - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end)
        self.first = np.searchsorted(self.starts, offsets)  # words of text i: first[i]..first[i + 1]
        self.counts = np.diff(self.first)
        self.hashes = self._hashed(_LOWER[data] if lower else data) if hashes and len(self.starts) else np.zeros(0, np.uint64)

    def _hashed(self, data: np.ndarray) -> np.ndarray:
        at = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        at[self.starts[0] :] -= np.repeat(self.starts.astype(at.dtype), np.diff(self.starts, append=len(data)))
        at[: self.starts[0]] = 0
        np.minimum(at, _PLACES - 1, out=at)
        at <<= 8
        at |= data
        out = np.add.reduceat(_VALUES[at], self.starts)
        for k in np.flatnonzero(self.ends - self.starts > _PLACES).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[self.starts[k] : self.ends[k]].tobytes(), digest_size=8).digest(), "little")
        return mix(out)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES):
    """Yield (from, to, bytes, offsets) over runs of texts of about max_bytes; null texts are empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, 0x51ED270B7A4F, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + size]) * _U(0xFF51AFD7ED558CCD)
        out ^= out >> _U(29)
    return mix(out)
