"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout under one folder: ``part-NNNNN.bin`` holds the ids of a range of
documents in ascending doc_id order (uint16, or uint32 for vocabularies above
65,536), ``part-NNNNN.idx`` int64 offsets (one more than documents) and
``part-NNNNN.doc`` the int64 doc_ids.  Bases of the parts, that is the ids in
all earlier parts, come from prefix sums of the part totals, over buckets of
parts.

A task streams its documents into files of its own names and then renames them,
so it holds one batch at a time, and a repeated task leaves the same files.

Defined results: null text is an empty document (its end id alone); null
doc_id sorts first and reads back as null; repeated doc_ids keep one document
each, ordered by a hash of the text, and may lie in several parts; an empty
table has no parts; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, need, new_path
from .tokens import encoder

#: Bytes of text for one part; parts of a bucket of bases.
PART_BYTES, BUCKET_PARTS = 24 << 20, 4096
_NULL_ID = np.iinfo(np.int64).min
_MANIFEST = "part int, docs long, tokens long, width int"


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
    return fs, path.rstrip("/")


class _Files:
    """The three files of a part, under trial names until all are whole."""

    def __init__(self, folder: str, part: int):
        self.fs, self.top = _place(folder)
        self.names = [f"part-{part:05d}.{kind}" for kind in ("bin", "idx", "doc")]
        self.trials = [f"{self.top}/.{n}-{uuid.uuid4().hex}" for n in self.names]
        self.open = [self.fs.open_output_stream(t) for t in self.trials]

    def write(self, *arrays: np.ndarray) -> None:
        for out, a in zip(self.open, arrays):
            out.write(np.ascontiguousarray(a).tobytes())

    def done(self) -> None:
        for out, trial, name in zip(self.open, self.trials, self.names):
            out.close()
            self.fs.move(trial, f"{self.top}/{name}")


def _get(folder: str, name: str, kind: type) -> np.ndarray:
    """Memory-mapped where the folder is a file system's, read whole elsewhere."""
    fs, top = _place(folder)
    path = f"{top}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        import os

        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode every document, append end_id, write the parts into folder; one manifest row per part, with its base.

    Rows: part, docs, tokens, width (bytes an id), base (ids of all earlier parts).
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    size = docs.select(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // PART_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, e = TaskContext.get().partitionId(), encoder(tokenizer)
        files, n, total = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                files = _Files(folder, part)
                files.write(np.zeros(0, e.width), np.zeros(1, np.int64), np.zeros(0, np.int64))
            ids = [e.encode(text.as_py(), end_id) for text in b.column(1)]
            ends = total + np.cumsum([len(x) for x in ids], dtype=np.int64)
            files.write(np.concatenate(ids), ends, np.array(b.column(0).fill_null(_NULL_ID)))
            n, total = n + len(ids), int(ends[-1])
        if files is None:
            return
        files.done()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([n], pa.int64()), "tokens": pa.array([total], pa.int64()), "width": pa.array([e.width().itemsize], pa.int32())})

    order = ["doc_id", "_t"]  # the hash deals the texts of one doc_id to several parts
    ordered = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_t"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    manifest = f"{folder}/manifest"
    ordered.select("doc_id", "text").mapInArrow(lean(write), _MANIFEST).write.mode("overwrite").parquet(manifest)
    rows = spark.read.schema(_MANIFEST).parquet(manifest).withColumn("_bucket", F.expr(f"part div {BUCKET_PARTS}"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_bucket").agg(F.sum("tokens").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier(Window.orderBy("_bucket"))), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum("tokens").over(earlier(Window.partitionBy("_bucket").orderBy("part"))), F.lit(0))
    return rows.withColumn("_in", inside).join(sums, "_bucket").withColumn("base", F.col("_base") + F.col("_in")).drop("_bucket", "_base", "_in")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, width, base in zip(*(b.column(c).to_pylist() for c in ("part", "width", "base"))):
                ids = _get(folder, f"part-{part:05d}.bin", np.uint16 if width == 2 else np.uint32)
                offsets = _get(folder, f"part-{part:05d}.idx", np.int64)
                names = _get(folder, f"part-{part:05d}.doc", np.int64)
                crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64(), mask=names == _NULL_ID), "start": pa.array(offsets[:-1] + base), "n_tokens": pa.array(np.diff(offsets)), "ids_crc32": pa.array(crc, pa.int64())})

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as token files into the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer))
