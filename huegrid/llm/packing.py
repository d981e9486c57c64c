"""Best-fit packing of documents into fixed-length sequences.

Bounded-space online best-fit: a packer holds a fixed number of open bins,
indexed by free space in a bitset (bit f is set while some open bin has f
free).  A piece goes to the open bin with the least free space that holds it;
when there are too many open bins, the fullest closes first.

Documents are encoded where they are read, cut into pieces of at most the
capacity, and only the pieces' lengths move.  Each packing task takes about
PIECES_PER_TASK pieces, dealt by hash and in an order fixed by that hash, but
for runs of RUN pieces, within which the longest come first: small pieces then
fill what large ones leave.

Defined results: null or empty text is one piece with the end id alone; null
doc_ids are packed like others; repeated doc_ids are separate documents; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need, staged
from .tokens import encoder

CAPACITY, OPEN_BINS, PIECES_PER_TASK, RUN = 2048, 1024, 100_000, 2500
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = _PIECES + ", sequence_id long, offset long"


class BestFit:
    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # the bitset
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def add(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece, and the place in it."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            found = self.bins[room].pop()
            if not self.bins[room]:
                self.free &= ~(1 << room)
        else:
            room, found = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = room - length
        if left:
            self.bins[left].append(found)
            self.free |= 1 << left
        else:
            self.open -= 1
        if self.open > self.most:  # the fullest closes first
            least = (self.free & -self.free).bit_length() - 1
            self.bins[least].pop()
            if not self.bins[least]:
                self.free &= ~(1 << least)
            self.open -= 1
        return found, self.capacity - room


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    need(docs, "doc_id", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = e.encode(text.as_py(), end_id).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    rows.append((doc, k, a, len(part), zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(pieces), _PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces, which are read more than once: give a staged table."""
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fit, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        def placed(run: pa.Table) -> Iterator[pa.RecordBatch]:
            lengths = run.column("length").to_numpy()
            where = np.zeros((len(lengths), 2), np.int64)
            for k in np.argsort(-lengths, kind="stable").tolist():
                where[k] = fit.add(int(lengths[k]))
            run = run.append_column("sequence_id", pa.array(where[:, 0] + first))
            yield from run.append_column("offset", pa.array(np.ascontiguousarray(where[:, 1]))).to_batches()

        held, n = [], 0
        for b in batches:
            b = b.select([c for c in b.schema.names if c != "_h"])
            while b.num_rows:
                part, b = b.slice(0, RUN - n), b.slice(RUN - n)
                held.append(part)
                n += part.num_rows
                if n == RUN:
                    yield from placed(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield from placed(pa.Table.from_batches(held))

    dealt = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")).repartition(tasks, "_h")
    return dealt.sortWithinPartitions("_h", "doc_id", "piece").mapInArrow(lean(run), PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, open_bins: int = OPEN_BINS) -> DataFrame:
    return pack(staged(cut(docs, tokenizer, capacity, end_id), "pieces"), capacity, open_bins)
