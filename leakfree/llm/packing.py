"""Best-fit packing of documents into sequences of a fixed number of tokens.

Pieces are dealt evenly over packers (a partition each) and arrive longest first; each packs its stream online with a bounded number
of open bins.  A packer gets LEAST_FULL sequences' worth of tokens at least, since each may leave a sequence or two part
full: the packing doesn't depend on the session's number of partitions unless there is enough for all of them.  Open bins are kept by free space, and one integer's bit f says whether a bin with f
free tokens is open: the lowest set bit at or above a piece's length is its best fit.  If no bin
fits, a new one opens; beyond ``open_bins`` the fullest closes first.  Memory is one bitset and
``open_bins`` bins per task, whatever the input.

Defined results: a null or empty text is its end id alone (one token); repeated rows and repeated
ids are packed each; null ids are kept; an empty table gives no pieces; only documents longer than
a sequence are cut; other columns are ignored; ids must cast to bigint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakfree.llm.common import ship, shuffle_partitions, written
from leakfree.llm.tokens import encoder, tokenizer_path

SEQUENCE = 2048
OPEN_BINS = 1024
END_ID = 0
#: Sequences' worth of tokens per packer, at least.
LEAST_FULL = 256
SLICE = 1024
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class OpenBins:
    """Bounded-space best fit: ``place(length)`` returns (bin number, offset in it)."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
        self.bits, self.count, self.made = 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.size, self.made
            self.made += 1
        left = space - length
        if left:
            if self.count >= self.limit:
                low = (self.bits & -self.bits).bit_length() - 1
                if low >= left:  # the bin in hand is the fullest
                    return number, self.size - space
                self._take(low)
            self.free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.size - space


def pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID,
           text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokenized documents cut into pieces of at most ``size`` tokens (ids are not kept)."""
    ship(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out: list[tuple] = []
                for key, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    out += [(key, i, s, min(size, len(ids) - s), zlib.crc32(ids[s:s + size].tobytes()))
                            for i, s in enumerate(range(0, len(ids), size))]
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, PIECES)


def pack(parts: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start and length."""
    ship(parts.sparkSession)
    parts = written(parts, "pieces")  # counted before they are dealt
    full = (parts.agg(F.sum("length")).first()[0] or 0) // (size * LEAST_FULL)
    n = max(1, min(shuffle_partitions(parts.sparkSession), full))
    dealt = parts.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(
        F.col("length").desc(), "doc_id", "piece", "ids_crc32")
    dealt = dealt.withColumn("part", F.spark_partition_id().cast("bigint"))
    names = dealt.columns

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, open_bins)
        for batch in batches:
            put = [bins.place(x) for x in batch.column("length").to_pylist()]
            number = np.array([b for b, _ in put], dtype=np.int64)
            first = np.asarray(batch.column("part")).astype(np.int64) << 40
            columns = [batch.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first + number), pa.array([o for _, o in put], pa.int64())],
                names=[*names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    return dealt.mapInArrow(fill, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS,
                   tokenizer: str | None = None, end_id: int = END_ID, text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    return pack(pieces(docs, size, tokenizer, end_id, text, doc_id), size, open_bins)
