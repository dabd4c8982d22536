"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

Documents are range-partitioned and sorted by id; each partition writes one shard as a sequence of
blocks.  A block holds the ids of whole documents back to back (16 or 32 bits each, by vocabulary)
and the documents' end offsets in Elias-Fano form: the low bits of every offset packed, the high
parts in unary in a bit vector, and the position of every 64th one as select samples.  With n documents
and u ids that is about 2 + log2(u/n) bits a document instead of 64.  Blocks are rows of a
Parquet table in a folder that all executors share, so Spark's commit makes writes safe to repeat.

Layout of a block: shard, block, in_shard (ids of the shard before it), n_ids, width (bytes an id),
low_bits, lower, upper, samples (binary), doc_ids, ids (binary).

Defined results: a null or empty text is its end id alone; null ids come first; equal ids are
ordered by a hash of their text and repeated rows stay; an empty table gives no blocks; other
columns are ignored; ids must cast to bigint; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakfree.llm.common import ship, shuffle_partitions, whole
from leakfree.llm.tokens import encoder, tokenizer_path

END_ID = 2
SAMPLE = 64
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 13
BLOCK = ("shard int, block int, in_shard bigint, n_ids bigint, width int, low_bits int, lower binary, "
         "upper binary, samples binary, doc_ids array<bigint>, ids binary")


class EliasFano:
    """A non-decreasing sequence of n numbers up to u."""

    def __init__(self, n: int, low_bits: int, lower: bytes, upper: bytes, samples: bytes):
        self.n, self.low_bits, self.lower, self.upper, self.samples = n, low_bits, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low)) & 1
        ones = (v >> low) + np.arange(n)
        unary = np.zeros(n + (top >> low) + 1, dtype=np.uint8)
        unary[ones] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(),
                   np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        word = int.from_bytes(self.lower[first // 8:(last + 7) // 8], "little")
        return word >> first % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th number: the place of the i-th one, from the sample before it on, and its low bits."""
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        todo, byte = i % SAMPLE, at // 8
        word = self.upper[byte] >> at % 8 << at % 8
        while todo >= word.bit_count():
            todo -= word.bit_count()
            byte += 1
            word = self.upper[byte]
        for _ in range(todo):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return place - i << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every number, in order (a select of all)."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))[:self.n]
        high = (ones - np.arange(self.n)) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.lower, np.uint8), bitorder="little")[:self.n * self.low_bits]
        return high | bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
          text: str = "text", doc_id: str = "doc_id", block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts and write the files in ascending id order."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = tokenizer or tokenizer_path()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    n = shuffle_partitions(spark)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.withColumn("shard", F.spark_partition_id())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        kind, number, before, shard = f"<u{width}", 0, 0, None
        keys: list = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []

        def block() -> pa.RecordBatch:
            ends = EliasFano.of(np.cumsum(lengths))
            row = [shard, number, before, sum(lengths), width, ends.low_bits, ends.lower, ends.upper, ends.samples,
                   list(keys), b"".join(x.astype(kind).tobytes() for x in parts)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(),
                     pa.binary(), pa.list_(pa.int64()), pa.binary()]
            names = [x.split()[0] for x in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for key, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    shard = part.column(2)[0].as_py()
                    keys.append(key)
                    parts.append(np.append(ids, np.uint32(end_id)))
                    lengths.append(len(ids) + 1)
                    held += len(ids) + 1
                    if held >= block_ids or len(keys) >= BLOCK_DOCS:
                        yield block()
                        number, before, held = number + 1, before + held, 0
                        keys, parts, lengths = [], [], []
        if keys:
            yield block()

    ordered.mapInArrow(blocks, BLOCK).write.parquet(path)


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``base``, the number of ids in the files before them.  Shards are as many as
    the partitions that wrote them, so their totals are a small table whatever the input."""
    files = spark.read.schema(BLOCK).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_base"))
    joined = files.join(F.broadcast(bases), F.col("shard") == F.col("_shard"))
    return joined.withColumn("base", F.col("_base") + F.col("in_shard")).drop("_shard", "_base")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32; its offsets come from the select structures."""
    ship(spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                coded = EliasFano(len(b["doc_ids"]), b["low_bits"], b["lower"], b["upper"], b["samples"])
                ends = np.fromiter(map(coded.select, range(coded.n)), np.int64, coded.n)
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(b["ids"], f"<u{b['width']}")
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(starts + b["base"], pa.int64()),
                     pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_starts(spark, path).mapInArrow(documents, READ)


def slice_of(block: dict, i: int) -> np.ndarray:
    """The ids of the i-th document of a block, found by two selects."""
    ends = EliasFano(len(block["doc_ids"]), block["low_bits"], block["lower"], block["upper"], block["samples"])
    start = ends.select(i - 1) if i else 0
    return np.frombuffer(block["ids"], f"<u{block['width']}")[start:ends.select(i)]
