"""Benchmark decontamination: prefix-filtered set join of item windows with whole documents.

An item's windows are its runs of WINDOW consecutive words (an item of fewer words is one window).
A window is the set of its word shingles (three words; all of a shorter window), and a document
contains it only if it has every one of them.  So one shingle of the window, its prefix, is enough
to find all documents that can: the join takes the rarest, by its count over all documents.

1. Item windows, each text once, with their shingles as 64-bit keys; a bitmap of the keys, of
   bounded size (two probes a key), goes to the tasks.
2. One pass over the documents counts the shingles that the bitmap lets through.
3. The rarest shingle of each window is its prefix; a bitmap of the prefixes goes to the tasks.
4. The second pass writes, per document, its number of words and the places of prefixes with
   the words around them: all that the join needs.
5. Places join windows by key.  Place and offset give the start (``start >= 0`` and
   ``start + length <= n_words``), and the words there must equal the window's, so neither the
   bitmap nor the keys can let a wrong match through, and neither loses one.

The bitmaps bound what is broadcast whatever the benchmark's size; a benchmark beyond their range
lets more false places through, which the join drops.  Windows join by broadcast below
BROADCAST_BYTES (counted), otherwise by a shuffle with adaptive skew handling.

Defined results: a null or empty text has no words and no hits; null ids are kept; one row per row
of ``docs``, repeated rows and ids included; items without an id mark words but aren't listed, rows
of one item id belong together; an empty table of documents gives no rows and an empty benchmark no
hits; other columns of the inputs are ignored or carried, whatever their names (one called
``decontamination`` gives way to the result); texts are scanned
whole, whatever their length, one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakfree.llm.common import packed, ship, unpacked, written

WINDOW, SHINGLE = 10, 3
#: The bitmap's bits a key and its most bits (16 MB); windows to broadcast.
BITS_PER_KEY, MOST_BITS = 64, 1 << 27
BROADCAST_BYTES = 8 << 20

#: Fixed rule: words are runs of ASCII letters and digits and of all bytes from 0x80 on, A-Z as a-z.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def _shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of all runs of k words, by their first word's place."""
    n = max(len(codes) - k + 1, 0)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ codes[i:i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window of each item: its text (words joined by a space), length, shingles by
    place, and ``item_id``."""
    fields = "item_id string, body string, length int, shingles array<bigint>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.string()), ("body", pa.binary()), ("length", pa.int32()),
                            ("shingles", pa.list_(pa.int64()))])
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(batch.column("item_id").to_pylist(), _binary(batch, "text")):
                words = words_of(text)
                if not words:
                    continue
                size = min(window, len(words))
                k = min(SHINGLE, size)
                keys = _shingles(_codes(words), k).view(np.int64).tolist()
                for i in range(len(words) - size + 1):
                    for column, value in zip(out, (item, b" ".join(words[i:i + size]), size, keys[i:i + size - k + 1])):
                        column.append(value)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            yield made.set_column(1, "body", made.column(1).cast(pa.string()))

    ship(items.sparkSession)
    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, fields)


class Probe:
    """A bitmap of 64-bit keys with two probes each, of bounded size."""

    def __init__(self, keys: DataFrame):
        """``keys`` has one bigint column ``h``; bits are set in Spark, at most MOST_BITS / 64 rows come back."""
        bits = 1 << 12
        while bits < min(BITS_PER_KEY * keys.count(), MOST_BITS):
            bits *= 2
        self.mask = bits - 1
        places = keys.select(F.explode(F.array(
            F.col("h").bitwiseAND(F.lit(self.mask).cast("bigint")),
            F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(self.mask).cast("bigint")))).alias("at"))
        held = places.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
        words = np.zeros(bits // 64, "<i8")
        words[held.column("word").to_numpy()] = held.column("set").to_numpy()
        self.bytes = words.view(np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of keys that may be held."""
        mask = np.uint64(self.mask)
        at = (h & mask).astype(np.int64)
        some = np.flatnonzero(self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        at = (h[some] >> np.uint64(32) & mask).astype(np.int64)
        return some[(self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1]


def _counts(docs: DataFrame, probe: Probe, widths: list[int]) -> DataFrame:
    """(h, n): how often each shingle that the bitmap lets through occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(probe)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for text in _binary(batch, "text"):
                codes = _codes(words_of(text))
                for k in widths:
                    h = _shingles(codes, k)
                    found.append(h[sent.value.find(h)])
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


_PLACES = "array<struct<h:bigint,at:bigint,first:bigint,near:array<string>>>"


def _places(docs: DataFrame, probe: Probe, widths: list[int], window: int) -> DataFrame:
    """``docs`` (``_row``, ``text``) as ``row`` (a number per row), ``_row``, ``n_words`` and the places of prefixes."""
    sent = docs.sparkSession.sparkContext.broadcast(probe)
    row_type = docs.schema["_row"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("_row", row_type), T.StructField("n_words", T.LongType()),
                           T.StructField("places", T._parse_datatype_string(_PLACES))])
    near = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("near", pa.list_(pa.string()))]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, places = [], []
            for text in _binary(batch, "text"):
                words = words_of(text)
                codes, here = _codes(words), []
                for k in widths:
                    h = _shingles(codes, k)
                    for at in sent.value.find(h).tolist():
                        first = max(0, at - window + 1)
                        here.append({"h": int(h[at].view(np.int64)), "at": at, "first": first,
                                     "near": [w.decode() for w in words[first:at + window]]})
                sizes.append(len(words))
                places.append(here)
            rows = pa.array(range(row, row + len(sizes)), pa.int64())
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([rows, batch.column("_row"), pa.array(sizes, pa.int64()), pa.array(places, near)],
                                             ["row", "_row", "n_words", "places"])

    return docs.mapInArrow(find, schema)


def _small(df: DataFrame, held: int) -> DataFrame:
    """A table of ``held`` bytes of text: to every task if that is little."""
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def scan(docs: DataFrame, items: DataFrame, carry: list[str], window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` (with ``text``) against ``items`` (``item_id``, ``text``).

    Returns the documents (``row``, a struct ``_row`` of the columns to carry, ``n_words``), the hits
    (``row``, ``start``, ``length``, ``body``: words from ``start`` on equal a window's) and the
    windows' items (``body``, ``item_id``)."""
    spark = docs.sparkSession
    cut = written(windows(items, window), "item-windows")
    distinct = written(cut.groupBy("body").agg(F.first("length").alias("length"), F.first("shingles").alias("shingles")), "windows")
    widths = sorted(r[0] for r in distinct.select(F.least("length", F.lit(SHINGLE))).distinct().collect())
    held = distinct.agg(F.sum(F.length("body") + 40)).first()[0] or 0
    ship(spark)
    shingles = distinct.select("body", "length", F.posexplode("shingles").alias("offset", "h"))
    counts = _counts(docs, Probe(shingles.select("h").distinct()), widths)
    prefix = written(
        shingles.join(counts, "h", "left").groupBy("body", "length")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("least"))
        .select("body", "length", "least.h", "least.offset"), "window-prefixes")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), "text")
    found = written(_places(whole, Probe(prefix.select("h").distinct()), widths, window), "prefix-places")
    start = F.col("at") - F.col("offset")
    hits = (
        found.where(F.size("places") > 0).select("row", "n_words", F.inline("places"))
        .join(_small(prefix, held), "h").withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .where(F.array_join(F.slice("near", F.greatest(F.lit(1), F.col("start") - F.col("first") + 1).cast("int"), F.col("length")), " ")
               == F.col("body"))
        .select("row", "start", "length", "body"))
    members = cut.where(F.col("item_id").isNotNull()).select("body", "item_id").distinct()
    return found.select("row", "_row", "n_words"), written(hits, "window-hits"), _small(members, held + 8 * window)


def report(docs: DataFrame, items: DataFrame, carry: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: the columns of ``carry`` (default: all), and ``decontamination``,
    a struct of ``n_words``, ``n_hit`` (words inside hits), ``items`` (ids of items with hits, sorted)
    and ``spans`` (hit spans, merged: first word and the word after the last)."""
    columns = [c for c in (docs.columns if carry is None else carry) if c != "decontamination"]
    found, hits, members = scan(docs, items, columns, window)
    order = Window.partitionBy("row").orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = hits.select("row", "start", (F.col("start") + F.col("length")).alias("end"), reach.alias("reach"))
    apart = apart.withColumn("span", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(
        Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = apart.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = (hits.select("row", "body").distinct().join(members, "body").groupBy("row")
             .agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    told = found.join(spans, "row", "left").join(named, "row", "left")
    return told.select(*[F.col("_row").getField(c).alias(c) for c in columns], F.struct(
        "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans")).alias("decontamination"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns."""
    row = packed(docs).select("_row", F.col("_row.text").alias("text"))
    told = report(row, items, ["_row"], window)
    return unpacked(told.where(F.col("decontamination.n_hit") == 0), docs.columns)
