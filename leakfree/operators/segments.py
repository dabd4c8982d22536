"""Order-dependent folds over long keys: segments as functions that compose.

Some rules carry a state from row to row that no running sum can express (a clock that restarts, a best
score whose direction changes).  What a stretch of rows does to the state that enters it is a
function, and functions of consecutive stretches compose.  So:

* :func:`fold` range-partitions the rows by (key, order), the only shuffle of the rows.  A partition holds
  whole stretches of keys, a hot key spans many partitions.  Each task reduces its stretches, at most
  ``chunk`` rows at a time, to one function each.
* Functions of a key are composed in order, FAN at a time, until one is left (log rounds over a table that
  shrinks by FAN each time).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from leakfree.session import materialize

FAN = 64


def fold(df: DataFrame, key: str, order: list[str], reduce_rows: Callable[[pa.Table], dict], compose: Callable[[list[dict]], dict],
         state: str, chunk: int = 100_000, partitions: int | None = None) -> DataFrame:
    """One row per key: ``key`` and the columns of ``state`` (DDL), the composition of its rows in order.

    ``reduce_rows`` takes rows of one key in order (``df``'s columns) and ``compose`` a list of
    states in order; both return a state."""
    spark = df.sparkSession
    fields = T._parse_datatype_string(state).fields
    keyed = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("_at", T.LongType()), *fields])
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, arrow = [f.name for f in keyed.fields], to_arrow_schema(keyed)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each stretch of one key's rows (at most ``chunk``, in order) as its function."""
        at, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def state_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            out = {key: held[0].column(key)[0].as_py(), "_at": at, **reduce_rows(pa.Table.from_batches(held))}
            return pa.RecordBatch.from_pylist([{n: out[n] for n in names}], schema=arrow)

        last = None
        for batch in batches:
            keys = batch.column(key).to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for first, end in pairwise(edges):
                if held and (keys[first] != last or rows >= chunk):
                    yield state_of(held)
                    at, held, rows = at + 1, [], 0
                last = keys[first]
                for i in range(first, end, chunk):
                    if held and rows + min(chunk, end - i) > chunk:
                        yield state_of(held)
                        at, held, rows = at + 1, [], 0
                    held.append(batch.slice(i, min(chunk, end - i)))
                    rows += min(chunk, end - i)
        if held:
            yield state_of(held)

    ranged = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    states = materialize(ranged.mapInArrow(stretches, keyed), reliable=True)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["parts"][0]
                done = compose(row["parts"]) if len(row["parts"]) > 1 else first
                out = {key: row[key], "_at": first["_at"], **{f.name: done[f.name] for f in fields}}
                yield pa.RecordBatch.from_pylist([{n: out[n] for n in names}], schema=arrow)

    most = states.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while most > 1:
        place = F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1
        grouped = states.withColumn("_g", F.floor(place / FAN)).groupBy(key, "_g").agg(
            F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("parts")).drop("_g")
        states = materialize(grouped.mapInArrow(together, keyed), reliable=True)
        most = -(-most // FAN)
    return states.drop("_at")

