"""Keyed folds of a stream whose rows may arrive late, without losing any.

A fold in ``seq`` order (a budget, a gate) can't simply skip a row that arrives after one with a larger
``seq``: the row changes every result after its place.  :class:`LateFold` is a ``foreachBatch`` sink
that keeps two tables in the shared folder, one folder per micro-batch:

* ``rows``: the rows taken so far (one per key and ``seq``; a replay is told by its ``seq``), marked if
  they came behind their key's last ``seq``,
* ``states``: a snapshot of each key's fold after the batch, with the last ``seq`` in it.

Keys without late rows go on from their snapshot with the new rows only.  A key with late rows goes back to
the latest snapshot that ends before the first of them and wasn't itself made void by an
earlier late row, and folds its stored rows again from there; its results from that place on are written
anew and replace the earlier ones.  The folds are batch operators with a carry, so one hot key
is split over tasks as in batch.

``retain``: rows that lie more than so many ``seq`` behind their key's last one are not folded but
counted in ``expired`` (None: every row is folded).

Reads inside a batch look at earlier batches only and every write replaces its own folder, so a
micro-batch that is run again after a failure gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakfree.session import materialize
from leakfree.streaming.runner import scratch

BATCH = "_lf_batch"
SEQ = "seq"

#: advance(rows, carry, n) -> (state, output or None): fold the ``n`` ``rows`` of all keys, each from its row in ``carry`` (keys without
#: one start afresh).  The state holds ``last_seq``, the largest ``seq`` folded.
Advance = Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame | None]]
LATE, LAST = "_lf_late", "last_seq"


class LateFold:
    def __init__(self, spark: SparkSession, path: str, rows: T.StructType, state: T.StructType, output: T.StructType | None,
                 advance: Advance, keys: list[str], retain: int | None = None):
        """``state`` and ``output`` are the schemas that ``advance`` returns, keys included."""
        self.spark, self.path, self.advance, self.keys, self.retain = spark, path.rstrip("/"), advance, keys, retain
        self.schemas = {"rows": T.StructType([*rows.fields, T.StructField(LATE, T.BooleanType())]), "states": state,
                        "expired": T.StructType([f for f in rows.fields if f.name in [*keys, SEQ]]), "output": output}

    # ------------------------------------------------------------------ tables
    def _put(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        folder, schema = f"{self.path}/{name}/{BATCH}={batch_id}", self.schemas[name]
        df.select(*schema.fieldNames()).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(schema).parquet(folder).withColumn(BATCH, F.lit(batch_id).cast("long"))

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """All batches (or those before one) of a table."""
        schema = T.StructType([*self.schemas[name].fields, T.StructField(BATCH, T.LongType())])
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if before == 0 or not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return df if before is None else df.where(F.col(BATCH) < before)

    def _same(self, a: str, b: str):
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.keys])

    def _latest(self, df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc(BATCH))
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    # ------------------------------------------------------------------ one micro-batch
    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c not in self.keys and c != SEQ]
        # rows of one key and seq are the same record; if they differ, the least one counts
        once = batch.groupBy(*self.keys, SEQ).agg(F.min(F.struct(*others)).alias("_r")).select(*self.keys, SEQ, "_r.*")
        snapshots = self.table("states", batch_id)
        news = self._put(self._new(once, snapshots, batch_id) if batch_id else once.withColumn(LATE, F.lit(False)), "rows", batch_id)
        late = news.where(LATE)
        if batch_id == 0:
            carry, todo = snapshots, news
        elif late.isEmpty():
            touched = news.select(*self.keys).distinct()
            carry, todo = self._latest(snapshots.alias("s").join(touched.alias("t"), self._same("s", "t"), "left_semi"), self.keys), news
        else:
            carry, todo = self._resumed(news, snapshots, batch_id)
        state, output = self.advance(todo.drop(BATCH, LATE), carry.drop(BATCH, LAST), todo.count())
        self._put(state, "states", batch_id)
        if output is not None:
            self._put(output, "output", batch_id)

    def _new(self, once: DataFrame, snapshots: DataFrame, batch_id: int) -> DataFrame:
        """The batch's rows that haven't been taken, those behind their key's last ``seq`` marked."""
        heads = snapshots.groupBy(*self.keys).agg(F.max(LAST).alias("_last"))
        placed = once.alias("n").join(heads.alias("h"), self._same("n", "h"), "left").select(
            "n.*", "h._last", F.coalesce(F.col(SEQ) <= F.col("h._last"), F.lit(False)).alias(LATE))
        if self.retain is not None:
            old = F.coalesce(F.col(SEQ) < F.col("_last") - self.retain, F.lit(False))
            self._put(placed.where(old), "expired", batch_id)
            placed = placed.where(~old)
        known = self.table("rows", batch_id).select(*[F.col(k).alias(k) for k in self.keys], SEQ)
        fresh = placed.where(LATE).alias("n").join(known.alias("k"), self._same("n", "k") & (F.col(f"n.{SEQ}") == F.col(f"k.{SEQ}")), "left_anti")
        return placed.where(~F.col(LATE)).unionByName(fresh)

    def _resumed(self, news: DataFrame, snapshots: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Each key's snapshot to go on from, and the rows to fold from there."""
        known = self.table("rows", batch_id).unionByName(news)
        lates = known.where(LATE).groupBy(*self.keys, BATCH).agg(F.min(SEQ).alias("_first"))
        late = lates.where(F.col(BATCH) == batch_id)
        touched = news.select(*self.keys).distinct()
        mine = snapshots.alias("s").join(touched.alias("t"), self._same("s", "t"), "left_semi")
        # a snapshot is void if a later batch brought a row at or before its last seq
        valid = mine.alias("s").join(lates.alias("l"), self._same("s", "l") & (F.col(f"l.{BATCH}") > F.col(f"s.{BATCH}"))
                                     & (F.col("l._first") <= F.col(f"s.{LAST}")), "left_anti")
        w = Window.partitionBy(*self.keys).orderBy(F.desc(LAST), F.desc(BATCH))
        carry = valid.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        again = known.alias("n").join(late.alias("l"), self._same("n", "l"), "left_semi")
        again = again.alias("n").join(carry.alias("c"), self._same("n", "c"), "left").where(
            F.coalesce(F.col(f"n.{SEQ}") > F.col(f"c.{LAST}"), F.lit(True))).select("n.*")
        onward = news.alias("n").join(late.alias("l"), self._same("n", "l"), "left_anti")
        # written: the fold reads them several times
        return carry, materialize(onward.unionByName(again), reliable=True)

    # ------------------------------------------------------------------ results
    def states(self) -> DataFrame:
        """Each key's state after the last batch that touched it."""
        return self._latest(self.table("states"), self.keys).drop(BATCH, LAST)

    def output(self, by: list[str]) -> DataFrame:
        """The output rows, the latest per ``by``."""
        return self._latest(self.table("output"), by).drop(BATCH)

    def expired(self) -> DataFrame:
        """How many rows per key came beyond the retention."""
        return self.table("expired").groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_expired"))


def drain(sdf: DataFrame, name: str, fold: Callable[[SparkSession, str], LateFold]) -> LateFold:
    """Run a stream's available rows through a late fold under the shared checkpoint folder."""
    out = scratch(sdf.sparkSession, name)
    sink = fold(sdf.sparkSession, out)
    (sdf.writeStream.option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True)
     .foreachBatch(sink.absorb).start().awaitTermination())
    return sink
