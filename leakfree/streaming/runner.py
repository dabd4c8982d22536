"""Running streaming queries to completion and reading their results as batch frames.

Sinks are files under the shared checkpoint folder (never driver memory):

* every micro-batch is written to its own ``_lf_batch=<id>`` folder (overwrite), so a batch
  replayed after a failure replaces itself instead of duplicating rows;
* append outputs are read back as the union of the batches;
* update outputs (aggregations, keyed state) are written with their batch id and
  read back as the latest row per key — an upsert without a table format.

``trigger(availableNow=True)`` drains what is there in bounded micro-batches and stops,
which is how the twins are compared with their batch versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakfree.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    base = checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir is not set")
    return f"{base.rstrip('/')}/leakfree-stream-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str, key: str, order: str, slices: int = 4, files_per_slice: int = 4,
          fmt: str = "parquet") -> None:
    """Write a batch table as an append-only source: ``slices`` successive appends by
    ``order`` range, each hash-partitioned by ``key`` so every key's rows of a slice sit
    in one file — per key, files arrive in order."""
    bounds = df.agg(F.min(order), F.max(order)).first()
    lo, hi = bounds[0], bounds[1]
    if lo is None:
        df.limit(0).write.mode("append").format(fmt).save(path)
        return
    step = (hi - lo) / slices if hi > lo else 1
    for i in range(slices):
        a = lo + i * step
        cond = (F.col(order) >= a) & ((F.col(order) < a + step) if i < slices - 1 else F.lit(True))
        part = df.where(cond).repartition(files_per_slice, key)
        part.write.mode("append").format(fmt).save(path)


def run(sdf: DataFrame, name: str, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Drain ``sdf`` with availableNow into files; return the result as a batch frame
    (for ``mode='update'`` the latest row per ``keys``)."""
    spark = sdf.sparkSession
    out = scratch(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # idempotent: a micro-batch replayed after a failure overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/data/_lf_batch={batch_id}")

    q = (sdf.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).foreachBatch(sink).start())
    q.awaitTermination()
    res = spark.read.schema(_schema_with_batch(sdf)).parquet(f"{out}/data") if _has_output(spark, out) \
        else spark.createDataFrame([], _schema_with_batch(sdf))
    if mode == "update" and keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("_lf_batch"))
        res = res.withColumn("_lf_rn", F.row_number().over(w)).where(F.col("_lf_rn") == 1).drop("_lf_rn")
    return res.drop("_lf_batch")


def _schema_with_batch(sdf: DataFrame):
    from pyspark.sql import types as T
    return T.StructType(sdf.schema.fields + [T.StructField("_lf_batch", T.LongType())])


def _has_output(spark: SparkSession, out: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{out}/data")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
