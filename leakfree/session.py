"""Session helpers: a local session for tests/bench and lineage cutting.

On a cluster the caller owns the session; nothing here overrides settings that are
already present.  ``spark.checkpoint.dir`` is read from the session and only set by
us when it is absent *and* the master is local (tests, bench).
"""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = 8, shuffle_partitions: int | None = None,
              app: str = "leakfree", **conf: str) -> SparkSession:
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    builder = SparkSession.builder
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, or a scratch one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="leakfree-ckpt-", dir="/tmp"))
        return sc.getCheckpointDir()
    return None


def materialize(df: DataFrame, reliable: bool = False) -> DataFrame:
    """Pin a DataFrame whose non-deterministic columns (partition ids, positions) must not
    change between the jobs that read it.

    ``reliable=True`` writes a checkpoint into the shared checkpoint folder (survives
    executor loss without recomputation).  Otherwise the frame is persisted to memory
    and disk; our callers only pin plans with a total sort order, so a recomputation
    after a lost executor yields the same values.
    """
    if reliable:
        if not checkpoint_dir(df.sparkSession):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
