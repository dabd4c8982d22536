"""SRC-1..5 readers and SNK-1..3 writers.

Logs are JSON lines.  ``read_log`` is tolerant like the original readers — blank lines
vanish, any unparseable line (truncated tail *or* middle) is skipped — but instead of
dropping bad lines silently it returns them as a quarantine DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

#: Directories of a log partitioned by a key, whatever the number of keys.
BUCKETS = 64

#: Competitions are names; a number in a log reads as its text.
JOURNAL_SCHEMA = T.StructType([
    T.StructField("competition", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("ts", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("tool", T.StringType()), T.StructField("args", T.StringType()),
    T.StructField("result_summary", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("tool_call_id", T.StringType()), T.StructField("trigger", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("evidence", T.StringType()),
    T.StructField("decision", T.StringType())])

LEDGER_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("cached_tokens", T.LongType()), T.StructField("competition", T.StringType()),
    T.StructField("cost_usd", T.DoubleType())])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               header: bool = True) -> DataFrame:
    """SRC-1: a whole table; CSV with a header row and either an explicit schema or
    inferred types.  A missing path fails before any job runs."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"table not found: {path}")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", header)
        if schema is None:
            r = r.option("inferSchema", True)
    return r.format(fmt).load(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """SRC-3 / STR-1 batch twin: ``(records, quarantine)`` from JSON-lines files.

    Files are read as text lines (split across tasks like any text file), blank lines are
    dropped and every line is parsed with ``from_json`` in PERMISSIVE mode; a line that
    does not parse — a torn tail or damage in the middle — goes to the quarantine frame
    with its file.  Directory partition columns (``competition=...``) fill fields the
    line does not carry.  A missing path yields two empty frames.  Order comes from the
    writer's ``seq`` field; see ``read_log_lines`` when there is none."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    if not _exists(spark, path):
        empty = spark.createDataFrame([], full)
        return empty.drop(CORRUPT), empty.select(F.lit(path).alias("file"), CORRUPT)
    raw = spark.read.text(path).withColumn("_lf_file", F.col("_metadata.file_path"))
    raw = raw.where(F.trim("value") != "")
    parts = [c for c in raw.columns if c not in ("value", "_lf_file")]
    parsed = raw.select("_lf_file", "value", *parts, F.from_json(
        "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_lf_r"))
    bad_line = F.col(f"_lf_r.{CORRUPT}").isNotNull() | F.col("_lf_r").isNull()
    fields = []
    for f in schema.fields:
        c = F.col(f"_lf_r.{f.name}")
        if f.name in parts:
            c = F.coalesce(c, F.col(f.name).cast(f.dataType))
        fields.append(c.alias(f.name))
    good = parsed.where(~bad_line).select(*fields)
    bad = parsed.where(bad_line).select(F.col("_lf_file").alias("file"), F.col("value").alias(CORRUPT))
    return good, bad


def read_log_lines(spark: SparkSession, path: str, schema: T.StructType, seq: str = "seq",
                   one_log: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC-3 with line ordinals: ``seq`` = 0-based line number in its file, blank lines counted but dropped.
    ``one_log``: the files under ``path`` are, in order of their names, parts of one log (as a rotated log's), and its lines
    are numbered through.

    A large file is read by many tasks.  The lines of one split (``file_block_start``) are read in
    order, so a line's number is the lines of the file's earlier splits (a running sum over one row per
    split) and its place in its own."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    splits = raw.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per split
    order = Window.orderBy("file", "_block") if one_log else Window.partitionBy("file").orderBy("_block")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    lines = raw.join(splits, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b"))).select(
        "file", (F.col("_before") + F.col("_row") - F.col("_first")).alias(seq),
        F.regexp_replace("value", r"\s+$", "").alias("_line")).where(F.col("_line") != "")  # CRLF and trailing blanks
    parsed = lines.select("file", seq, "_line", F.from_json("_line", full, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad_line = F.col(f"r.{CORRUPT}").isNotNull() | F.col("r").isNull()
    good = parsed.where(~bad_line).select("file", seq, *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields if f.name != seq])
    bad = parsed.where(bad_line).select("file", seq, F.col("_line").alias(CORRUPT))
    return good, bad


def competition_catalog(paths: DataFrame, path: str = "path", marker: str = "agent") -> DataFrame:
    """SRC-4: sorted names of workspace directories that contain an ``agent/`` folder,
    from a file listing (e.g. ``binaryFile`` paths).  Plain (``<name>/agent/``) and
    partition-style (``ws=<name>/area=agent/``) layouts are both recognised."""
    name = F.regexp_extract(F.col(path), rf"/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?{marker}/", 1)
    return paths.select(name.alias("competition")).where(F.col("competition") != "").distinct().orderBy("competition")


#: What a null name is called in a folder name.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def pack_workspaces(records: DataFrame, path: str, workspace: str = "ws", area: str = "area") -> None:
    """Write records as workspaces (``ws=<name>/area=<area>/``) packed into few large files, as an archive holds its
    members: each record has the path of its member.  A folder and a file per workspace and area would cost
    far more than their rows when there are many small ones."""
    def folder(c: str) -> Column:
        return F.concat(F.lit(f"/{c}="), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NO_NAME)))
    member = F.concat(F.lit(path.rstrip("/")), folder(workspace), folder(area), F.lit("/records"))
    append_log(records.withColumn("path", member), path, workspace, "parquet")


def packed_files(spark: SparkSession, path: str) -> DataFrame:
    """The file listing of packed workspaces: a row per member path (no other column is read)."""
    return spark.read.parquet(path).select("path").distinct()


def file_inventory(spark: SparkSession, path_glob: str) -> DataFrame:
    """SRC-5: file names and sizes (``%.1f MB``) from a listing; ``content`` is never read
    because only path/length are selected (the binary-file source prunes it)."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length",
                        F.format_string("%.1f MB", F.col("length") / 1048576).alias("size"))


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The directory (``<key column>_bucket=``) of a partitioned log that holds a key's rows."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def only(log: DataFrame, key: str, value, buckets: int = BUCKETS) -> DataFrame:
    """One key's rows of a log that ``append_log`` partitioned by ``key``: only its directory is read."""
    return log.where((F.col(f"{key}_bucket") == bucket_of(F.lit(value), buckets)) & (F.col(key) == value)).drop(f"{key}_bucket")


def append_log(df: DataFrame, path: str, partition_by: str | None = "competition", fmt: str = "json", buckets: int = BUCKETS) -> None:
    """SNK-1: durable append (the file commit protocol replaces per-line fsync).

    A partitioned log has ``buckets`` directories, each of the keys of one hash (see ``only``): with a directory per
    key, an append wrote a file or more per key, however few rows that had, and the commit moved them one by one.
    The key stays in the rows, which are sorted by it.  Partitioned writes ``rebalance`` on the bucket: adaptive execution
    groups a bucket's rows into few files but splits a large one (a hot competition) over several tasks
    (``repartition(col)`` would put it in one)."""
    w = df
    if partition_by:
        bucket = f"{partition_by}_bucket"
        w = df.withColumn(bucket, bucket_of(F.col(partition_by), buckets)).hint("rebalance", bucket).sortWithinPartitions(bucket, partition_by)
    w = w.write.mode("append")
    if partition_by:
        w = w.partitionBy(bucket)
    w.format(fmt).save(path)


def append_log_stream(sdf: DataFrame, path: str, checkpoint: str, partition_by: str | None = None,
                      fmt: str = "json", available_now: bool = True):
    """SNK-1 for streams: the file sink with a checkpoint is exactly-once (the commit log
    replaces per-line fsync).  Returns the started query."""
    w = sdf.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(partition_by)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start(path)


def write_lines(df: DataFrame, path: str, line: str = "line", partition_by: str | None = None) -> None:
    w = df.select(*([partition_by] if partition_by else []), line).write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.text(path)


def write_predictions(df: DataFrame, path: str, single_file: bool = False) -> None:
    """SNK-2: submission CSV with a header and no index; partitioned output unless a
    single file is requested."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def retain_latest(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """SNK-3: the newest ``n`` rows per group (plans as a WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(F.col(order).desc())
    return df.withColumn("_lf_rn", F.row_number().over(w)).where(F.col("_lf_rn") <= n).drop("_lf_rn")
