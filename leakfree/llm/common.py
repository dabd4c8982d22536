"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakfree.session import checkpoint_dir

#: Fixed value: the white space that separates words (space and code points 9 to 13).
WHITE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def whole(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda variable binds it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(docs: DataFrame) -> DataFrame:
    """One struct column ``_row`` with the caller's columns, so that names of ours added
    beside it can't clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def part_of(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (a null id counts as the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def sampled(df: DataFrame, most: int, salt: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows by a hash of the key; all of them if there are no more."""
    share = most / max(df.count(), 1)
    return df if share >= 1 else df.where(
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(salt)), 33) < int(share * 2 ** 31))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder (survives lost executors)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def light_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that tasks exchange with Python by bytes, unless the session has a smaller bound: the default
    bounds their rows only, whatever the rows hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > size:
        spark.conf.set(name, str(size))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder of ours through Hadoop's file system (the path may be remote)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package's modules to the Python workers (a small zip, once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    name = Path(tempfile.mkdtemp(prefix="leakfree-"), f"{package.name}.zip")  # the driver serves it to executors
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(str(name))
    _shipped.add(sc.applicationId)
