"""PRJ-8 target_candidates, PRJ-9 detect_id_column — rules over a column catalog.

A catalog is a DataFrame ``(table, ordinal, name, dtype)`` built from schemas; names are
compared as data because Spark's column resolution is case-insensitive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Exact target names, suffixes and prefixes (matched on the lower-cased name).
TARGET_EXACT = ["target", "label", "y", "outcome", "class", "survived", "saleprice"]
TARGET_SUFFIXES = ["_target", "_label", "_y", "_outcome", "_class"]
TARGET_PREFIXES = ["target_", "label_", "y_"]
# Id columns tried first, in priority order.
ID_EXPLICIT = ["id", "Id", "ID", "PassengerId", "pk", "entry_id", "row_id"]


def catalog(spark: SparkSession, frames: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    rows = [(t, i, f.name, f.dataType.simpleString())
            for t, df in frames for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, ordinal int, name string, dtype string")


def looks_like_target(name: Column) -> Column:
    low = F.lower(name)
    suffix = "(" + "|".join(TARGET_SUFFIXES) + ")$"
    prefix = "^(" + "|".join(TARGET_PREFIXES) + ")"
    return low.isin(*TARGET_EXACT) | low.rlike(suffix) | low.rlike(prefix)


def target_candidates(cat: DataFrame) -> DataFrame:
    return cat.where(looks_like_target(F.col("name")))


#: Names that rank behind the explicit ones, by place (matched on the lower-cased name; never a bare substring).
ID_PATTERN = "^(id|id_.*|.*_id)$"


def id_rank(name: Column, ordinal: Column) -> Column:
    """Priority of a column as the id: explicit list first, then the left-most that has the pattern; null = not an id."""
    explicit = F.array_position(F.array(*[F.lit(x) for x in ID_EXPLICIT]), name)
    return F.when(explicit > 0, explicit).when(F.lower(name).rlike(ID_PATTERN), F.lit(len(ID_EXPLICIT) + 1) + ordinal)


def detect_id_column(cat: DataFrame) -> DataFrame:
    """One row per table with its id column (tables without one are absent)."""
    ranked = cat.withColumn("_r", id_rank(F.col("name"), F.col("ordinal"))).where(F.col("_r").isNotNull())
    w = Window.partitionBy("table").orderBy("_r")
    return (ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
            .select("table", F.col("name").alias("id_column")))


def id_column_of(columns: list[str]) -> str | None:
    """PRJ-9 on the names of one schema, by the same list and pattern."""
    named = [c for c in ID_EXPLICIT if c in columns]
    return next(iter([*named, *(c for c in columns if re.fullmatch(ID_PATTERN, c.lower()))]), None)
