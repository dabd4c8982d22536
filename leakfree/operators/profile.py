"""PROF-1/2 column profile and brief, TOP-1 leaderboard top-n, SMP-1 deterministic sample,
SRT-1 ordered reads, PORT-1/2 portfolio views (JN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakfree.functions.catalog import catalog, detect_id_column, target_candidates
from leakfree.functions.hashing import seeded_hash
from leakfree.functions.parse import parse_score

COMP = "competition"


def _present(df: DataFrame, c: str) -> Column:
    """Missing = null, and NaN for floating columns (as a pandas profile counts it)."""
    col = F.col(c)
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.when(col.isNotNull() & ~F.isnan(col), col)
    return col


def _counted(df: DataFrame, c: str, i: int) -> Column:
    """A present value as (column number, key): values of at most eight bytes by ``xxhash64``, which maps
    those one to one (and takes -0.0 for 0.0), others as text or JSON."""
    kind, p = df.schema[c].dataType, _present(df, c)
    short = isinstance(kind, (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) \
        and not isinstance(kind, T.DecimalType)
    text = F.hex(p) if isinstance(kind, T.BinaryType) else F.to_json(F.struct(p.alias("v"))) if isinstance(
        kind, (T.ArrayType, T.StructType, T.MapType)) else p.cast("string")
    none = F.lit(None)
    return F.struct(F.lit(i).alias("i"), F.when(p.isNotNull(), F.xxhash64(p) if short else none).cast("bigint").alias("h"),
                    F.when(p.isNotNull(), none if short else text).cast("string").alias("s"), p.isNotNull().alias("there"))


def column_profile(df: DataFrame, approx_distinct: bool = False, rsd: float = 0.01) -> DataFrame:
    """PROF-1: one row per column — dtype, non-missing count, rows, distinct non-missing values.

    Exact distincts come from one long pass: every row gives one (column, value) pair per column, equal
    pairs are combined before and after one shuffle, and pairs are counted per column; no copy of the
    row per column.  ``approx_distinct`` sketches them instead (HyperLogLog++, no shuffle of values)."""
    types = dict(df.dtypes)
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype")) for c in df.columns])
    if approx_distinct:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(df.columns):
            p = _present(df, c)
            aggs += [F.count(p).alias(f"_nn{i}"), F.approx_count_distinct(p, rsd).alias(f"_nd{i}")]
        entries = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"_nn{i}").alias("non_null"),
                            F.col(f"_nd{i}").alias("n_distinct")) for i, c in enumerate(df.columns)]
        return df.agg(*aggs).select("rows", F.explode(F.array(*entries)).alias("e")).select(
            "e.column", "e.dtype", "e.non_null", "rows", "e.n_distinct")
    pairs = df.select(F.explode(F.array(*[_counted(df, c, i) for i, c in enumerate(df.columns)])).alias("v")).select("v.*")
    values = pairs.groupBy("i", "h", "s", "there").agg(F.count(F.lit(1)).alias("n"))
    per = values.groupBy("i").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("there"), F.col("n"))), F.lit(0)).alias("non_null"),
                                  F.count_if(F.col("there")).alias("n_distinct"))
    every = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("_i"))  # columns of a table without rows too
    told = every.join(per, F.col("_i") == F.col("i"), "left").withColumn("e", F.get(names, F.col("_i")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.select("e.column", "e.dtype", zero("non_null"), zero("rows"), zero("n_distinct"))


def brief(spark, frames: dict[str, DataFrame], files: DataFrame | None = None,
          leaderboard: DataFrame | None = None) -> dict:
    """PROF-2: the data brief of a competition — per table rows/columns/profile, likely
    targets, file list and leaderboard; a missing table yields a message, not an error.
    Every part is a small DataFrame computed on the cluster."""
    out: dict = {"tables": {}, "messages": []}
    for name, df in frames.items():
        if df is None:
            out["messages"].append(f"table {name!r} is missing")
            continue
        out["tables"][name] = {"profile": column_profile(df), "n_columns": len(df.columns)}
    cat = catalog(spark, [(n, d) for n, d in frames.items() if d is not None])
    out["targets"] = target_candidates(cat)
    if files is not None:
        out["files"] = files
    if leaderboard is not None:
        out["leaderboard"] = leaderboard
    return out


def brief_rows(spark, frames: dict[str, DataFrame | None]) -> DataFrame:
    """PROF-2 as one frame ``(tbl, section, name, value)``: row and column counts of every
    table (one counting job each), likely targets (PRJ-8), the id column (PRJ-9), and a
    message for a missing table."""
    present = {n: d for n, d in frames.items() if d is not None}
    parts = []
    for name, df in present.items():
        parts.append(df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
            F.lit(name).alias("tbl"), F.lit("summary").alias("section"), F.lit("rows").alias("name"), "value"))
        parts.append(spark.createDataFrame([(name, "summary", "columns", str(len(df.columns)))],
                                           "tbl string, section string, name string, value string"))
    cat = catalog(spark, present.items())
    parts.append(target_candidates(cat).select(F.col("table").alias("tbl"), F.lit("target").alias("section"),
                                               "name", F.lit("likely target").alias("value")))
    parts.append(detect_id_column(cat).select(F.col("table").alias("tbl"), F.lit("id").alias("section"),
                                              F.col("id_column").alias("name"), F.lit("id column").alias("value")))
    missing = [n for n, d in frames.items() if d is None]
    if missing:
        parts.append(spark.createDataFrame([(n, "message", "missing", f"table {n!r} is missing") for n in missing],
                                           "tbl string, section string, name string, value string"))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def top_n(entries: DataFrame, n: int = 10, score: str = "score", team: str = "team_name",
          tie: str | None = None, higher_is_better: bool = True) -> DataFrame:
    """TOP-1: leaderboard top-n by parsed score (unparseable → 0.0), ranks from 1, an
    empty team name shown as ``(redacted)``.
    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps n rows."""
    s = parse_score(F.col(score))
    order = [s.desc() if higher_is_better else s.asc()] + ([F.col(tie).asc()] if tie else [])
    top = entries.select("*", s.alias("_lf_s")).orderBy(*order).limit(n)
    # the window below only sees the n limited rows
    w = Window.orderBy(F.col("_lf_s").desc() if higher_is_better else F.col("_lf_s").asc(),
                       *([F.col(tie).asc()] if tie else []))
    name = F.when(F.coalesce(F.col(team), F.lit("")) == "", F.lit("(redacted)")).otherwise(F.col(team))
    return top.select(F.row_number().over(w).alias("rank"), name.alias("team_name"),
                      F.col("_lf_s").alias("score"))


def sample_rows(df: DataFrame, n: int, random: bool = False, row_id: str = "row_id",
                seed: int = 42, order_by: list[str] | None = None) -> DataFrame:
    """SMP-1: ``n`` (1..100) rows — seeded pseudo-random (top-n of a hash of the row id,
    reproducible by any engine) or the first rows in ``order_by``; never a full sort."""
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    if random:
        return df.orderBy(seeded_hash(F.col(row_id), seed), F.col(row_id)).limit(n)
    return head_scan(df, n, order_by or [row_id])


def head_scan(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """SRC-2: first n rows; with ``order_by`` a top-n (TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def portfolio(competitions: DataFrame, behaviour: DataFrame, best: DataFrame, costs: DataFrame) -> DataFrame:
    """PORT-1 (JN-1): competitions ⋈ behaviour ⋈ best CV ⋈ spend; missing spend = 0.0,
    missing best CV = null.  Every input is one row per competition, so the joins are
    between aggregates, never raw logs."""
    return (competitions.join(behaviour.select(COMP, F.col("turns_per_run").alias("tool_calls")), COMP, "left")
            .join(best.select(COMP, "best_cv_mean"), COMP, "left")
            .join(costs.select(COMP, "total_usd"), COMP, "left")
            .select(COMP, "best_cv_mean", F.coalesce("total_usd", F.lit(0.0)).alias("cost_usd"),
                    F.coalesce("tool_calls", F.lit(0)).alias("tool_calls")))
