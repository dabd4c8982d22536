"""FE-1..7: leak-free fold-scoped feature fitting with one scan for all folds.

Fit state for fold ``f`` only ever sees fold ``f``'s training rows (complement sums);
the state is applied to fold ``f``'s validation rows by a join on ``fold`` (k rows,
broadcast with a proven bound) or on ``(fold, value)`` (size-checked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakfree.operators.complement import train_sums
from leakfree.operators.folds import CVError, Folds
from leakfree.operators.ordered import bounded_join, ordinal

MISSING = "MISSING"
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType, T.BooleanType)


def val_rows(folds: Folds) -> DataFrame:
    """Rows that are validated in some fold (time-series warm-up rows excluded)."""
    return folds.df.where(F.col(folds.col) >= 0)


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """FE-4: numeric columns by schema type (booleans count as numeric)."""
    exclude = set(exclude or [])
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def numeric_passthrough(df: DataFrame, target: str, keep: list[str] | None = None) -> DataFrame:
    keep = [c for c in (keep or []) if c in df.columns]
    return df.select(*keep, *[c for c in numeric_columns(df, [target, *keep])])


# ---------------------------------------------------------------- FE-1 mean impute
def number(c: str) -> Column:
    """The column as a double, with NaN as null."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def fit_mean_impute(folds: Folds, cols: list[str]) -> DataFrame:
    """Per fold: the training-rows mean of each column (nulls and NaN skipped; none → 0.0)."""
    sums = {}
    for c in cols:
        sums[f"s_{c}"] = number(c)
        sums[f"n_{c}"] = F.when(number(c).isNotNull(), F.lit(1))
    st = train_sums(folds, sums)
    return st.select("fold", *[F.when(F.col(f"n_{c}") > 0, F.col(f"s_{c}") / F.col(f"n_{c}"))
                               .otherwise(F.lit(0.0)).alias(f"mean_{c}") for c in cols])


def mean_impute(folds: Folds, cols: list[str], keep: list[str]) -> DataFrame:
    stats = F.broadcast(fit_mean_impute(folds, cols))  # k rows
    j = val_rows(folds).join(stats, folds.col)
    return j.select(*keep, folds.col, *[F.coalesce(number(c), F.col(f"mean_{c}")).alias(c)
                                        for c in cols])


# ---------------------------------------------------------------- FE-2 mode impute
def fit_mode_impute(folds: Folds, col: str) -> DataFrame:
    """Per fold: most frequent training value, smallest value on ties; if none, MISSING for a string
    column and null for any other."""
    kind = dict(folds.df.dtypes)[col]
    none = F.lit(MISSING) if kind == "string" else F.lit(None).cast(kind)
    counts = train_sums(folds, {"cnt": F.when(F.col(col).isNotNull(), F.lit(1))}, by=[col])
    modes = (counts.where(F.col("cnt") > 0).groupBy("fold")
             .agg(F.min_by(F.col(col), F.struct(-F.col("cnt"), F.col(col))).alias("mode")))
    all_folds = folds.df.sparkSession.range(folds.n_splits).select(F.col("id").cast("int").alias("fold"))
    return all_folds.join(modes, "fold", "left").select("fold", F.coalesce(F.col("mode"), none).alias("mode"))


def mode_impute(folds: Folds, col: str, keep: list[str]) -> DataFrame:
    stats = F.broadcast(fit_mode_impute(folds, col))  # k rows
    return (val_rows(folds).join(stats, folds.col)
            .select(*keep, folds.col, F.coalesce(F.col(col), F.col("mode")).alias(col)))


# ---------------------------------------------------------------- FE-3 one-hot
def fit_vocabulary(folds: Folds, col: str) -> DataFrame:
    """Per fold: the values seen in training rows, indexed 0.. in ascending order."""
    counts = train_sums(folds, {"cnt": F.when(F.col(col).isNotNull(), F.lit(1))}, by=[col])
    vocab = counts.where(F.col("cnt") > 0).select("fold", col)
    return ordinal(vocab, ["fold"], [col], "_lf_i").select("fold", col, (F.col("_lf_i") - 1).alias("index"))


def one_hot_index(folds: Folds, col: str, keep: list[str]) -> DataFrame:
    """Validation rows with the position of their value in the fold's training vocabulary;
    an unseen value has no position (its one-hot vector is all zeros).  Deliberately
    stricter than encoding against the frame being transformed: train and validation
    columns always agree."""
    vocab = fit_vocabulary(folds, col)
    sizes = F.broadcast(vocab.groupBy("fold").agg(F.count(F.lit(1)).alias("vocab_size")))  # k rows
    j = bounded_join(val_rows(folds), vocab, [folds.col, col], "left")
    return (j.join(sizes, folds.col, "left")
            .select(*keep, folds.col, F.col("index").alias(f"{col}_index"),
                    F.coalesce(F.col("vocab_size"), F.lit(0)).alias("vocab_size")))


def one_hot(indexed: DataFrame, col: str, width: int | None = None) -> DataFrame:
    """Expand an index column into 0/1 columns, one per place of the largest training vocabulary (fixed across
    folds); a ``width`` that would leave values out is refused."""
    most = indexed.agg(F.max("vocab_size")).first()[0] or 0
    if width is not None and width < most:
        raise CVError(f"{col!r} has up to {most} values in a fold, more than {width} columns hold")
    idx = F.col(f"{col}_index")
    return indexed.select("*", *[F.when(idx == i, 1).otherwise(0).alias(f"{col}_{i}") for i in range(width or most)])


# ---------------------------------------------------------------- FE-5 target mean encoding
def fit_target_mean(folds: Folds, col: str, target: str, smoothing: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Per (fold, value): smoothed training mean of the target; per fold: the prior."""
    y = F.col(target).cast("double")
    per_value = train_sums(folds, {"sy": y, "n": F.when(y.isNotNull(), F.lit(1))}, by=[col])
    # the prior is the same sums over all values: reuse the per-value aggregate
    prior = per_value.groupBy("fold").agg((F.sum("sy") / F.sum("n")).alias("prior"))
    enc = (per_value.where(F.col("n") > 0).join(F.broadcast(prior), "fold")
           .select("fold", col, ((F.col("sy") + F.lit(smoothing) * F.col("prior"))
                                 / (F.col("n") + F.lit(smoothing))).alias("te")))
    return enc, prior


def target_mean_encode(folds: Folds, col: str, target: str, keep: list[str],
                       smoothing: float = 10.0, out: str = "te") -> DataFrame:
    """Validation rows with the training-fold encoding of ``col``; unseen → fold prior."""
    enc, prior = fit_target_mean(folds, col, target, smoothing)
    base = val_rows(folds)
    j = bounded_join(base, enc, [folds.col, col], "left")
    j = j.join(F.broadcast(prior), folds.col)
    return j.select(*keep, folds.col, F.coalesce(F.col("te"), F.col("prior")).alias(out))


# ---------------------------------------------------------------- FE-6 rows preserved
def rows_report(before: DataFrame, after: DataFrame, fold_col: str, row_id: str) -> DataFrame:
    """Per fold: rows before, rows after, distinct row ids after — in one job."""
    b = before.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n_after"),
                                    F.countDistinct(row_id).alias("n_distinct_after"))
    return b.join(a, fold_col, "full").select(
        fold_col, F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"),
        F.coalesce("n_distinct_after", F.lit(0)).alias("n_distinct_after"))


def assert_rows_preserved(n_before: int, n_after: int, what: str = "transform") -> None:
    if n_before != n_after:
        raise CVError(f"{what} rows changed ({n_before} -> {n_after})")
