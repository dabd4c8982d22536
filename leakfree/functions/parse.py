"""PRJ-3 parse_cv_summary, PRJ-4 metric_direction, PRJ-10 parse_score, PRJ-13 is_transient."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakfree.functions.directions import METRIC_DIRECTION, higher_is_better

__all__ = ["METRIC_DIRECTION", "better", "cv_mean", "cv_metric", "higher_is_better", "is_transient", "parse_cv_summary", "parse_score"]

# The fields of a train_cv summary line in the log format.
MEAN_RE = r"mean=(-?[0-9.]+)"
METRIC_RE = r"metric=(\w+)"
STD_RE = r"std=(-?[0-9.]+)"
STRATEGY_RE = r"train_cv complete: (\w+) \((\d+) folds\)"
FOLDS_RE = r"fold_scores=(\[[^\]]*\])"
DURATION_RE = r"duration_s=(-?[0-9.]+)"

# HTTP statuses and message phrases that mark a transient failure.
TRANSIENT_STATUS = [408, 429, 500, 502, 503, 504]
TRANSIENT_PHRASES = ["rate limit", "temporarily unavailable", "connection timeout",
                     "connection reset", "deadline exceeded"]


def _group(c: Column, pattern: str, idx: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, idx), F.lit(""))


def to_double(s: Column) -> Column:
    """Python ``float()`` of a regex match restricted to digits, dots and a sign."""
    return s.try_cast("double")


def cv_mean(summary: Column) -> Column:
    return to_double(_group(summary, MEAN_RE))


def cv_metric(summary: Column) -> Column:
    return _group(summary, METRIC_RE)


def parse_cv_summary(summary: Column) -> Column:
    """Struct of the fields a train_cv summary line carries."""
    return F.struct(
        _group(summary, STRATEGY_RE, 1).alias("strategy"),
        _group(summary, STRATEGY_RE, 2).try_cast("int").alias("n_splits"),
        cv_metric(summary).alias("metric"),
        cv_mean(summary).alias("mean"),
        to_double(_group(summary, STD_RE)).alias("std"),
        F.from_json(_group(summary, FOLDS_RE), "array<double>").alias("fold_scores"),
        to_double(_group(summary, DURATION_RE)).alias("duration_s"),
    )


def better(new: Column, prior: Column, hib: Column) -> Column:
    """MET-9: strictly better in the metric's direction; no prior → better."""
    return prior.isNull() | F.when(hib, new > prior).otherwise(new < prior)


def parse_score(score: Column) -> Column:
    """Leaderboard score text → double; unparseable → 0.0."""
    return F.coalesce(F.trim(score).try_cast("double"), F.lit(0.0))


def is_transient(status: Column, message: Column) -> Column:
    phrases = "|".join(TRANSIENT_PHRASES)
    return F.when(status.isNotNull(), status.isin(*TRANSIENT_STATUS)).otherwise(
        F.coalesce(F.lower(message).rlike(phrases), F.lit(False)))
