"""The complement trick: training-fold statistics for all folds from one scan.

Additive statistics (sums, counts, Gram entries) are aggregated once per validation
block — partial aggregation, no row leaves its map task — and the statistic of fold
``f``'s training rows is the sum over the blocks that train fold ``f``
(every other block for k-fold, the earlier blocks for time series).  k scans become one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakfree.operators.folds import Folds


def _safe(name: str) -> str:
    return name.replace(".", "_")


def block_sums(folds: Folds, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One row per ``by`` key with ``{name}__{block}`` sums for every block (0 when empty)."""
    by = by or []
    aggs = [F.coalesce(F.sum(F.when(F.col(folds.col) == b, c)), F.lit(0)).alias(f"{_safe(n)}__{b + 1}")
            for n, c in sums.items() for b in folds.blocks()]
    return folds.df.groupBy(*by).agg(*aggs) if by else folds.df.agg(*aggs)


def train_sums(folds: Folds, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows ``(by..., fold, name...)``: each statistic summed over fold ``f``'s training rows."""
    by = by or []
    blocks = block_sums(folds, sums, by)
    per_fold = []
    for f in range(folds.n_splits):
        fields = [F.lit(f).alias("fold")]
        for n in sums:
            cols = [F.col(f"{_safe(n)}__{b + 1}") for b in folds.train_blocks(f)]
            total = cols[0]
            for c in cols[1:]:
                total = total + c
            fields.append(total.alias(n))
        per_fold.append(F.struct(*fields))
    exploded = blocks.select(*by, F.explode(F.array(*per_fold)).alias("_lf_s"))
    return exploded.select(*by, "_lf_s.*")
