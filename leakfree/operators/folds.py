"""CV-1..7: fold assignment as one integer column, never as index lists.

Every strategy returns a :class:`Folds`: the input rows plus a ``fold`` column giving the
fold in which the row is *validated*.  Time-series warm-up rows, which are never
validated, get fold ``-1``.  Training rows of fold ``f`` are ``fold != f`` for the
complement strategies and ``fold < f`` (expanding window) for time series.

Positional semantics (contiguous blocks, class interleaving, time order) come from the
distributed global rank (CV-0), so no strategy needs a single-partition window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakfree.functions.hashing import seeded_hash
from leakfree.operators.ordered import global_rank, ordinal

FOLD = "fold"
DEFAULT_SPLITS = 5
DEFAULT_SEED = 42
MIN_SPLITS, MAX_SPLITS = 2, 20


class CVError(ValueError):
    """Invalid cross-validation request or a broken fold/transform contract."""


@dataclass
class Folds:
    df: DataFrame
    n_splits: int
    name: str
    expanding: bool = False
    col: str = FOLD

    def unpersist(self) -> None:
        self.df.unpersist()

    def val_mask(self, f: int) -> Column:
        return F.col(self.col) == f

    def train_mask(self, f: int) -> Column:
        return F.col(self.col) < f if self.expanding else F.col(self.col) != f

    def blocks(self) -> list[int]:
        return list(range(-1 if self.expanding else 0, self.n_splits))

    def train_blocks(self, f: int) -> list[int]:
        return [b for b in self.blocks() if (b < f if self.expanding else b != f)]


def _pin(df: DataFrame) -> DataFrame:
    """Folds are read several times (statistics, validation rows, scoring): keep the
    ranked table instead of re-sorting it each time.  The order is total, so a lost
    cached block recomputes to the same folds.  ``Folds.unpersist`` releases it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _check_k(k: int, n: int | None = None) -> None:
    if not MIN_SPLITS <= k <= MAX_SPLITS:
        raise CVError(f"n_splits must be between {MIN_SPLITS} and {MAX_SPLITS}, got {k}")
    if n is not None and n < k:
        raise CVError(f"cannot split {n} rows into {k} folds")


def _block_fold(r: Column, n: int, k: int) -> Column:
    """Contiguous blocks of a 0-based rank: sizes differ by ≤ 1, first n % k get the extra row."""
    q, m = divmod(n, k)
    big = m * (q + 1)
    return F.when(r < big, F.floor(r / (q + 1))).otherwise(
        F.lit(m) + F.floor((r - big) / q) if q > 0 else F.lit(m)).cast("int")


def kfold(df: DataFrame, k: int = DEFAULT_SPLITS, seed: int = DEFAULT_SEED, shuffle: bool = True,
          row_id: str = "row_id", order_by: list[str] | None = None) -> Folds:
    """CV-1: balanced contiguous blocks of a seeded permutation (or of ``order_by``)."""
    n = df.count()
    _check_k(k, n)
    if shuffle:
        base = df.withColumn("_lf_h", seeded_hash(F.col(row_id), seed))
        order = ["_lf_h", row_id]
    else:
        if not order_by:
            raise CVError("unshuffled kfold needs order_by: DataFrames have no row order")
        base, order = df, [*order_by, row_id]
    ranked = global_rank(base, order, "_lf_r", total_rows=n)
    out = ranked.withColumn(FOLD, _block_fold(F.col("_lf_r"), n, k)).drop("_lf_r", "_lf_h")
    return Folds(_pin(out), k, "kfold")


def kfold_hash(df: DataFrame, k: int = DEFAULT_SPLITS, seed: int = DEFAULT_SEED,
               row_id: str = "row_id") -> Folds:
    """CV-1 fast path: fold = seeded hash mod k — no shuffle, balanced in expectation."""
    _check_k(k)
    return Folds(df.withColumn(FOLD, (seeded_hash(F.col(row_id), seed) % k).cast("int")), k, "kfold_hash")


def stratified_kfold(df: DataFrame, label: str, k: int = DEFAULT_SPLITS, seed: int = DEFAULT_SEED,
                     row_id: str = "row_id") -> Folds:
    """CV-2: one sort by (label, seeded hash) and a round-robin deal — per-class and total
    fold sizes both differ by at most one, and a dominant class is spread by its hash."""
    n = df.count()
    _check_k(k, n)
    base = df.withColumn("_lf_h", seeded_hash(F.col(row_id), seed))
    ranked = global_rank(base, [label, "_lf_h", row_id], "_lf_r", total_rows=n)
    out = ranked.withColumn(FOLD, (F.col("_lf_r") % k).cast("int")).drop("_lf_r", "_lf_h")
    return Folds(_pin(out), k, "stratified_kfold")


def time_series(df: DataFrame, order_by: list[str], k: int = DEFAULT_SPLITS,
                row_id: str = "row_id") -> Folds:
    """CV-3: expanding window; fold i validates the (i+1)-th of k equal tail blocks."""
    n = df.count()
    _check_k(k)
    test_size = n // (k + 1)
    if test_size < 1:
        raise CVError(f"too few rows ({n}) for {k} time-series splits")
    warm = n - k * test_size
    ranked = global_rank(df, [*order_by, row_id], "_lf_r", total_rows=n)
    r = F.col("_lf_r")
    out = ranked.withColumn(FOLD, F.when(r < warm, F.lit(-1)).otherwise(
        F.floor((r - warm) / test_size)).cast("int")).drop("_lf_r")
    return Folds(_pin(out), k, "time_series", expanding=True)


def _deals(sizes: Iterator[tuple[int, int]], k: int) -> Iterator[tuple[int, list[int], list[int], list[list[int]]]]:
    """How the groups of each size are dealt, given (size, number of groups) from the largest size down.

    Giving each of c groups of size s to the lightest fold (ties: the first) takes the c least of the
    numbers load[f] + i * s.  Counted in steps of s from the least load, fold f joins at level
    ``level[f]`` and from then on takes one group at every level, in the order of what is left over
    (load modulo s).  So between two joinings the deal is a cycle over the folds that have joined:
    yields (size, first ranks, first levels, cycles), one entry per joining."""
    load = [0] * k
    for size, count in sizes:
        low = min(load)
        join = sorted((*divmod(load[f] - low, size), f) for f in range(k))
        ranks, levels, cycles, at = [], [], [], 0
        for j, (level, _, _) in enumerate(join):
            if j:
                at += j * (level - levels[-1])
            ranks.append(at)
            levels.append(level)
            cycles.append([f for _, f in sorted((rest, f) for _, rest, f in join[:j + 1])])
        yield size, ranks, levels, cycles
        last = max(j for j in range(k) if ranks[j] <= count)
        rounds, more = divmod(count - ranks[last], last + 1)
        for level, _, f in join[:last + 1]:
            load[f] += max(0, levels[last] + rounds - level) * size
        for f in cycles[last][:more]:
            load[f] += size


def group_kfold(df: DataFrame, group_col: str, k: int = DEFAULT_SPLITS, max_rows: int | None = None) -> Folds:
    """CV-4: every group in exactly one fold; from the largest group down (ties: by value), each to
    the lightest fold (ties: the first).

    One rule at any number of groups, without a driver: how many groups of a size each fold takes depends
    on the counts of equal sizes only.  That table has at most sqrt(2 * rows) rows and is read in
    order by one task, which writes each size's deal (a cycle over folds); a group finds its fold by its
    rank within its size (a running count that splits hot sizes).  A null group is a group."""
    _check_k(k)
    if group_col not in df.columns:
        raise CVError(f"group_kfold requires an existing group column, got {group_col!r}")
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_lf_size"))
    ranked = ordinal(sizes, ["_lf_size"], [group_col], "_lf_r", max_rows).withColumn("_lf_r", F.col("_lf_r") - 1)
    counts = ranked.groupBy("_lf_size").agg(F.count(F.lit(1)).alias("_lf_c"))
    n_groups = counts.agg(F.sum("_lf_c")).first()[0] or 0
    if n_groups < k:
        raise CVError(f"cannot have {k} folds with only {n_groups} groups")

    def deal(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((int(n), int(c)) for pdf in pdfs for n, c in zip(pdf["_lf_size"], pdf["_lf_c"]))
        dealt = _deals(rows, k)
        while block := list(islice(dealt, 10_000)):
            yield pd.DataFrame(block, columns=["_lf_s", "_lf_ranks", "_lf_levels", "_lf_cycles"])

    deals = counts.repartition(1).sortWithinPartitions(F.desc("_lf_size")).mapInPandas(
        deal, "_lf_s long, _lf_ranks array<long>, _lf_levels array<long>, _lf_cycles array<array<int>>")
    # at most sqrt(2 * rows) rows, and far fewer than groups: adaptive execution measures and broadcasts it
    placed = ranked.join(deals, F.col("_lf_size") == F.col("_lf_s"))
    joined = F.size(F.filter("_lf_ranks", lambda r: r <= F.col("_lf_r")))
    turn = F.col("_lf_r") - F.element_at("_lf_ranks", joined)
    fold = F.get(F.element_at("_lf_cycles", joined), (turn % joined).cast("int"))
    table = placed.select(F.col(group_col).alias("_lf_g"), fold.cast("int").alias(FOLD))
    out = df.join(table, F.col(group_col).eqNullSafe(F.col("_lf_g")), "left").drop("_lf_g")
    return Folds(out, k, "group_kfold")


def subsample(df: DataFrame, fraction: float, seed: int = DEFAULT_SEED, row_id: str = "row_id") -> DataFrame:
    """OPT-7: deterministic subsample — rows whose seeded hash falls below the fraction
    (reproducible by any engine, no shuffle, no driver state)."""
    if not 0 < fraction <= 1:
        raise CVError("fraction must be in (0, 1]")
    return df.where(seeded_hash(F.col(row_id), seed) < F.lit(int(fraction * 2 ** 32)))


def fold_report(folds: Folds, label: str | None = None, group_col: str | None = None) -> DataFrame:
    """CV-7: rows per fold (and per class), groups per fold, and folds per group (purity)."""
    by = [folds.col] + ([label] if label else [])
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if group_col:
        aggs.append(F.countDistinct(group_col).alias("n_groups"))
    return folds.df.groupBy(*by).agg(*aggs)


def group_purity(folds: Folds, group_col: str) -> DataFrame:
    return folds.df.groupBy(group_col).agg(F.countDistinct(folds.col).alias("n_folds"),
                                           F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- registry (CV-5, CV-6, UDF-3)
_FACTORIES: dict[str, Callable[..., Folds]] = {}


def register(name: str, fn: Callable[..., Folds]) -> None:
    """UDF-3: a strategy ``fn(df, **params) -> Folds`` is usable by name once registered."""
    _FACTORIES[name] = fn


register("kfold", lambda df, n_splits=DEFAULT_SPLITS, row_id="row_id", seed=DEFAULT_SEED, shuffle=True, order_by=None, **kw:
         kfold(df, n_splits, seed, shuffle, row_id, order_by))
register("stratified_kfold", lambda df, n_splits=DEFAULT_SPLITS, label="target", row_id="row_id",
         seed=DEFAULT_SEED, **kw: stratified_kfold(df, label, n_splits, seed, row_id))
register("time_series", lambda df, n_splits=DEFAULT_SPLITS, order_by=None, row_id="row_id", **kw:
         time_series(df, order_by or [row_id], n_splits, row_id))
register("group_kfold", lambda df, n_splits=DEFAULT_SPLITS, group_col=None, **kw:
         group_kfold(df, group_col, n_splits))


def list_strategies() -> list[str]:
    return sorted(_FACTORIES)


@dataclass(frozen=True)
class Strategy:
    name: str
    n_splits: int = DEFAULT_SPLITS
    group_col: str | None = None
    order_by: tuple[str, ...] | None = None
    seed: int = DEFAULT_SEED
    shuffle: bool = True

    def apply(self, df: DataFrame, label: str = "target", row_id: str = "row_id") -> Folds:
        return _FACTORIES[self.name](df, n_splits=self.n_splits, label=label, row_id=row_id,
                                     group_col=self.group_col, seed=self.seed, shuffle=self.shuffle,
                                     order_by=list(self.order_by) if self.order_by else None)


def get(name: str, n_splits: int = DEFAULT_SPLITS, group_col: str | None = None,
        order_by: list[str] | None = None, seed: int = DEFAULT_SEED, shuffle: bool = True) -> Strategy:
    """CV-6: validated strategy override.  ``shuffle=False`` (k-fold) keeps the rows in ``order_by``."""
    if name not in _FACTORIES:
        raise CVError(f"unknown CV kind {name!r}; allowed: {list_strategies()}")
    _check_k(n_splits)
    if name == "group_kfold" and not group_col:
        raise CVError("group_kfold requires group_col=<column name>")
    if name == "kfold" and not shuffle and not order_by:
        raise CVError("unshuffled kfold needs order_by: DataFrames have no row order")
    return Strategy(name, n_splits, group_col, tuple(order_by) if order_by else None, seed, shuffle)


#: Default strategy of a problem type when no column of the data asks for another.
BY_PROBLEM = {"classification": "stratified_kfold", "regression": "kfold"}


def auto_select(problem_type: str, n_splits: int = DEFAULT_SPLITS, date_col: str | None = None,
                group_col: str | None = None) -> Strategy:
    """CV-5: the first rule that holds names the strategy: groups, dates, then the problem type."""
    rules = {"group_kfold": group_col, "time_series": date_col, BY_PROBLEM.get(problem_type): True}
    name = next(n for n, holds in rules.items() if holds)
    if name is None:
        raise CVError(f"no default strategy for problem type {problem_type!r}, only for {sorted(BY_PROBLEM)}")
    return get(name, n_splits, group_col=group_col if name == "group_kfold" else None,
               order_by=[date_col] if name == "time_series" else None)
