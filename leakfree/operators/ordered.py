"""Ordered computations without an unbounded task: running aggregates per key and global rank.

Spark's ``Window.partitionBy(key).orderBy(seq)`` puts every row of one key into one task.
The logs we analyse are keyed by competition, and one competition may hold a large share
of all rows, so every ordered operator in this package goes through :func:`running`:

1. count rows per key (partial aggregation, one small shuffle);
2. rows of keys above ``max_rows_per_task`` are range-partitioned on (key, order) — Spark
   samples bounds on the whole order tuple and assigns rows by binary search — and the
   partition id becomes the row's sub-range (consecutive, bounded, any number of them);
3. the native Window runs per ``(key, sub)`` — each task is bounded;
4. each sub-range's totals are prefix-combined over earlier sub-ranges of the same key
   (a table of at most ``#sub-ranges`` rows) and added back with a join.

Small keys take the plain Window path, so the overhead is one aggregation.  With no
keys at all the whole table is one key, which gives a distributed global rank (CV-0).
The caller must supply an order that is total within a key (append a unique id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakfree.session import materialize

MAX_ROWS_CONF = "spark.leakfree.scan.maxRowsPerTask"
BROADCAST_ROWS_CONF = "spark.leakfree.broadcast.maxRows"
DEFAULT_MAX_ROWS_PER_TASK = 2_000_000
DEFAULT_BROADCAST_ROWS = 2_000_000

_KEY = "_lf_key"
_SUB = "_lf_sub"


@dataclass(frozen=True)
class Agg:
    """One running aggregate: ``fn`` in sum | count | max | min | last (last non-null)."""

    name: str
    fn: str
    col: str | Column | None = None

    def column(self) -> Column:
        if self.col is None:
            return F.lit(1)
        return F.col(self.col) if isinstance(self.col, str) else self.col


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    value = df.sparkSession.conf.get(key, None)
    return int(value) if value else default


def max_rows_per_task(df: DataFrame) -> int:
    return _conf_int(df, MAX_ROWS_CONF, DEFAULT_MAX_ROWS_PER_TASK)


def broadcast_row_limit(df: DataFrame) -> int:
    return _conf_int(df, BROADCAST_ROWS_CONF, DEFAULT_BROADCAST_ROWS)


def bounded_join(big: DataFrame, small: DataFrame, on, how: str = "left",
                 small_rows: int | None = None) -> DataFrame:
    """Join ``small`` to ``big``.  With a known row bound under the limit the small side is
    broadcast; otherwise the planner decides, and adaptive execution broadcasts only
    after measuring the small side's real size at runtime (no extra job, no guess)."""
    if small_rows is not None and small_rows <= broadcast_row_limit(big):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def _window_fn(a: Agg, w) -> Column:
    c = a.column()
    if a.fn == "sum":
        return F.sum(c).over(w)
    if a.fn == "count":
        return F.count(c).over(w)
    if a.fn == "max":
        return F.max(c).over(w)
    if a.fn == "min":
        return F.min(c).over(w)
    if a.fn == "last":
        return F.last(c, ignorenulls=True).over(w)
    raise ValueError(f"unknown running aggregate {a.fn!r}")


def _group_fn(a: Agg, order_struct: Column) -> Column:
    c = F.col(a.name + "_in")
    if a.fn == "sum":
        return F.sum(c)
    if a.fn == "count":
        return F.count(c)
    if a.fn == "max":
        return F.max(c)
    if a.fn == "min":
        return F.min(c)
    if a.fn == "last":
        return F.max_by(c, F.when(c.isNotNull(), order_struct))
    raise ValueError(a.fn)


def _combine(a: Agg, carry: Column, local: Column) -> Column:
    if a.fn in ("sum", "count"):
        both_null = carry.isNull() & local.isNull()
        total = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        return total if a.fn == "count" else F.when(~both_null, total)
    if a.fn == "max":
        return F.greatest(carry, local)
    if a.fn == "min":
        return F.least(carry, local)
    if a.fn == "last":
        return F.coalesce(local, carry)
    raise ValueError(a.fn)


def _prefix_fn(a: Agg, w) -> Column:
    c = F.col(a.name + "_seg")
    if a.fn in ("sum", "count"):
        return F.sum(c).over(w)
    if a.fn == "max":
        return F.max(c).over(w)
    if a.fn == "min":
        return F.min(c).over(w)
    if a.fn == "last":
        return F.last(c, ignorenulls=True).over(w)
    raise ValueError(a.fn)


_HOT_MEMO: dict = {}


def _hot_count(df: DataFrame, keys: list[str], limit: int, hot: DataFrame) -> int:
    """Number of keys above the per-task cap — one aggregation job per distinct input.

    Several ordered scans over the same log in one plan ask the same question; the answer is
    remembered by the semantic hash of the key projection and the files it reads, so a log that
    has grown is counted again."""
    try:
        keyed = df.select(*keys)
        sig = (df.sparkSession.sparkContext.applicationId, keyed.semanticHash(), hash(tuple(sorted(keyed.inputFiles()))), tuple(keys), limit)
    except Exception:  # noqa: BLE001 — plans without a semantic hash are simply counted each time
        return hot.count()
    if sig not in _HOT_MEMO:
        _HOT_MEMO[sig] = hot.count()
    return _HOT_MEMO[sig]


def running(df: DataFrame, keys: list[str], order: list[str], aggs: list[Agg],
            inclusive: bool = True, max_rows: int | None = None, total_rows: int | None = None) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order`` (rows frame).

    ``inclusive=True`` → frame ``unbounded preceding .. current row``;
    ``False`` → ``.. 1 preceding`` (null / 0 for the first row of a key, as in SQL).
    A known ``total_rows`` saves the size-check job (with keys, if even all rows are under the cap).  Keys at or below the
    per-task cap take one plain window (splitting them was measured slower: the extra
    exchange and the carry join cost more than one task sorting its rows).  Hot keys pay
    two shuffles of their own rows (the range exchange, then the window's hash exchange
    on (key, sub-range)); Spark caps the range-bound sample at 10⁶ points, so the
    driver-side part stays bounded however many sub-ranges there are.
    """
    limit = max_rows or max_rows_per_task(df)
    base = df
    part_keys = list(keys)
    if not part_keys:
        base = base.withColumn(_KEY, F.lit(0))
        part_keys = [_KEY]
    for a in aggs:
        base = base.withColumn(a.name + "_in", a.column())

    spark = df.sparkSession
    if not keys:
        n = total_rows if total_rows is not None else df.count()
        sizes = spark.createDataFrame([(0, n)], f"{_KEY} int, _lf_n long")
        hot = sizes.where(F.col("_lf_n") > limit)
        n_hot = 1 if n > limit else 0
    else:
        sizes = base.groupBy(*part_keys).agg(F.count(F.lit(1)).alias("_lf_n"))
        hot = sizes.where(F.col("_lf_n") > limit)
        n_hot = 0 if total_rows is not None and total_rows <= limit else _hot_count(df, part_keys, limit, hot)
    frame_end = 0 if inclusive else -1
    order_cols = [F.col(c) for c in order]

    if n_hot == 0:
        w = Window.partitionBy(*part_keys).orderBy(*order_cols).rowsBetween(
            Window.unboundedPreceding, frame_end)
        out = base
        for a in aggs:
            out = out.withColumn(a.name, _window_fn(Agg(a.name, a.fn, a.name + "_in"), w))
        return _finish(out, keys, aggs)

    # --- hot keys: range-partition their rows on (key, order); partition = sub-range -----
    hot_keys = hot.select(*part_keys)
    small_hot = n_hot <= broadcast_row_limit(df)
    hot_side = F.broadcast(hot_keys) if small_hot else hot_keys
    cold = base.join(hot_side, part_keys, "left_anti")
    w_cold = Window.partitionBy(*part_keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, frame_end)
    cold_out = cold
    for a in aggs:
        cold_out = cold_out.withColumn(a.name, _window_fn(Agg(a.name, a.fn, a.name + "_in"), w_cold))

    hot_total = hot.agg(F.sum("_lf_n")).first()[0]
    if not hot_total:  # the log changed since the count: no key is hot now
        return _finish(cold_out, keys, aggs)
    parts = max(2, 2 * math.ceil(hot_total / limit))
    ranged = (base.join(hot_side, part_keys, "left_semi")
              .repartitionByRange(parts, *[F.col(k) for k in part_keys], *order_cols)
              .withColumn(_SUB, F.spark_partition_id()))
    # checkpointed: the windows and the carries below must see the same sub-range ids, even
    # if an executor is lost (re-planning the range exchange could draw other bounds)
    split = materialize(ranged, reliable=True)

    w = Window.partitionBy(*part_keys, _SUB).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, frame_end)
    local = split
    for a in aggs:
        local = local.withColumn(a.name + "_loc", _window_fn(Agg(a.name, a.fn, a.name + "_in"), w))

    # --- carries: totals of earlier sub-ranges of the same key (≤ parts rows) ---------
    order_struct = F.struct(*order_cols)
    seg = split.groupBy(*part_keys, _SUB).agg(*[_group_fn(a, order_struct).alias(a.name + "_seg") for a in aggs])
    wc = Window.partitionBy(*part_keys).orderBy(_SUB).rowsBetween(Window.unboundedPreceding, -1)
    carry = seg.select(*part_keys, _SUB, *[_prefix_fn(a, wc).alias(a.name + "_carry") for a in aggs])
    out = bounded_join(local, carry, [*part_keys, _SUB], "left", small_rows=parts)
    for a in aggs:
        out = out.withColumn(a.name, _combine(a, F.col(a.name + "_carry"), F.col(a.name + "_loc")))
    hot_out = out.drop(_SUB, *[a.name + "_loc" for a in aggs], *[a.name + "_carry" for a in aggs])
    return _finish(cold_out.unionByName(hot_out), keys, aggs)


def _finish(out: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    drop = [a.name + "_in" for a in aggs]
    if not keys:
        drop.append(_KEY)
    return out.drop(*drop)


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal",
            max_rows: int | None = None, total_rows: int | None = None) -> DataFrame:
    """1-based position of each row within its key (row_number), hot keys split."""
    return running(df, keys, order, [Agg(name, "count")], True, max_rows, total_rows)


#: Rows per range of a global rank, so that small tables aren't cut into tiny ranges.
RANGE_ROWS = 50_000


def _offsets(counts: DataFrame) -> DataFrame:
    """(_lf_p, _lf_offset): rows in earlier ranges, from one row (_lf_pid, _lf_c) per range."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            c = np.asarray(batch.column("_lf_c"))
            ends = before + np.cumsum(c)
            yield pa.RecordBatch.from_arrays([batch.column("_lf_pid"), pa.array(ends - c)], names=["_lf_p", "_lf_offset"])
            before = int(ends[-1]) if len(ends) else before

    return counts.coalesce(1).sortWithinPartitions("_lf_pid").mapInArrow(total, "_lf_p int, _lf_offset long")


def global_rank(df: DataFrame, order: list[str], name: str = "rank",
                max_rows: int | None = None, total_rows: int | None = None) -> DataFrame:
    """CV-0: 0-based position in a total order over the whole table.

    A distributed sort at any size: Spark's range partitioning (sampled bounds on the whole order tuple, so
    ties in a leading column such as a class label still split), a sort within each range, and
    ``rank = rows in earlier ranges + position``; the offsets are a table of one row per range, joined on the range's
    number.  The counts and the positions come from the same pinned table: beyond the per-task cap it is checkpointed
    into the shared checkpoint folder; up to it, it is cached (its order is total and its ranges' bounds are drawn
    once, so a lost block is computed to the same positions)."""
    limit = max_rows or max_rows_per_task(df)
    n = total_rows if total_rows is not None else df.count()
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2, 2 * math.ceil(n / limit), min(cores, math.ceil(n / RANGE_ROWS)))
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    tagged = materialize(ranged.withColumn("_lf_pid", F.spark_partition_id())
                         .withColumn("_lf_pos", F.monotonically_increasing_id()), reliable=n > limit)
    offsets = F.broadcast(_offsets(tagged.groupBy("_lf_pid").agg(F.count(F.lit(1)).alias("_lf_c"))))  # one row per range
    local = F.col("_lf_pos") - F.shiftleft(F.col("_lf_pid").cast("long"), 33)
    return tagged.join(offsets, F.col("_lf_pid") == F.col("_lf_p")).withColumn(
        name, F.col("_lf_offset") + local).drop("_lf_pid", "_lf_pos", "_lf_p", "_lf_offset")
