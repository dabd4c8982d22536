"""TRC-1..4 trace spans, RUN-1/2 tracking runs, VER-1 version labels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakfree.functions.parse import parse_cv_summary
from leakfree.operators.metrics import names_of
from leakfree.operators.ordered import ordinal
from leakfree.session import materialize

COMP = "competition"


def markers(spans: DataFrame) -> DataFrame:
    """TRC-1: run markers (status MARKER, ``run:*``, zero duration) and the run boundary
    (first marker) of each trace."""
    m = spans.where((F.col("status") == "MARKER") & F.col("name").startswith("run:"))
    return m.groupBy("trace_id").agg(F.min_by(F.struct("span_id", "name", "ts"), F.struct("ts", "span_id")).alias("m"),
                                     F.count(F.lit(1)).alias("n_markers")) \
        .select("trace_id", "m.span_id", "m.name", "n_markers")


def work_spans(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("status") != "MARKER")


#: Rows that a task of ``resolve_tree`` holds at a time (a larger trace is cut, its pointers meet in the rounds of joins).
HELD_ROWS = 500_000


def _follow(t: pa.Table) -> pa.RecordBatch:
    """Pointers of spans after following the links among the rows of one table, doubling until they leave it.  A link to a span that
    comes more than once (``copies``) is not followed, nor is a cycle."""
    col = {c: pa.concat_arrays(t[c].chunks) for c in t.column_names}
    n, span, parent = len(t), col["span_id"], col["parent_span_id"]
    codes = pa.concat_arrays([span, parent]).dictionary_encode()
    k = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    trace = col["trace_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    key, up = (trace * len(codes.dictionary) + x for x in (k[:n], k[n:]))
    rows = np.flatnonzero((col["copies"].to_numpy(zero_copy_only=False) == 1) & (trace >= 0) & (k[:n] >= 0))
    rows = rows[np.argsort(key[rows])]
    at = np.searchsorted(key[rows], up)
    linked = (k[n:] >= 0) & (trace >= 0) & (at < len(rows))
    linked[linked] = key[rows[at[linked]]] == up[linked]
    end, steps = np.arange(n), linked.astype(np.int64)
    end[linked] = rows[at[linked]]
    for _ in range(n.bit_length() + 1):
        after = end[end]
        if (after == end).all():
            break
        steps += steps[end]
        end = after
    cycle = linked[end]
    end, steps = np.where(cycle, np.arange(n), end), np.where(cycle, 0, steps)
    end = pa.array(end)
    up = parent.take(end)
    root = up.is_null()
    steps += ~root.to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays(
        [col["trace_id"], span, up, pa.array(steps, pa.int32()), pc.if_else(root, span.take(end), pa.scalar(None, span.type))],
        ["trace_id", "span_id", "up", "steps", "root_span_id"])


def _follow_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= most:
            yield _follow(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _follow(pa.Table.from_batches(held))


def _pointers(inner: DataFrame) -> DataFrame:
    """Each inner span's farthest ancestor (``up``, ``steps``) that a task finds among the rows it holds, or its root.  Rows of a trace
    lie together; a large trace is split over tasks."""
    ids = [T.StructField(c, inner.schema["span_id"].dataType) for c in ("span_id", "up", "root_span_id")]
    schema = T.StructType([inner.schema["trace_id"], ids[0], ids[1], T.StructField("steps", T.IntegerType()), ids[2]])
    return inner.hint("rebalance", "trace_id").sortWithinPartitions("trace_id").select(
        "trace_id", "span_id", "parent_span_id", "copies").mapInArrow(partial(_follow_batches, most=HELD_ROWS), schema)


def resolve_tree(spans: DataFrame) -> DataFrame:
    """TRC-2: depth and root of every span, by pointer doubling over parent links.

    Only spans with children need pointers.  Each holds an ancestor and the steps to it.  Tasks first follow the links among
    the rows they hold, which resolves traces that lie whole in a task.  For the rest a round replaces the
    ancestor by the ancestor's ancestor (one join), so the steps double and a tree of depth d takes at most
    log2(d) rounds.  Spans whose pointer has reached a root leave the input, and spans without children (most)
    take part in one last join only.  A span whose ancestors end in a missing parent or in a
    cycle of links has depth null."""
    s = materialize(work_spans(spans).select("trace_id", "span_id", "parent_span_id"))
    kids = s.where(F.col("parent_span_id").isNotNull()).select(
        F.col("trace_id").alias("_t"), F.col("parent_span_id").alias("_s")).distinct().withColumn("_inner", F.lit(True))
    s = materialize(s.join(kids, (F.col("trace_id") == F.col("_t")) & (F.col("span_id") == F.col("_s")), "left").select(
        "trace_id", "span_id", "parent_span_id", F.col("_inner").isNotNull().alias("inner"),
        F.count(F.lit(1)).over(Window.partitionBy("trace_id", "span_id")).alias("copies")), reliable=True)
    inner = s.where("inner")
    is_root = F.col("parent_span_id").isNull()
    none = F.lit(None)
    if inner.where(~is_root).isEmpty():  # children of roots only
        near = inner.select("trace_id", "span_id", F.col("parent_span_id").alias("up"), F.lit(0).alias("steps"), F.col("span_id").alias("root_span_id"))
    else:
        near = materialize(_pointers(inner), reliable=True)
    done = near.where("root_span_id IS NOT NULL").select("trace_id", "span_id", F.col("steps").alias("depth"), "root_span_id")
    todo = near.where("root_span_id IS NULL").select("trace_id", "span_id", "up", "steps")
    lost, left = [], todo.count()
    rounds = math.ceil(math.log2(left + 1)) + 1  # a tree is no deeper than its spans: what is left then is a cycle
    while left and rounds:
        rounds -= 1
        held = done.select("trace_id", "span_id", "depth", "root_span_id", none.cast("string").alias("up"), none.cast("int").alias("steps")).unionByName(
            todo.select("trace_id", "span_id", none.cast("int").alias("depth"), none.cast("string").alias("root_span_id"), "up", "steps"))
        on = (F.col("c.trace_id") == F.col("p.trace_id")) & (F.col("c.up") == F.col("p.span_id"))
        hop = materialize(todo.alias("c").join(held.alias("p"), on, "left").select(
            "c.trace_id", "c.span_id", "p.up", (F.col("c.steps") + F.col("p.steps")).alias("steps"),
            (F.col("c.steps") + F.col("p.depth")).alias("depth"), "p.root_span_id"), reliable=True)
        arrived = F.col("root_span_id").isNotNull()
        done = done.unionByName(hop.where(arrived).select("trace_id", "span_id", "depth", "root_span_id"))
        lost.append(hop.where(~arrived & F.col("up").isNull()).select("trace_id", "span_id"))
        todo = hop.where(~arrived & F.col("up").isNotNull()).select("trace_id", "span_id", "up", "steps")
        left = todo.count()
    unresolved = todo.select("trace_id", "span_id")
    for part in lost:
        unresolved = unresolved.unionByName(part)
    nowhere = (none.cast("int").alias("depth"), none.cast("string").alias("root_span_id"))
    outer = s.where("NOT inner")
    leaves = outer.where(~is_root).alias("c").join(
        done.alias("p"), (F.col("c.trace_id") == F.col("p.trace_id")) & (F.col("c.parent_span_id") == F.col("p.span_id")), "left").select(
        "c.trace_id", "c.span_id", (F.col("p.depth") + 1).alias("depth"), "p.root_span_id")
    alone = outer.where(is_root).select("trace_id", "span_id", F.lit(0).alias("depth"), F.col("span_id").alias("root_span_id"))
    return done.unionByName(leaves).unionByName(alone).unionByName(unresolved.select("trace_id", "span_id", *nowhere))


def rollup_by_name(spans: DataFrame) -> DataFrame:
    """TRC-3: count, errors (status ERROR or an ``error`` attribute), duration totals and
    token sums per span name."""
    w = work_spans(spans)
    err = (F.col("status") == "ERROR") | F.coalesce(F.map_contains_key("attributes", F.lit("error")), F.lit(False))
    return w.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_spans"), F.count_if(err).alias("n_errors"),
        F.sum("duration_ns").alias("total_ns"), F.avg("duration_ns").alias("avg_ns"),
        F.max("duration_ns").alias("max_ns"),
        F.sum(F.col("attributes")["usage.input_tokens"].try_cast("long")).alias("input_tokens"),
        F.sum(F.col("attributes")["usage.output_tokens"].try_cast("long")).alias("output_tokens"))


def self_time(spans: DataFrame) -> DataFrame:
    """TRC-4: duration minus the summed duration of direct children."""
    w = work_spans(spans)
    kids = (w.where(F.col("parent_span_id").isNotNull())
            .groupBy("trace_id", F.col("parent_span_id").alias("span_id"))
            .agg(F.sum("duration_ns").alias("children_ns"), F.count(F.lit(1)).alias("n_children")))
    j = w.join(kids, ["trace_id", "span_id"], "left")
    return j.select("trace_id", "span_id", "name", "duration_ns",
                    F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    (F.col("duration_ns") - F.coalesce("children_ns", F.lit(0))).alias("self_ns"))


def cv_runs(journal: DataFrame) -> DataFrame:
    """RUN-1: one tracking row per successful train_cv call, numbered per competition
    (only successes consume a number), with version labels (VER-1)."""
    ok = journal.where((F.col("kind") == "tool_call") & (F.col("tool") == "train_cv"))
    p = ok.select(COMP, "seq", parse_cv_summary(F.col("result_summary")).alias("p"))
    p = p.where(F.col("p.mean").isNotNull())
    numbered = ordinal(p, [COMP], ["seq"], "run_no")
    return numbered.select(
        COMP, "run_no", "seq", F.col("p.strategy").alias("cv_strategy"), F.col("p.n_splits").alias("n_splits"),
        F.col("p.metric").alias("metric"), F.col("p.mean").alias("cv_mean"), F.col("p.std").alias("cv_std"),
        F.col("p.duration_s").alias("wall_clock_s"), F.col("p.fold_scores").alias("fold_scores"),
        problem_type(F.col("p.metric")).alias("problem_type"),
        version_label("fe", F.col("run_no")).alias("fe_version"),
        version_label("model", F.col("run_no")).alias("model_version")).dropDuplicates([COMP, "run_no"])


def problem_type(metric: Column) -> Column:
    """Kind of the metric in the registry (unknown or missing: regression)."""
    return F.when(metric.isin(*names_of("classification")), F.lit("classification")).otherwise(F.lit("regression"))


def fold_metrics(runs: DataFrame) -> DataFrame:
    """RUN-2: fold scores in long form (``fold_i`` metrics)."""
    return runs.select(COMP, "run_no", F.posexplode("fold_scores").alias("fold", "score"))


#: What is versioned, and its label.
VERSIONED = ("fe", "model")


def _versioned(kind: str) -> str:
    if kind not in VERSIONED:
        raise ValueError(f"nothing called {kind!r} has versions, only {', '.join(VERSIONED)}")
    return kind


def version_label(kind: str, n) -> Column:
    kind = _versioned(kind)
    return F.format_string(f"{kind}_v%02d", n)


def next_version(files: DataFrame, kind: str, by: list[str] | None = None, name: str = "name") -> DataFrame:
    """VER-1: ``max(NN)+1`` over ``<kind>_vNN.py`` names (gaps kept, other names ignored,
    none → 1)."""
    kind = _versioned(kind)
    by = by or []
    n = F.regexp_extract(F.col(name), rf"^{kind}_v(\d+)\.py$", 1)
    v = F.max(F.nullif(n, F.lit("")).cast("int"))
    agg = (files.groupBy(*by).agg(v.alias("_mx")) if by else files.agg(v.alias("_mx")))
    return agg.select(*by, (F.coalesce(F.col("_mx"), F.lit(0)) + 1).alias(f"next_{kind}"))
