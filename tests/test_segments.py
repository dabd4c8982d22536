"""Folds by composed functions, pointer doubling and scans of clamps against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leakfree.operators import journal as jr, ledger as led, metrics as met, trace as trc


def _resets(times, limit):
    clock, n = times[0], 0
    for t in times:
        if t - clock > limit:
            clock, n = t, n + 1
    return n


@pytest.mark.parametrize("chunk", [1, 3, 100_000])
def test_wall_clock_extensions_equal_a_walk(spark, chunk):
    r = random.Random(chunk)
    rows, want = [], {}
    for key in ["a", "b", "c", "d", None]:
        gaps = {"a": 50, "b": 2000, "c": 901, "d": 300}.get(key, 450)
        at, times = 0.0, []
        for _ in range(400 if key == "a" else 60):
            at += r.choice([0, r.random() * gaps, 2 * r.random() * gaps])
            times.append(at)
        rows += [(key, i, t) for i, t in enumerate(times)]
        want[key] = _resets(times, 900.0)
    rows.append(("never", 0, None))
    want["never"] = 0
    df = spark.createDataFrame(rows, "competition string, seq long, ts_s double").repartition(3)
    got = {x.competition: x.extensions for x in led.wall_clock_extensions(df, 900.0, chunk=chunk).collect()}
    assert got == want


def test_functions_of_stretches_compose():
    import numpy as np
    r = random.Random(5)
    for _ in range(200):
        times = sorted(r.random() * r.choice([5, 50]) for _ in range(r.randint(1, 40)))
        cuts = sorted(r.randint(1, len(times)) for _ in range(3))
        parts = [p for p in (times[a:b] for a, b in zip([0, *cuts], [*cuts, len(times)])) if p]
        whole = led._then([led._restarts(np.array(p), 1.0) for p in parts], 1.0)
        after = [n for t, n in zip(whole["ts"], whole["n"]) if t > whole["head"] + 1.0]
        assert (after[0] if after else 0) == _resets(times, 1.0)


def test_deep_chains_take_log_rounds(spark):
    rows = [("t", f"s{i}", None if i == 0 else f"s{i - 1}") for i in range(1000)]
    rows += [("t", "leaf", "s999"), ("u", "s5", "s6"), ("u", "s6", "s5"), ("u", "tail", "s5"), ("u", "lost", "gone"), ("u", "alone", None),
             ("u", "under", "lost")]
    df = spark.createDataFrame([(*x, "OK") for x in rows], "trace_id string, span_id string, parent_span_id string, status string")
    got = {(x.trace_id, x.span_id): (x.depth, x.root_span_id) for x in trc.resolve_tree(df).collect()}
    assert len(got) == len(rows)
    assert all(got["t", f"s{i}"] == (i, "s0") for i in range(1000)) and got["t", "leaf"] == (1000, "s0")
    assert got["u", "alone"] == (0, "alone")
    assert all(got["u", x] == (None, None) for x in ("s5", "s6", "tail", "lost", "under"))


def test_traces_that_a_task_holds_take_no_joins(spark, monkeypatch):
    """Chains in one task resolve without a round; cut anywhere, they resolve in rounds."""
    rows = [(f"t{i // 200}", f"s{i}", None if i % 200 == 0 else "gone" if i == 500 else f"s{i - 1}") for i in range(1000)]
    rows += [("x", "a", "b"), ("x", "b", "a"), ("x", "c", "a"), ("x", "own", "own")]
    want = {(t, s): (None, None) if t == "x" or 500 <= int(s[1:]) < 600 else (int(s[1:]) % 200, f"s{int(s[1:]) // 200 * 200}") for t, s, _ in rows}
    df = spark.createDataFrame([(*x, "OK") for x in rows], "trace_id string, span_id string, parent_span_id string, status string")
    inner = df.where("trace_id <> 'x'").withColumn("copies", F.lit(1).cast("long"))
    near = trc._pointers(inner).collect()
    assert sum(r.root_span_id is not None for r in near) == 900 and all(r.up == "gone" for r in near if r.root_span_id is None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    for held in (500_000, 7):
        monkeypatch.setattr(trc, "HELD_ROWS", held)
        got = trc.resolve_tree(df).collect()
        assert len(got) == len(rows) and {(x.trace_id, x.span_id): (x.depth, x.root_span_id) for x in got} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_that_come_twice_resolve_for_each_copy(spark):
    rows = [("t", "r", None), ("t", "a", "r"), ("t", "a", "r"), ("t", "b", "a"), ("t", "c", "b"), ("t", "leaf", "c")]
    df = spark.createDataFrame([(*x, "OK") for x in rows], "trace_id string, span_id string, parent_span_id string, status string")
    got = sorted((x.span_id, x.depth) for x in trc.resolve_tree(df).collect())
    assert got == [("a", 1)] * 2 + [("b", 2)] * 2 + [("c", 3)] * 2 + [("leaf", 4)] * 2 + [("r", 0)]


def test_random_forests(spark):
    r = random.Random(2)
    parent = {i: None if i < 5 else r.randrange(max(0, i - 20), i) for i in range(600)}
    df = spark.createDataFrame([("t", str(i), None if p is None else str(p), "OK") for i, p in parent.items()],
                               "trace_id string, span_id string, parent_span_id string, status string")
    for x in trc.resolve_tree(df).collect():
        at, depth = int(x.span_id), 0
        while parent[at] is not None:
            at, depth = parent[at], depth + 1
        assert (x.depth, x.root_span_id) == (depth, str(at))


@pytest.mark.parametrize("chunk", [4, 100_000])
def test_every_best_of_mixed_runs(spark, chunk):
    r = random.Random(chunk)
    recs, want = [], {}
    for comp in range(4):
        best = None
        for i in range(1, 60):
            hib, x = r.random() < 0.5, round(r.random(), 2)
            recs.append((comp, i, hib, x))
            new = x if best is None else max(best, x) if hib else min(best, x)
            want[comp, i] = (new, best is None or new != best)
            best = new
    df = spark.createDataFrame(recs, "competition long, ordinal long, hib boolean, mean double")
    got = {(x.competition, x.ordinal): (x.best_after, x.improved) for x in jr.mixed_running_best(df, chunk).collect()}
    assert got == want


def test_registered_metrics_have_their_direction_everywhere(spark):
    """A metric beside the six: journal, gate and calibration take its direction from the registry."""
    from leakfree.operators import gate
    from leakfree.streaming import alarms
    from leakfree.streaming.late import drain
    met.register(met.Metric("pinball_10", False, False, "regression", column=met.pinball(0.1)), optional=True)
    for name in ("rmsle", "pinball_10"):
        means = [0.9, 0.2, 0.5]
        rows = [(1, i, "tool_call", "train_cv", f"train_cv complete: kfold (5 folds), metric={name}, mean={m}, std=0.0", "{}")
                for i, m in enumerate(means)]
        j = spark.createDataFrame(rows, "competition long, seq long, kind string, tool string, result_summary string, args string")
        assert jr.best_score(j).first().best_cv_mean == 0.2
        assert [x.best_cv_mean for x in gate.running_best(j).orderBy("seq").collect()] == [None, 0.9, 0.2]
        s = spark.createDataFrame([(1, i, m, name) for i, m in enumerate(means)], "competition long, seq long, cv_at_submit double, metric string")
        want = [gate.FIRST, gate.NON_REGRESSION, gate.REGRESSION]
        assert [x.trigger for x in gate.classify_submissions(s).orderBy("seq").collect()] == want
        import tempfile
        path = tempfile.mkdtemp(prefix="lf-dir-", dir="/tmp")
        s.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(s.schema).parquet(f"{path}/in")
        got = drain(stream, "dir", alarms.submission_gate(s.schema)).output(["competition", "seq"]).orderBy("seq").collect()
        assert [x.trigger for x in got] == want
