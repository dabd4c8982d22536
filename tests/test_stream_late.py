"""Streams whose rows arrive out of order, late and more than once equal their batch twins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leakfree.operators import gate, journal as jr, ledger
from leakfree.streaming import alarms
from leakfree.streaming.late import LateFold, drain
from leakfree.streaming.runner import run

SCHEMA = "competition string, seq long, cost_usd double, cv_at_submit double, metric string, kind string, tool string, args string"


def _rows(seed=3, keys=("titanic", "house", None), n=40):
    r = random.Random(seed)
    return [(c, i, r.choice([None, 0.01, 0.02, 0.5]), r.choice([None, r.random()]), "auc" if c == "titanic" else "rmse",
             r.choice(["tool_call", "tool_call", "tool_error", "checkpoint"]), r.choice(["train_cv", "run_python"]), f'{{"x":{r.randint(0, 1)}}}')
            for c in keys for i in range(n)]


def _source(spark, path, batches):
    """One file per micro-batch, in the given order of arrival."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")


def _orders(rows):
    third = len(rows) // 3
    shuffled = random.Random(8).sample(rows, len(rows))
    return {"backwards": [rows[::-1][i:i + third] for i in range(0, len(rows), third)],
            "shuffled": [shuffled[i:i + third] for i in range(0, len(rows), third)],
            "replayed": [shuffled[:70], shuffled[30:90], shuffled[85:]]}


@pytest.mark.parametrize("order", ["backwards", "shuffled", "replayed"])
def test_late_rows_equal_the_batch_twin(spark, tmp_path, order):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    sdf = _source(spark, str(tmp_path / "in"), _orders(rows)[order])

    cost = sdf.select("competition", "seq", "cost_usd")
    got = alarms.budget_alarms(drain(cost, "late3", alarms.budget_alarm(cost.schema, 0.3)), 0.3)
    want = ledger.budget_state(df, 0.3).collect()
    for a, b in zip(*(sorted(x, key=str) for x in (got.select("competition", "spent", "doublings", "breach_seq").collect(), want))):
        assert (a.competition, a.doublings, a.breach_seq) == (b.competition, b.doublings, b.breach_seq)
        assert a.spent == pytest.approx(b.spent)
    assert got.count() == len(want)

    subs = sdf.select("competition", "seq", "cv_at_submit", "metric")
    cols = ["competition", "seq", "trigger", "prev_best"]
    got = drain(subs, "late5", alarms.submission_gate(subs.schema)).output(["competition", "seq"]).select(*cols)
    assert sorted(got.collect(), key=str) == sorted(gate.classify_submissions(df).select(*cols).collect(), key=str)

    cols = ["competition", "tool", "args", "repeats", "stuck"]
    got = run(alarms.stuck_loop_alarm(sdf), "late4", ["competition"], "update").select(*cols)
    assert sorted(got.where("tool IS NOT NULL").collect(), key=str) == sorted(jr.stuck_loop(df).select(*cols).collect(), key=str)


def test_ten_rows_with_the_older_file_second(spark, tmp_path):
    rows = [("c", i, 1.0, None, "auc", "tool_call", "t", "{}") for i in range(10)]
    sdf = _source(spark, str(tmp_path / "in"), [rows[5:], rows[:5]]).select("competition", "seq", "cost_usd")
    got = alarms.budget_alarms(drain(sdf, "ten", alarms.budget_alarm(sdf.schema, 2.5)), 2.5).first()
    assert (got.spent, got.breach_seq) == (10.0, 2)


def test_rows_beyond_the_retention_are_counted(spark, tmp_path):
    rows = [("c", i, 1.0, None, "auc", "tool_call", "t", "{}") for i in range(10)]
    sdf = _source(spark, str(tmp_path / "in"), [rows[8:], rows[:8]]).select("competition", "seq", "cost_usd")
    fold = drain(sdf, "old", alarms.budget_alarm(sdf.schema, 100.0, retain=4))
    assert fold.expired().collect() == [("c", 5)]  # 0..4 lie more than 4 behind 9
    assert alarms.budget_alarms(fold, 100.0).first().spent == 5.0


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame(_rows(), SCHEMA).select("competition", "seq", "cost_usd")
    fold = alarms.budget_alarm(rows.schema, 0.3)(spark, str(tmp_path / "fold"))
    parts = [rows.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i) for i in range(3)]
    for i, part in enumerate(parts):
        fold.absorb(part, i)
        before = sorted(fold.states().collect(), key=str)
        fold.absorb(part, i)  # the driver failed before it recorded the batch
        assert sorted(fold.states().collect(), key=str) == before
    want = {r.competition: r.doublings for r in ledger.budget_state(rows, 0.3).collect()}
    assert {r.competition: r.doublings for r in fold.states().collect()} == want
    assert isinstance(fold, LateFold)
