"""Keyed streaming state over one key whose rows fill several Arrow batches in any order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leakfree.operators import gate, journal as jr, ledger
from leakfree.streaming import alarms
from leakfree.streaming.late import drain
from leakfree.streaming.runner import run

ROWS = 900


@pytest.fixture()
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "100")
    yield spark
    spark.conf.set(key, before)


def _table(spark, tmp_path):
    df = spark.range(ROWS).select(
        F.lit(1).cast("long").alias("competition"), F.col("id").alias("seq"),
        (F.col("id") % 7 * 0.01).alias("cost_usd"), F.when(F.col("id") % 5 > 0, F.col("id") * 37 % 101 / 100.0).alias("cv_at_submit"),
        F.lit("auc").alias("metric"), F.lit("tool_call").alias("kind"), F.lit("run_python").alias("tool"),
        F.concat(F.lit('{"code":"'), (F.col("id") % 3).cast("string"), F.lit('"}')).alias("args"))
    path = str(tmp_path / "log")
    df.repartition(1).orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_no_row_is_lost_between_arrow_batches(small_batches, tmp_path):
    df, sdf = _table(small_batches, tmp_path)
    fold = drain(sdf.select("competition", "seq", "cost_usd"), "order3",
                 alarms.budget_alarm(sdf.select("competition", "seq", "cost_usd").schema, 0.05))
    got = alarms.budget_alarms(fold, 0.05).first()
    want = ledger.budget_doublings(df, 0.05).first()
    assert (got.doublings, got.final_budget) == (want.doublings, want.final_budget)
    assert got.spent == pytest.approx(df.agg(F.sum("cost_usd")).first()[0])

    cols = ["seq", "trigger", "prev_best"]
    subs = sdf.select("competition", "seq", "cv_at_submit", "metric")
    got = drain(subs, "order5", alarms.submission_gate(subs.schema)).output(["competition", "seq"]).select(*cols).orderBy("seq").collect()
    assert got == gate.classify_submissions(df).select(*cols).orderBy("seq").collect()

    cols = ["tool", "args", "repeats", "stuck"]
    got = run(alarms.stuck_loop_alarm(sdf), "order4", ["competition"], "update").select(*cols).collect()
    assert got == jr.stuck_loop(df).select(*cols).collect()


def test_many_tasks_write_and_read_an_append(spark, tmp_path, monkeypatch):
    """A stream's source has as many files per append as tasks run at once, and a trigger takes one append."""
    from leakfree.plans import q_stream
    monkeypatch.setattr(q_stream, "scratch", lambda *_: str(tmp_path / "log"))
    df = spark.range(8000).select((F.col("id") % 400).alias("competition"), F.col("id").alias("seq"), F.lit("tool_call").alias("kind"),
                                  F.lit("run_python").alias("tool"), (F.col("id") % 3).cast("string").alias("args"))
    sdf = q_stream._stream(spark, df, "log", late=True)
    assert len([x for x in (tmp_path / "log").iterdir() if x.name.startswith("part-")]) > 3 * 4
    cols = ["competition", "tool", "args", "repeats", "stuck"]
    got = run(alarms.stuck_loop_alarm(sdf), "many4", ["competition"], "update").select(*cols)
    assert sorted(got.collect()) == sorted(jr.stuck_loop(df).select(*cols).collect())
