import os
import tempfile

from pyspark.sql import functions as F

from leakfree.sources import io
from leakfree.streaming import alarms
from leakfree.streaming.late import drain
from leakfree.streaming.runner import run


def test_read_log_tolerant(spark):
    d = tempfile.mkdtemp(prefix="lf-log-", dir="/tmp")
    with open(os.path.join(d, "run_log.jsonl"), "w") as f:
        f.write('{"competition": 1, "seq": 0, "kind": "tool_call", "tool": "a"}\n\n')
        f.write('{"competition": 1, "seq": 1, "kind": "tool_c\n')          # damage in the middle
        f.write('{"competition": 1, "seq": 2, "kind": "tool_call", "tool": "b"}\n')
        f.write('{"competition": 1, "seq": 3, "ki')                       # torn tail
    good, bad = io.read_log(spark, d, io.JOURNAL_SCHEMA)
    assert [r["seq"] for r in good.orderBy("seq").collect()] == [0, 2]
    assert bad.count() == 2
    g2, b2 = io.read_log_lines(spark, d, io.JOURNAL_SCHEMA)
    assert sorted(r["seq"] for r in g2.collect()) == [0, 3] and b2.count() == 2   # line ordinals
    g3, b3 = io.read_log(spark, d + "/missing", io.JOURNAL_SCHEMA)
    assert g3.count() == 0 and b3.count() == 0


def test_retain_latest(spark):
    df = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 0)], "g long, t long")
    out = io.retain_latest(df, ["g"], "t", 20)
    assert out.where("g = 1").agg(F.min("t")).first()[0] == 10 and out.count() == 21


def test_stream_gate_equals_batch(spark):
    from leakfree.operators import gate
    rows = [(c, i, None if (i * c) % 5 == 0 else float((i * 7 + c) % 10), "accuracy" if c % 2 else "rmse")
            for c in range(4) for i in range(25)]
    df = spark.createDataFrame(rows, "competition long, seq long, cv_at_submit double, metric string")
    d = tempfile.mkdtemp(prefix="lf-src-", dir="/tmp")
    from leakfree.streaming.runner import stage
    stage(df, d, "competition", "seq")
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(d)
    got = drain(sdf, "gate-test", alarms.submission_gate(sdf.schema)).output(["competition", "seq"]).select("competition", "seq", "trigger")
    want = gate.classify_submissions(df).select("competition", "seq", "trigger")
    assert sorted(got.collect()) == sorted(want.collect())


def test_keyed_state_ignores_replayed_records(spark):
    """A source that delivers the same records again (after a restart) must not change the
    budget alarm: a row's competition and seq tell that it has been taken."""
    from leakfree.operators import ledger as led
    from leakfree.streaming.runner import stage
    rows = [(c, i, 0.004 * ((i * 7 + c) % 5)) for c in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "competition long, seq long, cost_usd double")
    d = tempfile.mkdtemp(prefix="lf-replay-", dir="/tmp")
    stage(df, d, "competition", "seq")
    # replay: the first half of every competition arrives once more, later
    df.where("seq < 15").repartition(2, "competition").write.mode("append").parquet(d)
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(d)
    got = alarms.budget_alarms(drain(sdf, "replay", alarms.budget_alarm(sdf.schema, 0.01)), 0.01)
    got = {r["competition"]: r["doublings"] for r in got.collect()}
    want = {r["competition"]: r["doublings"] for r in led.budget_doublings(df, 0.01).collect()}
    assert got == want


def test_competition_catalog_layouts(spark):
    paths = spark.createDataFrame([("/w/titanic/agent/run_log.jsonl",), ("/w/titanic/raw/train.csv",),
                                   ("/w/house/raw/train.csv",), ("/w/ws=spaceship/area=agent/p.parquet",),
                                   ("/w/agentless/notes/agent.txt",)], "path string")
    got = [r[0] for r in io.competition_catalog(paths).collect()]
    assert got == ["spaceship", "titanic"]


def test_calibration_nan_parses(spark):
    """A calibration line written with a literal NaN (no CV before the submit) parses to NaN."""
    from pyspark.sql import types as T
    d = tempfile.mkdtemp(prefix="lf-cal-", dir="/tmp")
    with open(os.path.join(d, "calibration.jsonl"), "w") as f:
        f.write('{"seq": 0, "competition": "c", "cv_score": NaN, "lb_score": null, "metric": "auc"}\n')
        f.write('{"seq": 1, "competition": "c", "cv_score": 0.81, "lb_score": null, "metric": "auc"}\n')
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("competition", T.StringType()),
                           T.StructField("cv_score", T.DoubleType()), T.StructField("lb_score", T.DoubleType()),
                           T.StructField("metric", T.StringType())])
    good, bad = io.read_log(spark, d, schema)
    rows = {r["seq"]: r["cv_score"] for r in good.collect()}
    assert bad.count() == 0 and rows[1] == 0.81 and rows[0] != rows[0]   # NaN


def test_read_log_lines_crlf(spark):
    d = tempfile.mkdtemp(prefix="lf-crlf-", dir="/tmp")
    with open(os.path.join(d, "log.jsonl"), "w", newline="") as f:
        f.write('{"competition": 1, "kind": "tool_call", "tool": "a"}\r\n\r\n{"competition": 1, "kind": "tool_error"}\r\n')
    good, bad = io.read_log_lines(spark, d, io.JOURNAL_SCHEMA)
    assert sorted(r["seq"] for r in good.collect()) == [0, 2] and bad.count() == 0


def test_read_log_fills_partition_column(spark):
    d = tempfile.mkdtemp(prefix="lf-part-", dir="/tmp")
    os.makedirs(os.path.join(d, "competition=5"))
    with open(os.path.join(d, "competition=5", "run_log.jsonl"), "w") as f:
        f.write('{"seq": 0, "kind": "tool_call", "tool": "a"}\n{"seq": 1, "kind": "tool_c\n')
    good, bad = io.read_log(spark, d, io.JOURNAL_SCHEMA)
    rows = good.collect()
    assert [(r["competition"], r["seq"]) for r in rows] == [("5", 0)] and bad.count() == 1


def test_named_competitions_round_trip(spark):
    d = tempfile.mkdtemp(prefix="lf-named-", dir="/tmp")
    rows = [("titanic", 0, "tool_call", "a"), ("house-prices", 1, "tool_error", "b"), ("7", 2, "tool_call", "c")]
    df = spark.createDataFrame(rows, "competition string, seq long, kind string, tool string")
    io.append_log(df, d + "/parts")
    good, bad = io.read_log(spark, d + "/parts", io.JOURNAL_SCHEMA)
    assert sorted(map(tuple, good.select("competition", "seq", "kind", "tool").collect())) == sorted(rows) and bad.count() == 0
    io.append_log(df, d + "/flat", partition_by=None)
    good, bad = io.read_log(spark, d + "/flat", io.JOURNAL_SCHEMA)
    assert sorted(r["competition"] for r in good.collect()) == ["7", "house-prices", "titanic"] and bad.count() == 0


def test_line_numbers_of_a_file_that_many_tasks_read(spark):
    d = tempfile.mkdtemp(prefix="lf-split-", dir="/tmp")
    lines = [f'{{"competition": "c{i % 3}", "kind": "tool_call", "tool": "t{i}"}}' if i % 7 else "" for i in range(3000)]
    lines[11] = lines[11][:20]
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        f.write("\n".join(lines))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "8k")
    try:
        good, bad = io.read_log_lines(spark, d, io.JOURNAL_SCHEMA)
        assert spark.read.text(d).rdd.getNumPartitions() > 8
        got = {r["seq"]: r["tool"] for r in good.collect()}
        assert got == {i: f"t{i}" for i in range(3000) if i % 7 and i != 11}
        assert [r["seq"] for r in bad.collect()] == [11]
    finally:
        spark.conf.set(key, before)


def _parts(d):
    return [os.path.join(top, f) for top, _, names in os.walk(d) for f in names if f.startswith("part-")]


def test_a_partitioned_log_has_few_files_for_many_keys(spark):
    d = tempfile.mkdtemp(prefix="lf-keys-", dir="/tmp")
    df = spark.range(3000).select((F.col("id") % 1000).alias("competition"), F.col("id").alias("seq")).unionByName(
        spark.createDataFrame([(None, 3000)], "competition long, seq long"))
    for fmt in ("json", "parquet"):
        io.append_log(df.where("seq % 2 = 0"), f"{d}/{fmt}", fmt=fmt)
        io.append_log(df.where("seq % 2 = 1"), f"{d}/{fmt}", fmt=fmt)
        assert len([x for x in os.listdir(f"{d}/{fmt}") if "=" in x]) <= io.BUCKETS and len(_parts(f"{d}/{fmt}")) <= 4 * io.BUCKETS
        back = spark.read.schema(df.schema).format(fmt).load(f"{d}/{fmt}")
        assert sorted(map(tuple, back.select("competition", "seq").collect()), key=lambda x: x[1]) == [
            (i % 1000 if i < 3000 else None, i) for i in range(3001)]


def test_one_key_of_a_partitioned_log_reads_one_directory(spark):
    d = tempfile.mkdtemp(prefix="lf-only-", dir="/tmp")
    df = spark.range(2000).select((F.col("id") % 500).alias("competition"), F.col("id").alias("seq"))
    io.append_log(df, d, fmt="parquet")
    one = io.only(spark.read.parquet(d), "competition", 7)
    assert one.columns == ["competition", "seq"] and sorted(map(tuple, one.collect())) == [(7, i) for i in (7, 507, 1007, 1507)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(competition_bucket" in plan


def test_packed_workspaces_have_few_files(spark):
    d = tempfile.mkdtemp(prefix="lf-pack-", dir="/tmp")
    rows = [(f"w{i}", "agent" if i % 3 else "raw", j) for i in range(600) for j in range(2)]
    io.pack_workspaces(spark.createDataFrame(rows, "ws string, area string, seq long"), d)
    assert len(_parts(d)) <= 2 * io.BUCKETS and spark.read.parquet(d).count() == 1200
    files = io.packed_files(spark, d)
    assert files.count() == 600
    assert [r[0] for r in io.competition_catalog(files).collect()] == sorted(f"w{i}" for i in range(600) if i % 3)


def test_line_numbers_run_through_the_parts_of_one_log(spark):
    d = tempfile.mkdtemp(prefix="lf-parts-", dir="/tmp")
    for part in range(4):
        with open(os.path.join(d, f"part-{part}.jsonl"), "w") as f:
            f.writelines(f'{{"competition": "c", "tool": "t{i}"}}\n' if i % 10 else "\n" for i in range(part * 500, part * 500 + 500))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        good, bad = io.read_log_lines(spark, d, io.JOURNAL_SCHEMA, one_log=True)
        assert {r["seq"]: r["tool"] for r in good.collect()} == {i: f"t{i}" for i in range(2000) if i % 10} and bad.count() == 0
    finally:
        spark.conf.set(key, before)


def test_a_large_log_is_written_by_many_tasks(spark, monkeypatch):
    from leakfree.plans import q_misc
    j = spark.range(4000).select((F.col("id") % 7).alias("competition"), F.col("id").alias("seq"), F.lit("t").alias("ts"))
    paths = []
    monkeypatch.setattr(q_misc, "journal", lambda *_: j)
    monkeypatch.setattr(q_misc, "scratch", lambda *_: paths.append(tempfile.mkdtemp(prefix="lf-one-", dir="/tmp") + "/log") or paths[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = q_misc.q_src3o(spark, "")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(_parts(paths[0])) > 1
    order = sorted(range(4000), key=lambda i: (i % 7, i))
    want = {n: -1 if i % 97 == 0 else i for n, i in enumerate(order) if i % 89}
    assert {r["line"]: r["journal_seq"] for r in out.collect()} == want
