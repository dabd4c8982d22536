"""Registered queries: Structured Streaming twins (STR-1..6).

Each stages its bound batch table as an append-only file source (ordered slices), drains
it with ``availableNow`` and returns the final result; the SQL oracle is the batch twin's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leakfree.plans.q_ops import DOUBLING_BUDGET
from leakfree.plans.registry import ORACLES, query
from leakfree.sources.bindings import journal, ledger, submissions
from leakfree.sources import io
from leakfree.streaming import alarms
from leakfree.streaming.late import drain
from leakfree.streaming.runner import run, scratch, stage
from leakfree.plans.sql import with_ctes


def _stream(spark, df, name: str, order: str = "seq", late: bool = False):
    """The table as a source of four appends by ``order``; ``late``: the last third by order comes first."""
    path = scratch(spark, name)
    files = max(4, spark.sparkContext.defaultParallelism)  # of an append: as many tasks write and read it
    if late:
        third = df.agg(F.expr(f"approx_percentile({order}, 0.67)")).first()[0]
        first = F.col(order) > (0 if third is None else third)
        stage(df.where(first), path, "competition", order, slices=1, files_per_slice=files)
        stage(df.where(~first), path, "competition", order, slices=2, files_per_slice=files)
    else:
        stage(df, path, "competition", order, files_per_slice=files)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("STR-1", with_ctes("""
SELECT competition, CAST(count_if(seq % 97 <> 0) AS BIGINT) AS n_good, CAST(count_if(seq % 97 = 0) AS BIGINT) AS n_bad
FROM journal WHERE seq % 89 <> 0 GROUP BY competition""", "journal"))
def q_str1(spark, sf_dir):
    """Tail a damaged JSON-lines journal as a stream: records and quarantined lines."""
    path = scratch(spark, "journal-lines")
    j = journal(spark, sf_dir).withColumn("ts", F.col("ts").cast("string"))
    line = F.to_json(F.struct(*j.columns))
    line = (F.when(F.col("seq") % 89 == 0, F.lit(""))
            .when(F.col("seq") % 97 == 0, F.substring(line, 1, F.floor(F.length(line) / 2).cast("int")))
            .otherwise(line))
    stage(j.select("competition", "seq", line.alias("line")).select("line", "seq", "competition"),
          path, "competition", "seq", fmt="parquet")
    lines = spark.readStream.schema("line string, seq long, competition long").option(
        "maxFilesPerTrigger", 4).parquet(path).select(F.col("line").alias("value"))
    good, bad = alarms.tail_log(lines, io.JOURNAL_SCHEMA)
    # records and quarantine appended to JSON logs through exactly-once file sinks
    out = scratch(spark, "journal-tail")
    for sdf, name in ((good, "records"), (bad.select(F.col(io.CORRUPT).alias("raw_line")), "quarantine")):
        io.append_log_stream(sdf, f"{out}/{name}", f"{out}/_checkpoints/{name}").awaitTermination()
    g = spark.read.schema(io.JOURNAL_SCHEMA).json(f"{out}/records")
    b = spark.read.schema("raw_line string").json(f"{out}/quarantine").select(
        F.regexp_extract("raw_line", r'"competition":(\d+)', 1).cast("long").alias("competition"))
    gc = g.groupBy(F.col("competition").cast("long").alias("competition")).agg(F.count(F.lit(1)).alias("n_good"))
    bc = b.groupBy("competition").agg(F.count(F.lit(1)).alias("n_bad"))
    return gc.join(bc, "competition", "full").select(
        "competition", F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


@query("STR-2", with_ctes("""
SELECT competition, round(sum(cost_usd), 10) AS total_usd FROM ledger GROUP BY competition""", "ledger"))
def q_str2(spark, sf_dir):
    """Running spend per competition (streaming aggregation, update mode)."""
    lg = ledger(spark, sf_dir).select("competition", "seq", "cost_usd")
    out = run(alarms.running_spend(_stream(spark, lg, "ledger")), "str2", ["competition"], "update")
    return out.select("competition", F.round("total_usd", 10).alias("total_usd"))


@query("STR-3")
def q_str3(spark, sf_dir):
    """Budget alarm with approve-and-double; the stream's files arrive out of order."""
    lg = ledger(spark, sf_dir).select("competition", "seq", "cost_usd")
    fold = drain(_stream(spark, lg, "ledger3", late=True), "str3", alarms.budget_alarm(lg.schema, DOUBLING_BUDGET))
    return alarms.budget_alarms(fold, DOUBLING_BUDGET).select("competition", "doublings", "final_budget")


@query("STR-4")
def q_str4(spark, sf_dir):
    """Stuck-loop alarm: keyed ring of the last 10 records."""
    j = journal(spark, sf_dir).select("competition", "seq", "kind", "tool", "args")
    out = run(alarms.stuck_loop_alarm(_stream(spark, j, "journal4", late=True)), "str4", ["competition"], "update")
    return out.where(F.col("tool").isNotNull())


@query("STR-5")
def q_str5(spark, sf_dir):
    """Submission gate classifying leaderboard records; the stream's files arrive out of order."""
    s = submissions(spark, sf_dir).select("competition", "seq", "cv_at_submit", "metric")
    fold = drain(_stream(spark, s, "subs5", late=True), "str5", alarms.submission_gate(s.schema))
    return fold.output(["competition", "seq"])


@query("STR-6", with_ctes("""
SELECT competition, CAST(count_if(kind IN ('tool_call', 'tool_error')) AS BIGINT) AS turns_per_run,
       CAST(count_if(kind = 'tool_error') AS BIGINT) AS error_count
FROM journal GROUP BY competition""", "journal"))
def q_str6(spark, sf_dir):
    """Behaviour counters per competition (streaming aggregation, update mode)."""
    j = journal(spark, sf_dir).select("competition", "seq", "kind")
    return run(alarms.behaviour_counters(_stream(spark, j, "journal6")), "str6", ["competition"], "update")


#: The ledger's calls as they arrive: six appends by time; every 41st call comes an append late (within the watermark),
#: every 97th four appends late (mostly behind it).
_ARRIVALS = """
, t AS (SELECT *, ntile_ AS part FROM (SELECT l.*, ts_s AS s, least(5, CAST(floor((ts_s - lo) * 6.0 / (hi - lo + 1)) AS BIGINT)) AS ntile_
        FROM ledger l, (SELECT min(ts_s) AS lo, max(ts_s) AS hi FROM ledger))),
a AS (SELECT *, CASE WHEN s % 97 = 0 THEN part + 4 WHEN s % 41 = 0 THEN part + 1 ELSE part END AS arrival FROM t)
"""


@query("OPT-5s", with_ctes(_ARRIVALS + """
, mark AS (SELECT i AS arrival, (SELECT max(s) FROM a WHERE a.arrival <= i - 2) - 2 * 86400 AS w FROM range(10) t(i)),
r AS (SELECT a.*, (s // 86400 + 1) * 86400 <= coalesce(mark.w, 0) AS behind FROM a JOIN mark USING (arrival))
SELECT competition, strftime(make_date(1970, 1, 1) + CAST(s // 86400 AS INTEGER), '%Y-%m-%d') AS day,
       round(coalesce(sum(cost_usd) FILTER (NOT behind), 0.0), 9) AS cost_usd, count(*) FILTER (NOT behind) AS n_rows,
       count(*) FILTER (behind) AS n_late FROM r GROUP BY competition, s // 86400""", "ledger"))
def q_opt5s(spark, sf_dir):
    """Spend per competition and day from a stream with a watermark of two days; rows behind it are reported.
    (A batch's late rows are told by the watermark of the batch before it, which has seen the rows before that.)"""
    lg = ledger(spark, sf_dir).select("competition", "ts_s", "ts", "cost_usd")
    lo, hi = lg.agg(F.min("ts_s"), F.max("ts_s")).first()
    part = F.least(F.lit(5), F.floor((F.col("ts_s") - F.lit(lo)) * 6.0 / F.lit((hi or 0) - (lo or 0) + 1)))
    lg = lg.withColumn("arrival", F.when(F.col("ts_s") % 97 == 0, part + 4).when(F.col("ts_s") % 41 == 0, part + 1).otherwise(part))
    path = scratch(spark, "ledger-days")
    columns = ["competition", "ts", "cost_usd"]
    for i in range(10):
        lg.where(F.col("arrival") == i).select(*columns).repartition(1).write.mode("append").parquet(path)
    # a record far ahead closes every day
    end = lg.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(
        F.lit(None).cast("long").alias("competition"), "ts", F.lit(0.0).alias("cost_usd"))
    end.where("ts IS NOT NULL").write.mode("append").parquet(path)
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(path)
    closed = run(alarms.daily_spend(stream), "opt5").where(F.col("competition").isNotNull())
    late = alarms.behind_watermark(lg, closed)
    keys = ["competition", "day_start"]
    both = closed.join(late, keys, "full")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_timestamp("day_start") / 86400).cast("int")), "yyyy-MM-dd")
    return both.select("competition", day.alias("day"), F.round(F.coalesce("cost_usd", F.lit(0.0)), 9).alias("cost_usd"),
                       F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


# the keyed-state twins answer exactly what their batch twins answer
ORACLES["STR-3"] = ORACLES["LED-4"]
ORACLES["STR-4"] = ORACLES["JRN-5"]
ORACLES["STR-5"] = ORACLES["GATE-1"]
