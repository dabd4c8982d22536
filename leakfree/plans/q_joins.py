"""Registered queries: the reference's implicit joins (JN-1..7), MET-9, LED-2, SNK-2."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakfree.functions.cost import price_dim
from leakfree.functions.parse import better, higher_is_better
from leakfree.operators import cv
from leakfree.operators import journal as jr
from leakfree.operators import metrics as met
from leakfree.operators.ordered import Agg, running
from leakfree.plans import q_cv, q_misc, q_ml  # noqa: F401  (the queries reused below)
from leakfree.plans.registry import ORACLES, QUERIES, query
from leakfree.plans.sql import with_ctes
from leakfree.sources import io
from leakfree.sources.bindings import journal, ledger, spans, training


@query("JN-2", with_ctes("""
SELECT l.competition, l.seq, l.model, CAST(coalesce(p.rate_in, 1.25) AS DOUBLE) AS rate_in,
       CAST(coalesce(p.rate_cached, 0.3125) AS DOUBLE) AS rate_cached, CAST(coalesce(p.rate_out, 10.0) AS DOUBLE) AS rate_out
FROM ledger_raw l LEFT JOIN prices p ON l.model = p.model""", "ledger_raw", "prices"))
def q_jn2(spark, sf_dir):
    """Price lookup with a default rate: broadcast join of the (constant) price table."""
    lg = ledger(spark, sf_dir).select("competition", "seq", "model")
    j = lg.join(F.broadcast(price_dim(spark)), "model", "left")
    return j.select("competition", "seq", "model", F.coalesce("rate_in", F.lit(1.25)).alias("rate_in"),
                    F.coalesce("rate_cached", F.lit(0.3125)).alias("rate_cached"),
                    F.coalesce("rate_out", F.lit(10.0)).alias("rate_out"))


@query("JN-3", ORACLES["PRJ-4"])
def q_jn3(spark, sf_dir):
    """Metric-registry lookup: train_cv records ⋈ the registry dimension (broadcast);
    unknown or missing metric → higher is better."""
    j = journal(spark, sf_dir).where(F.col("tool") == "train_cv")
    j = j.select("competition", "seq", F.nullif(F.regexp_extract("result_summary", r"metric=(\w+)", 1), F.lit(""))
                 .alias("metric"))
    dim = F.broadcast(met.metric_dim(spark).select(F.col("name").alias("metric"), "higher_is_better"))
    return j.join(dim, "metric", "left").select(
        "competition", "seq", "metric", F.coalesce("higher_is_better", F.lit(True)).alias("higher_is_better"))


@query("JN-4", with_ctes("""
, w AS MATERIALIZED (SELECT * FROM spans WHERE status <> 'MARKER')
SELECT c.trace_id, c.span_id, c.name, p.name AS parent_name, p.duration_ns AS parent_ns
FROM w c JOIN w p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id""", "spans"))
def q_jn4(spark, sf_dir):
    """Span parent ↔ child self equi-join on (trace_id, parent_span_id = span_id)."""
    s = spans(spark, sf_dir).where(F.col("status") != "MARKER")
    c = s.select("trace_id", "span_id", "name", "parent_span_id")
    p = s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("parent_name"),
                 F.col("duration_ns").alias("parent_ns"))
    return c.join(p, ["trace_id", "parent_span_id"]).select("trace_id", "span_id", "name", "parent_name", "parent_ns")


# JN-1 portfolio, JN-5 fold statistics ↔ rows, JN-6 predictions ↔ rows, JN-7 test id
# re-attached: the same plans as the operators that perform them.
for _jn, _src in (("JN-1", "PORT-1"), ("JN-5", "FE-1"), ("JN-6", "CVR-2"), ("JN-7", "FIN-1")):
    query(_jn, ORACLES[_src])(QUERIES[_src])


@query("MET-9", with_ctes("""
, cv AS (SELECT competition, seq,
                TRY_CAST(NULLIF(regexp_extract(result_summary, 'mean=(-?[0-9.]+)', 1), '') AS DOUBLE) AS mean,
                NULLIF(regexp_extract(result_summary, 'metric=(\\w+)', 1), '') AS metric
         FROM journal WHERE kind = 'tool_call' AND tool = 'train_cv'),
c2 AS (SELECT * FROM cv WHERE mean IS NOT NULL AND NOT isnan(mean)),
w AS (SELECT *, max(mean) OVER p AS mx, min(mean) OVER p AS mn FROM c2
      WINDOW p AS (PARTITION BY competition ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT competition, seq, CASE WHEN metric IN ('logloss', 'rmse', 'mae')
                              THEN mn IS NULL OR mean < mn ELSE mx IS NULL OR mean > mx END AS is_better
FROM w""", "journal"))
def q_met9(spark, sf_dir):
    """Direction-aware strict comparison of each CV result with the best before it."""
    cvr = jr.cv_records(journal(spark, sf_dir)).select("competition", "seq", "mean", "metric")
    r = running(cvr, ["competition"], ["seq"], [Agg("_mx", "max", "mean"), Agg("_mn", "min", "mean")],
                inclusive=False)
    hib = higher_is_better(F.col("metric"))
    prior = F.when(hib, F.col("_mx")).otherwise(F.col("_mn"))
    return r.select("competition", "seq", better(F.col("mean"), prior, hib).alias("is_better"))


@query("LED-2", with_ctes("""
SELECT competition, count(*) AS calls, round(sum(cost_usd), 10) AS total_usd FROM ledger GROUP BY competition""",
                          "ledger"))
def q_led2(spark, sf_dir):
    """Record: price each call at write time and append it to the ledger log; the totals
    are then read back from the written log."""
    path = q_misc.scratch(spark, "ledger-record")
    lg = ledger(spark, sf_dir).select("competition", "seq", "model", "input_tokens", "output_tokens",
                                      "cached_tokens", "cost_usd")
    io.append_log(lg, path)
    back = spark.read.schema(lg.schema).json(path)
    return back.groupBy(F.col("competition").cast("long").alias("competition")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 10).alias("total_usd"))


@query("SNK-2", ORACLES["FIN-1"])
def q_snk2(spark, sf_dir):
    """Submission file: final predictions written as CSV with a header (partitioned
    output), read back with the header."""
    path = q_misc.scratch(spark, "submission")
    df = training(spark, sf_dir).select("row_id", "x_acct", "x_days", "y_reg")
    out = cv.fit_final_predict(df, df, "y_reg", "row_id", model=cv.Ridge(["x_acct", "x_days"], 1.0))
    io.write_predictions(out, path)
    back = spark.read.option("header", True).schema("row_id long, y_reg double").csv(path)
    return back.select("row_id", F.round("y_reg", 4).alias("y_reg"))


_REGISTRY_SQL = """
, reg AS (SELECT * FROM (VALUES ('accuracy', true, false, 'classification'), ('auc', true, true, 'classification'),
                                ('logloss', false, true, 'classification'), ('rmse', false, false, 'regression'),
                                ('mae', false, false, 'regression'), ('r2', true, false, 'regression'))
          AS t(name, higher_is_better, needs_proba, kind)),
cvm AS (SELECT NULLIF(regexp_extract(result_summary, 'metric=(\\w+)', 1), '') AS metric
        FROM journal WHERE kind = 'tool_call' AND tool = 'train_cv')"""


@query("MET-7", with_ctes(_REGISTRY_SQL + """
SELECT r.name AS metric, r.higher_is_better, r.needs_proba, r.kind, count(c.metric) AS n_runs
FROM reg r LEFT JOIN cvm c ON c.metric = r.name GROUP BY ALL""", "journal"))
def q_met7(spark, sf_dir):
    """The metric registry (directions pinned) with how often each metric was used by the
    journal's train_cv calls — the registry as a dimension joined to data."""
    j = journal(spark, sf_dir).where((F.col("kind") == "tool_call") & (F.col("tool") == "train_cv"))
    used = j.select(F.nullif(F.regexp_extract("result_summary", r"metric=(\w+)", 1), F.lit("")).alias("metric"))
    counts = used.groupBy("metric").agg(F.count(F.lit(1)).alias("n_runs"))
    dim = met.metric_dim(spark).withColumnRenamed("name", "metric")
    return dim.join(counts, "metric", "left").select(
        "metric", "higher_is_better", "needs_proba", "kind", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


@query("CVR-4", with_ctes(_REGISTRY_SQL.replace("AS metric\n        FROM journal", "AS metric, competition, seq\n        FROM journal")
                          + """
SELECT c.competition, c.seq, c.metric, r.kind AS problem_type FROM cvm c LEFT JOIN reg r ON c.metric = r.name""",
                          "journal"))
def q_cvr4(spark, sf_dir):
    """Problem type of every logged CV run, taken from its metric's kind (the registry)."""
    j = journal(spark, sf_dir).where((F.col("kind") == "tool_call") & (F.col("tool") == "train_cv"))
    runs = j.select("competition", "seq",
                    F.nullif(F.regexp_extract("result_summary", r"metric=(\w+)", 1), F.lit("")).alias("metric"))
    dim = F.broadcast(met.metric_dim(spark).select(F.col("name").alias("metric"), F.col("kind").alias("problem_type")))
    return runs.join(dim, "metric", "left").select("competition", "seq", "metric", "problem_type")


@query("LED-1j", ORACLES["LED-1"])
def q_led1j(spark, sf_dir):
    """Ledger totals read back from the JSON-lines log (tolerant reader, explicit schema):
    per competition and overall, as LED-1."""
    from leakfree.operators import ledger as led
    path = q_misc.scratch(spark, "ledger-jsonl")
    lg = ledger(spark, sf_dir).select(F.col("competition").cast("string").alias("competition"), "seq", "model",
                                      "input_tokens", "output_tokens", "cached_tokens", "cost_usd")
    io.append_log(lg, path, partition_by=None, fmt="json")
    good, _bad = io.read_log(spark, path, io.LEDGER_SCHEMA)
    t = led.totals(good)
    return t.select(F.col("competition").cast("string"), F.round("total_usd", 10).alias("total_usd"))
