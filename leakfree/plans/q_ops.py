"""Registered queries: cost ledger (LED), submission gate and calibration (GATE, CAL),
traces (TRC), tracking runs and versions (RUN, VER)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leakfree.operators import gate
from leakfree.operators import ledger as led
from leakfree.operators import trace as trc
from leakfree.plans.q_logs import MIXED_SQL, mixed_journal
from leakfree.plans.registry import query
from leakfree.plans.sql import with_ctes
from leakfree.sources.bindings import decision_of, journal, ledger, spans, submissions, table

BREACH_BUDGET = 0.02      # USD per competition
DOUBLING_BUDGET = 0.005   # USD starting budget of the approve-and-double mode
WALL_LIMIT_S = 900.0      # seconds before a wall-clock approval


# --------------------------------------------------------------------------- LED-*
@query("LED-1", with_ctes("""
SELECT CAST(competition AS VARCHAR) AS competition, round(coalesce(sum(cost_usd), 0.0), 10) AS total_usd
FROM ledger GROUP BY ROLLUP (competition)""",
                          "ledger"))
def q_led1(spark, sf_dir):
    """Spend per competition plus the overall total (competition null), one rollup."""
    t = led.totals(ledger(spark, sf_dir))
    return t.select(F.col("competition").cast("string"), F.round("total_usd", 10).alias("total_usd"))


@query("LED-3", with_ctes(f"""
, c AS (SELECT competition, seq, sum(cost_usd) OVER (PARTITION BY competition ORDER BY seq
                                                     ROWS UNBOUNDED PRECEDING) AS spent FROM ledger)
SELECT competition, min(seq) AS breach_seq, round(arg_min(spent, seq), 10) AS spent_at_breach
FROM c WHERE spent > {BREACH_BUDGET} GROUP BY competition""", "ledger"))
def q_led3(spark, sf_dir):
    b = led.budget_breach(ledger(spark, sf_dir), BREACH_BUDGET)
    return b.select("competition", "breach_seq", F.round("spent_at_breach", 10).alias("spent_at_breach"))


@query("LED-4", "WITH RECURSIVE " + with_ctes(f"""
, c AS (SELECT competition, row_number() OVER (PARTITION BY competition ORDER BY seq) AS t,
               coalesce(sum(cost_usd) OVER (PARTITION BY competition ORDER BY seq
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM ledger),
r AS (SELECT competition, t, CASE WHEN before > {DOUBLING_BUDGET} THEN {DOUBLING_BUDGET * 2} ELSE {DOUBLING_BUDGET} END
             AS budget, CASE WHEN before > {DOUBLING_BUDGET} THEN 1 ELSE 0 END AS n FROM c WHERE t = 1
      UNION ALL
      SELECT c.competition, c.t, CASE WHEN c.before > r.budget THEN r.budget * 2 ELSE r.budget END,
             r.n + CASE WHEN c.before > r.budget THEN 1 ELSE 0 END
      FROM r JOIN c ON c.competition = r.competition AND c.t = r.t + 1)
SELECT competition, CAST(arg_max(n, t) AS BIGINT) AS doublings, CAST(arg_max(budget, t) AS DOUBLE) AS final_budget
FROM r GROUP BY competition""", "ledger")[len("WITH "):])
def q_led4(spark, sf_dir):
    """Approve-and-double budget mode: doublings per competition (order-dependent rule
    solved with per-level first-crossing aggregates, see ``ledger.budget_doublings``)."""
    return led.budget_doublings(ledger(spark, sf_dir), DOUBLING_BUDGET)


@query("LED-5", "WITH RECURSIVE " + with_ctes(f"""
, c AS (SELECT competition, row_number() OVER (PARTITION BY competition ORDER BY seq) AS t,
               CAST(ts_s AS DOUBLE) AS ts FROM ledger_raw),
r AS (SELECT competition, t, ts AS start, 0 AS n FROM c WHERE t = 1
      UNION ALL
      SELECT c.competition, c.t, CASE WHEN c.ts - r.start > {WALL_LIMIT_S} THEN c.ts ELSE r.start END,
             r.n + CASE WHEN c.ts - r.start > {WALL_LIMIT_S} THEN 1 ELSE 0 END
      FROM r JOIN c ON c.competition = r.competition AND c.t = r.t + 1)
SELECT competition, CAST(arg_max(n, t) AS BIGINT) AS extensions FROM r GROUP BY competition""",
                                              "ledger_raw")[len("WITH "):])
def q_led5(spark, sf_dir):
    """Wall-clock approvals per competition (reset chain by binary lifting)."""
    return led.wall_clock_extensions(ledger(spark, sf_dir), WALL_LIMIT_S)


# --------------------------------------------------------------------------- GATE-*, CAL-*
_HIB = "CASE {m} WHEN 'logloss' THEN false WHEN 'rmse' THEN false WHEN 'mae' THEN false ELSE true END"

_GATE_SQL = f"""
, s AS (SELECT *, CASE WHEN cv_at_submit IS NOT NULL AND NOT isnan(cv_at_submit) THEN cv_at_submit END AS cv,
               {_HIB.format(m='metric')} AS hib FROM subs),
w AS (SELECT *, count(*) OVER p AS n_prior, count(cv) OVER p AS n_num, max(cv) OVER p AS mx, min(cv) OVER p AS mn
      FROM s WINDOW p AS (PARTITION BY competition ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g1 AS (SELECT *, CASE WHEN n_prior = 0 THEN 'submit_kaggle_first'
                      WHEN n_num = 0 THEN 'submit_kaggle_non_regression'
                      WHEN (hib AND coalesce(cv, '-inf'::DOUBLE) < mx) OR (NOT hib AND coalesce(cv, 'inf'::DOUBLE) > mn)
                      THEN 'submit_kaggle_regression' ELSE 'submit_kaggle_non_regression' END AS trigger,
                 CASE WHEN n_num > 0 THEN CASE WHEN hib THEN mx ELSE mn END END AS prev_best,
                 CASE seq % 7 WHEN 0 THEN 'deny' WHEN 1 THEN 'skip_check' WHEN 2 THEN 'abort' ELSE 'approve' END
                   AS raw_decision FROM w),
g4 AS (SELECT *, CASE WHEN coalesce(max(CASE WHEN raw_decision = 'skip_check' THEN 1 ELSE 0 END) OVER
                      (PARTITION BY competition, trigger ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      0) = 1 THEN 'approve' ELSE raw_decision END AS decision FROM g1),
jm AS (SELECT *, CASE WHEN kind = 'tool_call' AND tool = 'train_cv' THEN
                  TRY_CAST(NULLIF(regexp_extract(coalesce(result_summary, ''), 'mean=(-?[0-9.]+)', 1), '') AS DOUBLE)
                 END AS m0 FROM journal),
jm2 AS (SELECT *, CASE WHEN m0 IS NOT NULL AND NOT isnan(m0) THEN m0 END AS mm,
               CASE WHEN m0 IS NOT NULL AND NOT isnan(m0)
                    THEN NULLIF(regexp_extract(result_summary, 'metric=(\\w+)', 1), '') END AS met FROM jm),
jw AS (SELECT *, max(mm) OVER p AS mx, min(mm) OVER p AS mn, last_value(mm IGNORE NULLS) OVER p AS last_cv,
              last_value(met IGNORE NULLS) OVER p AS last_metric
       FROM jm2 WINDOW p AS (PARTITION BY competition ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g2 AS (SELECT competition, seq, CASE WHEN {_HIB.format(m='last_metric')} THEN mx ELSE mn END AS best_cv_mean,
              last_cv AS last_cv_mean FROM jw WHERE kind = 'tool_call' AND tool = 'submit_kaggle'),
req AS (SELECT g4.*, g2.best_cv_mean, g2.last_cv_mean FROM g4 LEFT JOIN g2
        ON g2.competition = g4.competition AND g2.seq = g4.seq * 2 + 1)
"""


def _requests(spark: SparkSession, sf_dir: str):
    """Checkpoint requests of the bound event log: each leaderboard record classified
    (GATE-1), its stub decision, sticky skips applied (GATE-4) and the CV state of the
    journal at that submit (GATE-2)."""
    g = gate.classify_submissions(submissions(spark, sf_dir))
    g = gate.sticky_skip(g.withColumn("raw_decision", decision_of(F.col("seq"))))
    rb = gate.running_best(journal(spark, sf_dir)).where(
        (F.col("kind") == "tool_call") & (F.col("tool") == "submit_kaggle")).select(
        "competition", ((F.col("seq") - 1) / 2).cast("long").alias("seq"), "best_cv_mean", "last_cv_mean")
    return g.join(rb, ["competition", "seq"], "left")


@query("GATE-1", with_ctes(_GATE_SQL + "SELECT competition, seq, trigger, prev_best FROM g1", "subs", "journal"))
def q_gate1(spark, sf_dir):
    g = gate.classify_submissions(submissions(spark, sf_dir))
    return g.select("competition", "seq", "trigger", "prev_best")


@query("GATE-2", with_ctes(_GATE_SQL + """
SELECT competition, seq, round(best_cv_mean, 6) AS best_cv_mean, round(last_cv_mean, 6) AS last_cv_mean FROM g2""",
                           "subs", "journal"))
def q_gate2(spark, sf_dir):
    """Running best / last CV as seen by every submit call of the journal."""
    rb = gate.running_best(journal(spark, sf_dir)).where(
        (F.col("kind") == "tool_call") & (F.col("tool") == "submit_kaggle"))
    return rb.select("competition", "seq", F.round("best_cv_mean", 6).alias("best_cv_mean"),
                     F.round("last_cv_mean", 6).alias("last_cv_mean"))


@query("GATE-2x", "WITH RECURSIVE " + with_ctes(MIXED_SQL + """
SELECT s.competition, s.seq, round(r.best, 6) AS best_cv_mean
FROM (SELECT * FROM jx WHERE kind = 'tool_call' AND tool = 'submit_kaggle') s
ASOF LEFT JOIN r ON s.competition = r.competition AND s.seq > r.seq""", "journal")[len("WITH "):])
def q_gate2x(spark, sf_dir):
    """Running best as seen by every submit, in runs that switch between metrics of both directions."""
    rb = gate.running_best(mixed_journal(spark, sf_dir)).where((F.col("kind") == "tool_call") & (F.col("tool") == "submit_kaggle"))
    return rb.select("competition", "seq", F.round("best_cv_mean", 6).alias("best_cv_mean"))


@query("GATE-3", with_ctes(_GATE_SQL + """
SELECT competition, seq, trigger,
       CASE WHEN trigger = 'submit_kaggle_non_regression' THEN 'approve' ELSE 'deny' END AS decision FROM g1""",
                           "subs", "journal"))
def q_gate3(spark, sf_dir):
    g = gate.classify_submissions(submissions(spark, sf_dir))
    return g.select("competition", "seq", "trigger", gate.decide(F.col("trigger"), "auto_safe").alias("decision"))


@query("GATE-4", with_ctes(_GATE_SQL + "SELECT competition, seq, trigger, raw_decision, decision FROM g4",
                           "subs", "journal"))
def q_gate4(spark, sf_dir):
    g = gate.classify_submissions(submissions(spark, sf_dir))
    g = gate.sticky_skip(g.withColumn("raw_decision", decision_of(F.col("seq"))))
    return g.select("competition", "seq", "trigger", "raw_decision", "decision")


@query("GATE-5", with_ctes(_GATE_SQL + """
SELECT competition, seq, csv, cv_at_submit, message FROM g4 WHERE decision IN ('approve', 'skip_check')""",
                           "subs", "journal"))
def q_gate5(spark, sf_dir):
    """Leaderboard rows written by approved submits only."""
    return gate.leaderboard_rows(_requests(spark, sf_dir)).drop("ts")


@query("CAL-1", with_ctes(_GATE_SQL + """
SELECT competition, seq, round(coalesce(last_cv_mean, 'NaN'::DOUBLE), 6) AS cv_score,
       CASE WHEN metric IN ('accuracy', 'auc', 'logloss') THEN 'classification' ELSE 'regression' END AS problem_type,
       metric, CASE WHEN metric IN ('accuracy', 'auc', 'logloss') THEN 'stratified_kfold' ELSE 'kfold' END AS cv_strategy
FROM req WHERE decision IN ('approve', 'skip_check')""", "subs", "journal"))
def q_cal1(spark, sf_dir):
    c = gate.calibration_rows(_requests(spark, sf_dir))
    return c.select("competition", "seq", F.round("cv_score", 6).alias("cv_score"), "problem_type", "metric",
                    "cv_strategy")


@query("CAL-2", with_ctes(_GATE_SQL + """
SELECT seq, round(coalesce(last_cv_mean, 'NaN'::DOUBLE), 6) AS cv_score, metric
FROM req WHERE decision IN ('approve', 'skip_check') AND competition = 3""", "subs", "journal"))
def q_cal2(spark, sf_dir):
    """Calibration history of one competition in write order."""
    h = gate.history(gate.calibration_rows(_requests(spark, sf_dir)), competition=3)
    return h.select("seq", F.round("cv_score", 6).alias("cv_score"), "metric")


# --------------------------------------------------------------------------- TRC-*, RUN-*, VER-1
@query("TRC-1", with_ctes("""
SELECT trace_id, arg_min(span_id, (ts, span_id)) AS span_id, arg_min(name, (ts, span_id)) AS name,
       count(*) AS n_markers
FROM spans WHERE status = 'MARKER' AND name LIKE 'run:%' GROUP BY trace_id""", "spans"))
def q_trc1(spark, sf_dir):
    return trc.markers(spans(spark, sf_dir))


@query("TRC-2", "WITH RECURSIVE " + with_ctes("""
, s AS (SELECT trace_id, span_id, parent_span_id FROM spans WHERE status <> 'MARKER'),
t AS (SELECT trace_id, span_id, 0 AS depth, span_id AS root_span_id FROM s WHERE parent_span_id IS NULL
      UNION ALL
      SELECT s.trace_id, s.span_id, t.depth + 1, t.root_span_id
      FROM s JOIN t ON s.trace_id = t.trace_id AND s.parent_span_id = t.span_id)
SELECT trace_id, span_id, CAST(depth AS DOUBLE) AS depth, root_span_id FROM t
UNION ALL
SELECT s.trace_id, s.span_id, NULL, NULL FROM s ANTI JOIN t ON s.trace_id = t.trace_id AND s.span_id = t.span_id""",
                                               "spans")[len("WITH "):])
def q_trc2(spark, sf_dir):
    r = trc.resolve_tree(spans(spark, sf_dir))
    return r.select("trace_id", "span_id", F.col("depth").cast("double"), "root_span_id")


@query("TRC-2d", """
WITH RECURSIVE s AS (SELECT event_id // 1000 AS trace_id, event_id AS span_id,
    CASE WHEN event_id % 1000 = 0 THEN NULL WHEN event_id % 5000 = 2500 THEN -1 ELSE event_id - 1 END AS parent FROM events),
t AS (SELECT trace_id, span_id, 0 AS depth, span_id AS root FROM s WHERE parent IS NULL
      UNION ALL
      SELECT s.trace_id, s.span_id, t.depth + 1, t.root FROM s JOIN t ON s.trace_id = t.trace_id AND s.parent = t.span_id)
SELECT trace_id::VARCHAR AS trace_id, span_id::VARCHAR AS span_id, t.depth::DOUBLE AS depth, t.root::VARCHAR AS root_span_id
FROM s LEFT JOIN t USING (trace_id, span_id)""")
def q_trc2d(spark, sf_dir):
    """Depth and root in traces of 1,000 events, each the child of the one before; some parents are missing."""
    e = F.col("event_id")
    parent = F.when(e % 1000 == 0, F.lit(None)).when(e % 5000 == 2500, F.lit(-1)).otherwise(e - 1)
    s = table(spark, sf_dir, "events").select(F.floor(e / 1000).cast("string").alias("trace_id"), e.cast("string").alias("span_id"),
                                              parent.cast("string").alias("parent_span_id"), F.lit("OK").alias("status"))
    return trc.resolve_tree(s).select("trace_id", "span_id", F.col("depth").cast("double"), "root_span_id")


@query("TRC-3", with_ctes("""
SELECT name, count(*) AS n_spans, CAST(count_if(status = 'ERROR' OR has_error_attr) AS BIGINT) AS n_errors,
       CAST(sum(duration_ns) AS BIGINT) AS total_ns, round(avg(duration_ns), 3) AS avg_ns,
       max(duration_ns) AS max_ns, CAST(sum(in_tok) AS DOUBLE) AS input_tokens,
       CAST(sum(out_tok) AS DOUBLE) AS output_tokens
FROM spans WHERE status <> 'MARKER' GROUP BY name""", "spans"))
def q_trc3(spark, sf_dir):
    r = trc.rollup_by_name(spans(spark, sf_dir))
    return r.select("name", "n_spans", "n_errors", "total_ns", F.round("avg_ns", 3).alias("avg_ns"), "max_ns",
                    F.col("input_tokens").cast("double"), F.col("output_tokens").cast("double"))


@query("TRC-4", with_ctes("""
, w AS (SELECT * FROM spans WHERE status <> 'MARKER'),
k AS (SELECT trace_id, parent_span_id AS span_id, sum(duration_ns) AS children_ns, count(*) AS n_children
      FROM w WHERE parent_span_id IS NOT NULL GROUP BY ALL)
SELECT w.trace_id, w.span_id, w.name, w.duration_ns, coalesce(k.n_children, 0) AS n_children,
       CAST(w.duration_ns - coalesce(k.children_ns, 0) AS BIGINT) AS self_ns
FROM w LEFT JOIN k ON w.trace_id = k.trace_id AND w.span_id = k.span_id""", "spans"))
def q_trc4(spark, sf_dir):
    return trc.self_time(spans(spark, sf_dir))


_RUNS_SQL = """
, ok AS (SELECT competition, seq,
                NULLIF(regexp_extract(result_summary, 'train_cv complete: (\\w+) \\((\\d+) folds\\)', 1), '') AS cv_strategy,
                TRY_CAST(NULLIF(regexp_extract(result_summary, 'train_cv complete: (\\w+) \\((\\d+) folds\\)', 2), '')
                         AS INTEGER) AS n_splits,
                NULLIF(regexp_extract(result_summary, 'metric=(\\w+)', 1), '') AS metric,
                TRY_CAST(NULLIF(regexp_extract(result_summary, 'mean=(-?[0-9.]+)', 1), '') AS DOUBLE) AS cv_mean,
                TRY_CAST(NULLIF(regexp_extract(result_summary, 'std=(-?[0-9.]+)', 1), '') AS DOUBLE) AS cv_std,
                TRY_CAST(NULLIF(regexp_extract(result_summary, 'duration_s=(-?[0-9.]+)', 1), '') AS DOUBLE) AS wall_clock_s,
                CAST(json(NULLIF(regexp_extract(result_summary, 'fold_scores=(\\[[^\\]]*\\])', 1), '')) AS DOUBLE[])
                  AS fold_scores
         FROM journal WHERE kind = 'tool_call' AND tool = 'train_cv'),
runs AS (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY seq) AS run_no FROM ok
         WHERE cv_mean IS NOT NULL)
"""


@query("RUN-1", with_ctes(_RUNS_SQL + """
SELECT competition, run_no, cv_strategy, n_splits, metric, cv_mean, cv_std, wall_clock_s,
       CASE WHEN metric IN ('accuracy', 'auc', 'logloss') THEN 'classification' ELSE 'regression' END AS problem_type,
       list_aggregate(list_transform(fold_scores, lambda x: printf('%.2f', x)), 'string_agg', ' ') AS fold_scores,
       printf('fe_v%02d', run_no) AS fe_version, printf('model_v%02d', run_no) AS model_version FROM runs""",
                          "journal"))
def q_run1(spark, sf_dir):
    r = trc.cv_runs(journal(spark, sf_dir))
    scores = F.array_join(F.transform("fold_scores", lambda x: F.format_string("%.2f", x)), " ")
    return r.select("competition", "run_no", "cv_strategy", "n_splits", "metric", "cv_mean", "cv_std", "wall_clock_s", "problem_type",
                    scores.alias("fold_scores"), "fe_version", "model_version")


@query("RUN-2", with_ctes(_RUNS_SQL + """
SELECT competition, run_no, CAST(unnest(range(len(fold_scores))) AS INTEGER) AS fold,
       unnest(fold_scores) AS score FROM runs""", "journal"))
def q_run2(spark, sf_dir):
    return trc.fold_metrics(trc.cv_runs(journal(spark, sf_dir)))


@query("VER-1", with_ctes(_RUNS_SQL + """
SELECT competition, count(*) AS runs, printf('fe_v%02d', max(run_no)) AS last_fe_version,
       CAST(max(run_no) + 1 AS INTEGER) AS next_fe, CAST(max(run_no) + 1 AS INTEGER) AS next_model
FROM runs GROUP BY competition""", "journal"))
def q_ver1(spark, sf_dir):
    """Version labels per competition: archived names of successful runs → next number
    (other file names in the folder listing are ignored)."""
    r = trc.cv_runs(journal(spark, sf_dir))
    names = r.select("competition", F.concat("fe_version", F.lit(".py")).alias("name")).unionByName(
        r.select("competition", F.concat("model_version", F.lit(".py")).alias("name"))).unionByName(
        r.select("competition", F.lit("notes_v99.txt").alias("name")))
    nf = trc.next_version(names, "fe", ["competition"])
    nm = trc.next_version(names, "model", ["competition"])
    last = r.groupBy("competition").agg(F.count(F.lit(1)).alias("runs"),
                                        F.max_by("fe_version", "run_no").alias("last_fe_version"))
    return last.join(nf, "competition").join(nm, "competition")
