"""Registered queries: journal analytics (JRN), scalar expressions (PRJ), filters (FLT), VAL-1.

Journal = ``events`` bound by ``bindings.journal`` (competition = user, seq from event id,
one checkpoint record before every submit).  Texts = ``documents`` / ``pages``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leakfree.functions import maps as fm
from leakfree.functions import parse as fp
from leakfree.functions import text as ft
from leakfree.functions.cost import usage_total
from leakfree.operators import journal as jr
from leakfree.plans.registry import query
from leakfree.plans.sql import with_ctes
from leakfree.sources.bindings import journal, ledger, notes, submissions, table

TOOLS_SQL = "kind IN ('tool_call', 'tool_error')"


def _canon(a: str) -> str:
    """DuckDB: key-sorted compact JSON of an args object with string values (``{}`` if null)."""
    a = f"coalesce({a}, '{{}}')"
    return ("'{' || array_to_string(list_transform(list_sort(json_keys(" + a + ")), lambda k: to_json(k) || ':' || "
            "to_json(json_extract_string(" + a + ", '$.\"' || k || '\"'))), ',') || '}'")


# --------------------------------------------------------------------------- JRN-1..10
@query("JRN-1", with_ctes(f"""
, per AS (SELECT competition, coalesce(tool, '') AS tool, count(*) AS n FROM journal WHERE {TOOLS_SQL}
          GROUP BY ALL),
tc AS (SELECT competition, string_agg(tool || '=' || CAST(n AS VARCHAR), ',' ORDER BY tool) AS tool_counts,
              sum(n) AS turns_per_run FROM per GROUP BY competition)
SELECT competition, CAST(turns_per_run AS BIGINT) AS turns_per_run, tool_counts FROM tc""", "journal"))
def q_jrn1(spark, sf_dir):
    j = journal(spark, sf_dir)
    b = jr.behaviour(j).select("competition", "turns_per_run")
    tc = jr.tool_counts(j).select("competition", F.array_join(F.transform(
        F.map_entries("tool_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        ",").alias("tool_counts"))
    return b.join(tc, "competition")


@query("JRN-2", with_ctes(f"""
SELECT competition, CAST(count_if(kind = 'tool_error') AS BIGINT) AS error_count,
       round(count_if(kind = 'tool_error') / greatest(count_if({TOOLS_SQL}), 1), 6) AS tool_call_failure_rate
FROM journal GROUP BY competition""", "journal"))
def q_jrn2(spark, sf_dir):
    b = jr.behaviour(journal(spark, sf_dir))
    return b.select("competition", "error_count", F.round("tool_call_failure_rate", 6).alias("tool_call_failure_rate"))


@query("JRN-3", with_ctes(f"""
SELECT competition, min(CASE WHEN {TOOLS_SQL} AND tool IN ('submit_kaggle', 'submit_local') THEN ordinal END)
       AS turns_to_first_submission
FROM jo GROUP BY competition""", "jo"))
def q_jrn3(spark, sf_dir):
    b = jr.behaviour(journal(spark, sf_dir))
    return b.select("competition", F.col("turns_to_first_submission").cast("bigint"))


_CV_SQL = """
, cv AS (SELECT competition, ordinal,
                TRY_CAST(NULLIF(regexp_extract(result_summary, 'mean=(-?[0-9.]+)', 1), '') AS DOUBLE) AS mean,
                NULLIF(regexp_extract(result_summary, 'metric=(\\w+)', 1), '') AS metric
         FROM jo WHERE kind = 'tool_call' AND tool = 'train_cv'),
cvh AS (SELECT *, CASE metric WHEN 'logloss' THEN false WHEN 'rmse' THEN false WHEN 'mae' THEN false
                  ELSE true END AS hib FROM cv WHERE mean IS NOT NULL AND NOT isnan(mean))"""


@query("JRN-4", with_ctes(_CV_SQL + """,
ext AS (SELECT competition, bool_or(hib) AS hib, max(mean) AS mx, min(mean) AS mn FROM cvh GROUP BY competition)
SELECT c.competition, any_value(CASE WHEN e.hib THEN e.mx ELSE e.mn END) AS best_cv_mean,
       min(c.ordinal) AS turns_to_best_score
FROM cvh c JOIN ext e ON c.competition = e.competition
WHERE c.mean = CASE WHEN e.hib THEN e.mx ELSE e.mn END GROUP BY c.competition""", "jo"))
def q_jrn4(spark, sf_dir):
    return jr.best_score(journal(spark, sf_dir))


#: Twenty long runs whose records switch between a metric of each direction, one of them registered beside the six.
MIXED_SQL = """
, jx AS (SELECT * REPLACE (competition % 20 AS competition, regexp_replace(result_summary, 'metric=[a-z]+',
                  CASE WHEN seq % 8 < 3 THEN 'metric=rmsle' ELSE 'metric=accuracy' END) AS result_summary) FROM journal),
jxo AS (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY seq) AS ordinal FROM jx),
c AS MATERIALIZED (SELECT competition, seq, ordinal, mean, seq % 8 >= 3 AS hib,
                          row_number() OVER (PARTITION BY competition ORDER BY seq) AS k
      FROM (SELECT *, TRY_CAST(NULLIF(regexp_extract(result_summary, 'mean=(-?[0-9.]+)', 1), '') AS DOUBLE) AS mean
            FROM jxo WHERE kind = 'tool_call' AND tool = 'train_cv') WHERE mean IS NOT NULL AND NOT isnan(mean)),
r AS (SELECT competition, seq, k, mean AS best, ordinal AS turn FROM c WHERE k = 1
      UNION ALL
      SELECT c.competition, c.seq, c.k, CASE WHEN c.hib THEN greatest(r.best, c.mean) ELSE least(r.best, c.mean) END,
             CASE WHEN (c.hib AND c.mean > r.best) OR (NOT c.hib AND c.mean < r.best) THEN c.ordinal ELSE r.turn END
      FROM r JOIN c ON c.competition = r.competition AND c.k = r.k + 1)
"""


def mixed_journal(spark, sf_dir):
    j = journal(spark, sf_dir)
    metric = F.when(F.col("seq") % 8 < 3, F.lit("metric=rmsle")).otherwise(F.lit("metric=accuracy"))
    return j.withColumn("competition", F.col("competition") % 20).withColumn(
        "result_summary", F.regexp_replace("result_summary", F.lit("metric=[a-z]+"), metric))


@query("JRN-4x", "WITH RECURSIVE " + with_ctes(MIXED_SQL + """
SELECT competition, arg_max(best, k) AS best_cv_mean, arg_max(turn, k) AS turns_to_best_score FROM r GROUP BY competition""",
                                               "journal")[len("WITH "):])
def q_jrn4x(spark, sf_dir):
    """Best score of runs that switch between metrics of both directions."""
    return jr.best_score(mixed_journal(spark, sf_dir))


@query("JRN-5", with_ctes(f"""
, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY seq DESC) AS rn
                          FROM journal) WHERE rn <= 10),
sig AS (SELECT competition, seq, coalesce(tool, '') AS tool, {_canon('args')} AS args FROM last WHERE {TOOLS_SQL}),
c AS (SELECT competition, tool, args, count(*) AS repeats, min(seq) AS first FROM sig GROUP BY ALL)
SELECT competition, arg_max(tool, (repeats, -first)) AS tool, arg_max(args, (repeats, -first)) AS args,
       max(repeats) AS repeats, 10 AS "window", max(repeats) >= 5 AS stuck
FROM c GROUP BY competition""", "journal"))
def q_jrn5(spark, sf_dir):
    return jr.stuck_loop(journal(spark, sf_dir))


@query("JRN-6", with_ctes(f"""
SELECT competition, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(tool, seq) AS tool, arg_max(args, seq) AS args
FROM journal WHERE {TOOLS_SQL} GROUP BY competition""", "journal"))
def q_jrn6(spark, sf_dir):
    return jr.last_call(journal(spark, sf_dir))


@query("JRN-7", with_ctes(f"""
, b AS (SELECT competition, CAST(count_if({TOOLS_SQL}) AS BIGINT) AS total_calls,
               CAST(count_if(kind = 'tool_error') AS BIGINT) AS error_count
        FROM journal GROUP BY competition),
l AS (SELECT competition, arg_max(tool, seq) AS last_tool, max(seq) AS last_seq FROM journal WHERE {TOOLS_SQL}
      GROUP BY competition),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY seq DESC) AS rn
                        FROM journal) WHERE rn <= 10),
sig AS (SELECT competition, seq, coalesce(tool, '') AS tool, {_canon('args')} AS args FROM last WHERE {TOOLS_SQL}),
c AS (SELECT competition, tool, args, count(*) AS repeats, min(seq) AS first FROM sig GROUP BY ALL),
s AS (SELECT competition, arg_max(tool, (repeats, -first)) AS stuck_tool, max(repeats) AS stuck_repeats
      FROM c GROUP BY competition HAVING max(repeats) >= 5)
SELECT b.competition, b.total_calls, b.error_count, l.last_tool, l.last_seq, s.stuck_tool,
       CAST(s.stuck_repeats AS DOUBLE) AS stuck_repeats
FROM b LEFT JOIN l ON b.competition = l.competition LEFT JOIN s ON b.competition = s.competition""", "journal"))
def q_jrn7(spark, sf_dir):
    r = jr.resume_summary(journal(spark, sf_dir))
    return r.withColumn("stuck_repeats", F.col("stuck_repeats").cast("double"))


@query("JRN-8", with_ctes(f"""
SELECT competition, coalesce(arg_max(tool, seq), '') = 'done' AS finished
FROM journal WHERE {TOOLS_SQL} GROUP BY competition""", "journal"))
def q_jrn8(spark, sf_dir):
    return jr.run_finished(journal(spark, sf_dir))


@query("JRN-9", with_ctes(f"""
, t AS (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY seq) AS i FROM journal WHERE {TOOLS_SQL}),
lt AS (SELECT competition, arg_max(tool, seq) AS lt FROM t GROUP BY competition),
u AS (SELECT t.* FROM t JOIN lt ON t.competition = lt.competition WHERE coalesce(lt.lt, '') <> 'done')
SELECT competition, (i - 1) * 2 AS msg_no, 'model' AS role, '' AS content,
       coalesce(nullif(tool_call_id, ''), 'resume_' || CAST((i - 1) * 2 AS VARCHAR)) AS tool_call_id,
       coalesce(tool, 'unknown') AS tool_name, coalesce(args, '{{}}') AS tool_args FROM u
UNION ALL
SELECT competition, (i - 1) * 2 + 1, 'tool',
       '{{"tool": ' || to_json(coalesce(tool, 'unknown')) || ', "result": '
       || to_json(CASE WHEN kind = 'tool_call' THEN coalesce(result_summary, '') ELSE coalesce(error, '') END)
       || '}}', NULL, NULL, NULL FROM u""", "journal"))
def q_jrn9(spark, sf_dir):
    return jr.rebuild_conversation(journal(spark, sf_dir))


@query("JRN-10", with_ctes("""
, a AS (SELECT competition, count(*) AS journal_records FROM journal GROUP BY competition),
b AS (SELECT competition, count(*) AS submissions FROM subs GROUP BY competition)
SELECT coalesce(a.competition, b.competition) AS competition, coalesce(journal_records, 0) AS journal_records,
       coalesce(submissions, 0) AS submissions
FROM a FULL JOIN b ON a.competition = b.competition""", "journal", "subs"))
def q_jrn10(spark, sf_dir):
    return jr.journal_sizes(journal(spark, sf_dir), submissions(spark, sf_dir))


# --------------------------------------------------------------------------- PRJ-*
@query("PRJ-1", """
SELECT doc_id, length(t) AS out_len, md5(t) AS out_md5
FROM (SELECT doc_id, CASE WHEN length(text) > 2048 THEN '<truncated, ' || CAST(length(text) AS VARCHAR) || ' chars>'
                          ELSE text END AS t FROM documents)""")
def q_prj1(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = ft.truncate_value(F.col("text"))
    return d.select("doc_id", F.length(t).cast("bigint").alias("out_len"), F.md5(t).alias("out_md5"))


@query("PRJ-2", """
SELECT doc_id, length(t) AS out_len, md5(t) AS out_md5
FROM (SELECT doc_id, CASE WHEN length(text) > 8192 THEN substring(text, 1, 8000) || chr(10) || chr(10)
             || '[truncated, ' || CAST(length(text) - 8000 AS VARCHAR) || ' more chars]' ELSE text END AS t
      FROM documents)""")
def q_prj2(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = ft.cap_text(F.col("text"))
    return d.select("doc_id", F.length(t).cast("bigint").alias("out_len"), F.md5(t).alias("out_md5"))


@query("PRJ-2s", """
SELECT page_id, length(t) AS out_len, md5(t) AS out_md5
FROM (SELECT page_id, CASE WHEN length(html) > 8000 THEN substring(html, 1, 8000) || chr(10) || chr(10)
             || '[truncated, ' || CAST(length(html) - 8000 AS VARCHAR) || ' more chars]' ELSE html END AS t
      FROM pages)""")
def q_prj2s(spark, sf_dir):
    """Output-stream cap (threshold = kept length = 8000) on raw page HTML."""
    p = table(spark, sf_dir, "pages")
    t = ft.cap_stream(F.col("html"))
    return p.select("page_id", F.length(t).cast("bigint").alias("out_len"), F.md5(t).alias("out_md5"))


@query("PRJ-3", with_ctes("""
SELECT competition, seq,
       NULLIF(regexp_extract(result_summary, 'train_cv complete: (\\w+) \\((\\d+) folds\\)', 1), '') AS strategy,
       TRY_CAST(NULLIF(regexp_extract(result_summary, 'train_cv complete: (\\w+) \\((\\d+) folds\\)', 2), '')
                AS INTEGER) AS n_splits,
       NULLIF(regexp_extract(result_summary, 'metric=(\\w+)', 1), '') AS metric,
       TRY_CAST(NULLIF(regexp_extract(result_summary, 'mean=(-?[0-9.]+)', 1), '') AS DOUBLE) AS mean,
       TRY_CAST(NULLIF(regexp_extract(result_summary, 'std=(-?[0-9.]+)', 1), '') AS DOUBLE) AS std,
       TRY_CAST(NULLIF(regexp_extract(result_summary, 'duration_s=(-?[0-9.]+)', 1), '') AS DOUBLE) AS duration_s
FROM journal WHERE tool = 'train_cv' AND kind = 'tool_call'""", "journal"))
def q_prj3(spark, sf_dir):
    j = journal(spark, sf_dir).where((F.col("tool") == "train_cv") & (F.col("kind") == "tool_call"))
    p = fp.parse_cv_summary(F.col("result_summary"))
    return j.select("competition", "seq", p.alias("p")).select(
        "competition", "seq", "p.strategy", "p.n_splits", "p.metric", "p.mean", "p.std", "p.duration_s")


@query("PRJ-4", with_ctes("""
SELECT competition, seq, NULLIF(regexp_extract(result_summary, 'metric=(\\w+)', 1), '') AS metric,
       CASE NULLIF(regexp_extract(result_summary, 'metric=(\\w+)', 1), '')
            WHEN 'logloss' THEN false WHEN 'rmse' THEN false WHEN 'mae' THEN false ELSE true END AS higher_is_better
FROM journal WHERE tool = 'train_cv'""", "journal"))
def q_prj4(spark, sf_dir):
    j = journal(spark, sf_dir).where(F.col("tool") == "train_cv")
    m = fp.cv_metric(F.col("result_summary"))
    return j.select("competition", "seq", m.alias("metric"), fp.higher_is_better(m).alias("higher_is_better"))


@query("PRJ-5", with_ctes(f"""
SELECT competition, seq, coalesce(tool, '') AS tool, {_canon('args')} AS args
FROM journal WHERE {TOOLS_SQL}""", "journal"))
def q_prj5(spark, sf_dir):
    j = journal(spark, sf_dir).where(jr.is_tool())
    return j.select("competition", "seq", fm.args_signature(F.col("tool"), F.col("args")).alias("s")).select(
        "competition", "seq", "s.tool", "s.args")


@query("PRJ-6", with_ctes("""
SELECT competition, seq, kind, tool, array_to_string(json_keys(coalesce(args, '{}')), ', ') AS args_keys,
       substring(coalesce(NULLIF(result_summary, ''), error, ''), 1, 120) AS summary
FROM journal""", "journal"))
def q_prj6(spark, sf_dir):
    """Dashboard timeline: every record, its arg names and a 120-char summary."""
    j = journal(spark, sf_dir)
    keys = F.array_join(F.coalesce(F.map_keys(fm.args_map(F.col("args"))), F.array().cast("array<string>")), ", ")
    return j.select("competition", "seq", "kind", "tool", keys.alias("args_keys"),
                    ft.timeline_summary(F.col("result_summary"), F.col("error")).alias("summary"))


# The environment keys of the redaction binding.
_ENV_KEYS = ["API_KEY", "PATH", "GH_PAT", "HOME", "MY_BEARER_TOKEN", "SESSION_COOKIE", "DB_PASSWD", "PATTERN"]
_ENV_SQL = {
    "API_KEY": "props", "PATH": "'/usr/local/bin:/usr/bin'", "GH_PAT": "'ghp_' || CAST(event_id AS VARCHAR)",
    "HOME": "'/home/u' || CAST(user_id AS VARCHAR)", "MY_BEARER_TOKEN": "'tok' || CAST(event_id AS VARCHAR)",
    "SESSION_COOKIE": "'c=' || CAST(user_id AS VARCHAR)", "DB_PASSWD": "'pw' || CAST(event_id % 97 AS VARCHAR)",
    "PATTERN": "event_type"}


@query("PRJ-7", "\nUNION ALL\n".join(
    f"SELECT event_id, '{k}' AS key, CASE WHEN regexp_matches(upper('{k}'), '{fm.REDACT_PATTERN}') "
    f"THEN '<redacted>' ELSE {v} END AS value FROM events" for k, v in _ENV_SQL.items()))
def q_prj7(spark, sf_dir):
    """Environment maps built from event columns, redacted by key."""
    e = table(spark, sf_dir, "events")
    vals = {
        "API_KEY": F.col("props"), "PATH": F.lit("/usr/local/bin:/usr/bin"),
        "GH_PAT": F.concat(F.lit("ghp_"), F.col("event_id").cast("string")),
        "HOME": F.concat(F.lit("/home/u"), F.col("user_id").cast("string")),
        "MY_BEARER_TOKEN": F.concat(F.lit("tok"), F.col("event_id").cast("string")),
        "SESSION_COOKIE": F.concat(F.lit("c="), F.col("user_id").cast("string")),
        "DB_PASSWD": F.concat(F.lit("pw"), (F.col("event_id") % 97).cast("string")),
        "PATTERN": F.col("event_type")}
    env = F.create_map(*[x for k in _ENV_KEYS for x in (F.lit(k), vals[k])])
    return e.select("event_id", F.explode(fm.redact_map(env)).alias("key", "value"))


@query("PRJ-10", """
SELECT c_custkey, c_name AS team_name,
       coalesce(TRY_CAST(trim(CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END) AS DOUBLE),
                0.0) AS score
FROM customer""")
def q_prj10(spark, sf_dir):
    """Leaderboard score text (customers as teams; every 9th unparseable) → number."""
    c = table(spark, sf_dir, "customer")
    txt = F.when(F.col("c_custkey") % 9 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", F.col("c_name").alias("team_name"), fp.parse_score(txt).alias("score"))


@query("PRJ-11", with_ctes("SELECT competition, seq, model, round(cost_usd, 12) AS cost_usd FROM ledger", "ledger"))
def q_prj11(spark, sf_dir):
    return ledger(spark, sf_dir).select("competition", "seq", "model", F.round("cost_usd", 12).alias("cost_usd"))


@query("PRJ-12", with_ctes("SELECT competition, seq, input_tokens + output_tokens AS total_tokens FROM ledger_raw",
                           "ledger_raw"))
def q_prj12(spark, sf_dir):
    lg = ledger(spark, sf_dir)
    return lg.select("competition", "seq", usage_total(F.col("input_tokens"), F.col("output_tokens")).alias("total_tokens"))


_STATUS = [None, 400, 408, 429, 500, 404, 503, 504]
_MESSAGES = ["Rate limit exceeded", "connection reset by peer", "invalid argument",
             "Service temporarily unavailable", "model gemini-503-test not found", "Deadline exceeded"]


@query("PRJ-13", f"""
SELECT event_id, CAST(status AS DOUBLE) AS status, message,
       CASE WHEN status IS NOT NULL THEN status IN (408, 429, 500, 502, 503, 504)
            ELSE regexp_matches(lower(message), 'rate limit|temporarily unavailable|connection timeout|connection reset|deadline exceeded')
       END AS transient
FROM (SELECT event_id, [{', '.join('NULL' if s is None else str(s) for s in _STATUS)}][event_id % 8 + 1] AS status,
             [{', '.join(repr(m) for m in _MESSAGES)}][event_id % 6 + 1] AS message FROM events)""")
def q_prj13(spark, sf_dir):
    """Transient-failure classification of synthetic call outcomes (status or message)."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(s).cast("int") for s in _STATUS]), (F.col("event_id") % 8 + 1).cast("int"))
    msg = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", status.cast("double").alias("status"), msg.alias("message"),
                    fp.is_transient(status, msg).alias("transient"))


# --------------------------------------------------------------------------- FLT-*, VAL-1
@query("FLT-1", with_ctes("SELECT seq, kind, tool FROM journal WHERE competition = 7", "journal"))
def q_flt1(spark, sf_dir):
    """One competition's journal (the filter is pushed to the scan)."""
    return journal(spark, sf_dir).where(F.col("competition") == 7).select("seq", "kind", "tool")


@query("FLT-1p", with_ctes("SELECT seq, kind, tool FROM journal WHERE competition = 7", "journal"))
def q_flt1p(spark, sf_dir):
    """One competition from a log stored partitioned by competition: the filter prunes
    partitions (directories, each of the competitions of one hash) instead of reading rows."""
    from leakfree.plans.q_misc import scratch
    from leakfree.sources import io
    path = scratch(spark, "journal-partitioned")
    io.append_log(journal(spark, sf_dir), path, partition_by="competition", fmt="parquet")
    return io.only(spark.read.parquet(path), "competition", 7).select("seq", "kind", "tool")


@query("FLT-2", """
SELECT category, category IN ('observation', 'decision', 'hypothesis', 'todo') AS valid, count(*) AS n_notes
FROM (SELECT CASE event_type WHEN 'click' THEN 'observation' WHEN 'view' THEN 'decision'
                  WHEN 'signup' THEN 'hypothesis' WHEN 'purchase' THEN 'todo' ELSE 'remark' END AS category
      FROM events) GROUP BY category""")
def q_flt2(spark, sf_dir):
    """Notes split into valid categories and quarantined (unknown category) rows."""
    good, bad = jr.notes_by_category(notes(spark, sf_dir))
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.groupBy("category", "valid").agg(F.count(F.lit(1)).alias("n_notes"))


@query("FLT-3", with_ctes(f"SELECT competition, seq, ordinal, tool FROM jo WHERE {TOOLS_SQL}", "jo"))
def q_flt3(spark, sf_dir):
    return jr.tool_records(journal(spark, sf_dir)).select("competition", "seq", F.col("ordinal").cast("bigint"), "tool")


#: The tools' argument rules as a table of their own (not the library's): tool, key, type, required, enum, least, most.
_CONS = """cons(tool, key, type, required, enum, mn, mx) AS (VALUES
  ('read_context', NULL, NULL, false, NULL, NULL, NULL), ('train_cv', NULL, NULL, false, NULL, NULL, NULL),
  ('read_file', 'path', 'string', true, NULL, NULL, NULL),
  ('write_file', 'path', 'string', true, NULL, NULL, NULL), ('write_file', 'content', 'string', true, NULL, NULL, NULL),
  ('sample_rows', 'table', 'string', true, NULL, NULL, NULL), ('sample_rows', 'n', 'integer', false, NULL, 1, 100),
  ('sample_rows', 'random', 'boolean', false, NULL, NULL, NULL),
  ('take_note', 'category', 'string', true, ['observation', 'decision', 'hypothesis', 'todo'], NULL, NULL),
  ('take_note', 'content', 'string', true, NULL, NULL, NULL),
  ('set_cv', 'kind', 'string', true, ['kfold', 'stratified_kfold', 'time_series', 'group_kfold'], NULL, NULL),
  ('set_cv', 'n_splits', 'integer', false, NULL, 2, 20), ('set_cv', 'group_col', 'string', false, NULL, NULL, NULL),
  ('submit_local', 'label', 'string', true, NULL, NULL, NULL), ('done', 'summary', 'string', true, NULL, NULL, NULL),
  ('run_python', 'code', 'string', true, NULL, NULL, NULL), ('run_python', 'timeout_s', 'integer', false, NULL, 1, 600),
  ('run_python', 'memory_mb', 'integer', false, NULL, 64, 16384), ('set_metric', 'name', 'string', true, NULL, NULL, NULL),
  ('submit_kaggle', 'csv_path', 'string', true, NULL, NULL, NULL), ('submit_kaggle', 'message', 'string', true, NULL, NULL, NULL),
  ('request_human_approval', 'action', 'string', true, NULL, NULL, NULL),
  ('request_human_approval', 'evidence_json', 'string', false, NULL, NULL, NULL))"""


def _val_sql(records: str) -> str:
    return f""", {_CONS},
t AS (SELECT competition, seq, coalesce(tool, '') AS tool, coalesce(args, '{{}}') AS args FROM {records} WHERE {TOOLS_SQL}),
unknown AS (SELECT competition, seq, tool, CAST(NULL AS VARCHAR) AS key, 'unknown_tool' AS violation FROM t
            WHERE tool NOT IN (SELECT tool FROM cons)),
tk AS (SELECT *, json_valid(args) AND CASE WHEN json_valid(args) THEN json_type(args) = 'OBJECT' ELSE false END AS good
       FROM t WHERE tool IN (SELECT tool FROM cons)),
malformed AS (SELECT competition, seq, tool, CAST(NULL AS VARCHAR) AS key, 'malformed_args' AS violation FROM tk WHERE NOT good),
ok AS MATERIALIZED (SELECT competition, seq, tool, args::JSON AS args FROM tk WHERE good),
missing AS (SELECT ok.competition, ok.seq, ok.tool, c.key, 'missing_required' AS violation
            FROM ok JOIN cons c ON ok.tool = c.tool AND c.required WHERE NOT list_contains(json_keys(ok.args), c.key)),
given AS (SELECT competition, seq, tool, args, unnest(json_keys(args)) AS key FROM ok),
g2 AS (SELECT competition, seq, tool, key, json_type(args, '$."' || key || '"') AS kind,
              json_extract_string(args, '$."' || key || '"') AS value FROM given),
g3 AS (SELECT *, CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN TRY_CAST(value AS DOUBLE) END AS num FROM g2),
ch AS (SELECT g3.*, c.type, c.enum, c.mn, c.mx FROM g3 LEFT JOIN cons c ON g3.tool = c.tool AND g3.key = c.key),
bad AS (SELECT competition, seq, tool, key,
               CASE WHEN type IS NULL THEN 'unexpected_key'
                    WHEN type = 'integer' AND (num IS NULL OR num <> floor(num)) THEN 'wrong_type'
                    WHEN type = 'boolean' AND kind <> 'BOOLEAN' THEN 'wrong_type'
                    WHEN type = 'string' AND kind <> 'VARCHAR' THEN 'wrong_type'
                    WHEN enum IS NOT NULL AND NOT list_contains(enum, value) THEN 'not_in_enum'
                    WHEN type = 'integer' AND num < mn THEN 'below_minimum'
                    WHEN type = 'integer' AND num > mx THEN 'above_maximum'
               END AS violation FROM ch)
SELECT * FROM unknown UNION ALL SELECT * FROM malformed UNION ALL SELECT * FROM missing
UNION ALL SELECT * FROM bad WHERE violation IS NOT NULL"""


@query("VAL-1", with_ctes(_val_sql("journal"), "journal"))
def q_val1(spark, sf_dir):
    return jr.args_conformance(journal(spark, sf_dir))


#: Args by seq % 10: wrong types, numbers as text, malformed text, other JSON than an object, nulls, bounds.
TYPED_ARGS = ['{"table": 5}', '{"table": "t", "n": "7"}', '{"table": "t", "n": 5.0, "random": "true"}', '{"table": "t", "n": 500}',
              '{"table": ', "[1]", '{"table": null, "random": true}', '{"table": "t", "n": 0.5}', '{"table": "t", "n": 0, "x": 1}',
              '{"table": "t", "n": 12345678901234567890123}']


@query("VAL-1t", with_ctes(", j AS (SELECT * REPLACE ('sample_rows' AS tool, CASE seq % 10 " + " ".join(
    f"WHEN {i} THEN '{a}'" for i, a in enumerate(TYPED_ARGS)) + " END AS args) FROM journal)" + _val_sql("j"), "journal"))
def q_val1t(spark, sf_dir):
    """Args whose values have other JSON types than the tool's schema asks for."""
    args = F.element_at(F.array(*[F.lit(a) for a in TYPED_ARGS]), (F.col("seq") % 10 + 1).cast("int"))
    return jr.args_conformance(journal(spark, sf_dir).withColumns({"tool": F.lit("sample_rows"), "args": args}))
