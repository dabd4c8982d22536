"""Registered queries for the items the reference only declares in design documents
(SURVEY §2.15): further metrics, a permuted-target leak check, LB backfill, CV↔LB
regression, cost per day, log search, notes summary, version diff, feature importance,
subsampled CV and missingness."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakfree.functions.hashing import seeded_hash
from leakfree.operators import features as fe
from leakfree.operators import folds as cvf
from leakfree.operators import gate
from leakfree.operators import metrics as met
from leakfree.operators import models as mdl
from leakfree.operators import profile as prof
from leakfree.operators import trace as trc
from leakfree.operators.ordered import Agg, global_rank, running
from leakfree.plans.q_ml import K, _kfold, _tr
from leakfree.plans.q_ops import _GATE_SQL, _RUNS_SQL, _requests
from leakfree.plans.registry import query
from leakfree.plans.sql import h, with_ctes
from leakfree.sources.bindings import journal, ledger, notes, table, training

_PRED3 = "CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END"


def _li(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


# --------------------------------------------------------------------------- OPT-1 metrics
@query("OPT-1a", """
SELECT l_returnflag, round(sqrt(avg(power(ln(1 + l_quantity * 1000.0) - ln(1 + l_extendedprice), 2))), 6) AS rmsle
FROM lineitem GROUP BY l_returnflag""")
def q_opt1a(spark, sf_dir):
    li = _li(spark, sf_dir).withColumn("pred", F.col("l_quantity") * 1000.0)
    s = met.get("rmsle").score(li, ["l_returnflag"], "l_extendedprice", "pred", "rmsle")
    return s.select("l_returnflag", F.round("rmsle", 6).alias("rmsle"))


_F1_SQL = """
WITH d AS (SELECT l_linestatus AS g, {y} AS y, {p} AS p FROM lineitem),
cls AS (SELECT DISTINCT g, y AS c FROM d UNION SELECT DISTINCT g, p FROM d),
st AS (SELECT cls.g, cls.c,
              (SELECT count(*) FROM d WHERE d.g = cls.g AND d.y = cls.c AND d.p = cls.c) AS tp,
              (SELECT count(*) FROM d WHERE d.g = cls.g AND d.y = cls.c) AS support,
              (SELECT count(*) FROM d WHERE d.g = cls.g AND d.p = cls.c) AS npred FROM cls),
f AS (SELECT *, CASE WHEN support + npred > 0 THEN 2.0 * tp / (support + npred) ELSE 0.0 END AS f1 FROM st)
"""


@query("OPT-1b", _F1_SQL.format(y="l_returnflag", p=_PRED3) + """
SELECT g AS l_linestatus, round(avg(f1), 6) AS f1_macro FROM f GROUP BY g""")
def q_opt1b(spark, sf_dir):
    li = _li(spark, sf_dir).withColumn("pred", F.when(F.col("l_discount") < 0.03, "A")
                                       .when(F.col("l_discount") < 0.07, "N").otherwise("R"))
    s = met.get("f1_macro").score(li, ["l_linestatus"], "l_returnflag", "pred", "f1_macro")
    return s.select("l_linestatus", F.round("f1_macro", 6).alias("f1_macro"))


@query("OPT-1c", _F1_SQL.format(y="CAST(CAST(l_returnflag = 'R' AS INTEGER) AS VARCHAR)",
                                p="CAST(CAST(l_discount >= 0.05 AS INTEGER) AS VARCHAR)") + """
SELECT g AS l_linestatus, round(any_value(f1), 6) AS f1 FROM f WHERE c = '1' GROUP BY g""")
def q_opt1c(spark, sf_dir):
    li = _li(spark, sf_dir).select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                                   (F.col("l_discount") >= 0.05).cast("int").alias("pred"))
    s = met.get("f1").score(li, ["l_linestatus"], "y", "pred", "f1")
    return s.select("l_linestatus", F.round("f1", 6).alias("f1"))


@query("OPT-1d", _F1_SQL.format(y="l_returnflag", p=_PRED3) + """
SELECT g AS l_linestatus, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM f GROUP BY g""")
def q_opt1d(spark, sf_dir):
    li = _li(spark, sf_dir).withColumn("pred", F.when(F.col("l_discount") < 0.03, "A")
                                       .when(F.col("l_discount") < 0.07, "N").otherwise("R"))
    s = met.get("f1_weighted").score(li, ["l_linestatus"], "l_returnflag", "pred", "f1_weighted")
    return s.select("l_linestatus", F.round("f1_weighted", 6).alias("f1_weighted"))


_QWK_PRED = "least(7, greatest(1, CAST(round(l_quantity / 7.0) AS INTEGER)))"


@query("OPT-1e", f"""
WITH d AS (SELECT l_returnflag, CAST(l_linenumber AS DOUBLE) AS y, CAST({_QWK_PRED} AS DOUBLE) AS p FROM lineitem)
SELECT l_returnflag, round(1 - count(*) * sum(power(y - p, 2))
       / (count(*) * sum(y * y) + count(*) * sum(p * p) - 2 * sum(y) * sum(p)), 6) AS qwk
FROM d GROUP BY l_returnflag""")
def q_opt1e(spark, sf_dir):
    """Quadratic weighted kappa of line numbers (ratings 1..7) against a quantity-based guess."""
    li = _li(spark, sf_dir).select(
        "l_returnflag", F.col("l_linenumber").cast("double").alias("y"),
        F.least(F.lit(7), F.greatest(F.lit(1), F.round(F.col("l_quantity") / 7.0).cast("int"))).cast("double")
        .alias("pred"))
    s = met.get("qwk").score(li, ["l_returnflag"], "y", "pred", "qwk")
    return s.select("l_returnflag", F.round("qwk", 6).alias("qwk"))


@query("OPT-1f", """
WITH r AS (SELECT l_orderkey, CAST(l_returnflag = 'R' AS INTEGER) AS rel,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber,
                                     l_partkey, l_suppkey) AS rk FROM lineitem),
top AS (SELECT *, sum(rel) OVER (PARTITION BY l_orderkey ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits
        FROM r WHERE rk <= 3),
ap AS (SELECT l_orderkey, sum(CASE WHEN rel = 1 THEN hits / rk END) AS s FROM top GROUP BY l_orderkey),
nr AS (SELECT l_orderkey, sum(rel) AS nrel FROM r GROUP BY l_orderkey)
SELECT round(avg(coalesce(s, 0.0) / least(nrel, 3)), 6) AS map FROM ap JOIN nr USING (l_orderkey) WHERE nrel > 0""")
def q_opt1f(spark, sf_dir):
    """MAP@3: each order ranks its lines by price; relevant = returned lines."""
    li = _li(spark, sf_dir).withColumn("rel", (F.col("l_returnflag") == "R").cast("int"))
    m = met.map_at_k(li, "l_orderkey", "l_extendedprice", "rel", 3, tie=["l_linenumber", "l_partkey", "l_suppkey"])
    return m.select(F.round("map", 6).alias("map"))


@query("OPT-1g", """
SELECT l_returnflag, round((sqrt(avg(power(l_extendedprice - l_quantity * 1000.0, 2)))
                          + sqrt(avg(power(l_quantity - l_extendedprice / 1000.0, 2)))) / 2, 4) AS mcrmse
FROM lineitem GROUP BY l_returnflag""")
def q_opt1g(spark, sf_dir):
    li = _li(spark, sf_dir).select("l_returnflag", "l_extendedprice", "l_quantity",
                                   (F.col("l_quantity") * 1000.0).alias("p1"),
                                   (F.col("l_extendedprice") / 1000.0).alias("p2"))
    s = li.groupBy("l_returnflag").agg(met.mcrmse(["l_extendedprice", "l_quantity"], ["p1", "p2"]).alias("m"))
    return s.select("l_returnflag", F.round("m", 4).alias("mcrmse"))


@query("OPT-1h", """
SELECT l_returnflag, round(avg(greatest(0.9 * (l_extendedprice - l_quantity * 1000.0),
                                        -0.1 * (l_extendedprice - l_quantity * 1000.0))), 4) AS pinball
FROM lineitem GROUP BY l_returnflag""")
def q_opt1h(spark, sf_dir):
    li = _li(spark, sf_dir).withColumn("pred", F.col("l_quantity") * 1000.0)
    s = met.get("pinball_0.9").score(li, ["l_returnflag"], "l_extendedprice", "pred", "pinball")
    return s.select("l_returnflag", F.round("pinball", 4).alias("pinball"))


# --------------------------------------------------------------------------- OPT-2 permuted target
def _enc_sql(y: str, sfx: str) -> str:
    """Flagship encoding + per-fold RMSE against column ``y`` over CTE ``kp``."""
    return f"""
, folds{sfx} AS (SELECT DISTINCT fold AS tf FROM kp),
tr{sfx} AS (SELECT f.tf, k.cat, k.{y} AS y FROM kp k JOIN folds{sfx} f ON k.fold <> f.tf),
prior{sfx} AS (SELECT tf, avg(y) AS prior FROM tr{sfx} GROUP BY tf),
enc{sfx} AS (SELECT t.tf, t.cat, (sum(t.y) + 10 * any_value(p.prior)) / (count(t.y) + 10) AS te
             FROM tr{sfx} t JOIN prior{sfx} p ON t.tf = p.tf GROUP BY t.tf, t.cat),
val{sfx} AS (SELECT k.fold, k.{y} AS y, coalesce(e.te, p.prior) AS te
             FROM kp k JOIN prior{sfx} p ON k.fold = p.tf LEFT JOIN enc{sfx} e ON e.tf = k.fold AND e.cat = k.cat),
sc{sfx} AS (SELECT fold, sqrt(avg(power(y - te, 2))) AS rmse FROM val{sfx} GROUP BY fold)"""


@query("OPT-2", with_ctes(f"""
, r1 AS (SELECT row_id, cat, y_reg, fold, row_number() OVER (ORDER BY row_id) AS r FROM kf),
r2 AS (SELECT y_reg AS y_perm, row_number() OVER (ORDER BY {h('row_id', 7)}, row_id) AS r FROM kf),
kp AS (SELECT r1.*, r2.y_perm FROM r1 JOIN r2 ON r1.r = r2.r)""" + _enc_sql("y_reg", "a") + _enc_sql("y_perm", "b") + """
SELECT sca.fold, round(sca.rmse, 6) AS rmse_true, round(scb.rmse, 6) AS rmse_permuted
FROM sca JOIN scb ON sca.fold = scb.fold""", "kf"))
def q_opt2(spark, sf_dir):
    """Permuted-target leak check: the same leak-free encoding scored against a seeded
    permutation of the target must lose its skill (RMSE rises to the target's spread)."""
    folds = _kfold(spark, sf_dir)
    df = folds.df
    by_id = global_rank(df, ["row_id"], "_r1")
    by_hash = global_rank(df.select("y_reg", "row_id").withColumn("_h", seeded_hash(F.col("row_id"), 7)),
                          ["_h", "row_id"], "_r2").select(F.col("_r2").alias("_r1"), F.col("y_reg").alias("y_perm"))
    permuted = by_id.join(by_hash, "_r1").drop("_r1")
    pf = cvf.Folds(permuted, folds.n_splits, folds.name)
    true = fe.target_mean_encode(folds, "cat", "y_reg", keep=["y_reg"])
    perm = fe.target_mean_encode(pf, "cat", "y_perm", keep=["y_perm"])
    a = true.groupBy("fold").agg(met.rmse(F.col("y_reg"), F.col("te")).alias("rmse_true"))
    b = perm.groupBy("fold").agg(met.rmse(F.col("y_perm"), F.col("te")).alias("rmse_permuted"))
    return a.join(b, "fold").select(F.col("fold").cast("bigint"), F.round("rmse_true", 6).alias("rmse_true"),
                                    F.round("rmse_permuted", 6).alias("rmse_permuted"))


# --------------------------------------------------------------------------- OPT-3/4 LB backfill, CV↔LB
_LB_SQL = """,
lb AS (SELECT user_id AS competition, event_id AS seq,
              value / 1000 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS lb_score
       FROM events WHERE event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 50),
cal AS (SELECT competition, seq, coalesce(last_cv_mean, 'NaN'::DOUBLE) AS cv_score,
               CASE WHEN metric IN ('accuracy', 'auc', 'logloss') THEN 'classification' ELSE 'regression' END
               AS problem_type
        FROM req WHERE decision IN ('approve', 'skip_check')),
bf AS (SELECT cal.*, lb.lb_score FROM cal LEFT JOIN lb ON cal.competition = lb.competition AND cal.seq = lb.seq)
"""


def _backfilled(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    lb = e.where((F.col("event_type") == "purchase") & (k.cast("int") < 50)).select(
        F.col("user_id").alias("competition"), F.col("event_id").alias("seq"),
        (F.col("value") / 1000 + k.cast("double") / 100).alias("lb_new"))
    cal = gate.calibration_rows(_requests(spark, sf_dir))
    return gate.backfill_lb(cal, lb)


@query("OPT-3", with_ctes(_GATE_SQL + _LB_SQL + """
SELECT competition, seq, round(cv_score, 6) AS cv_score, round(lb_score, 6) AS lb_score FROM bf""",
                          "subs", "journal"))
def q_opt3(spark, sf_dir):
    """Leaderboard backfill of calibration rows (upsert by competition and seq)."""
    b = _backfilled(spark, sf_dir)
    return b.select("competition", "seq", F.round("cv_score", 6).alias("cv_score"),
                    F.round("lb_score", 6).alias("lb_score"))


@query("OPT-4", with_ctes(_GATE_SQL + _LB_SQL + """
SELECT problem_type, count(*) AS n, round(regr_slope(lb_score, cv_score), 6) AS slope,
       round(regr_intercept(lb_score, cv_score), 6) AS intercept, round(corr(lb_score, cv_score), 6) AS corr
FROM bf WHERE lb_score IS NOT NULL AND NOT isnan(cv_score) GROUP BY problem_type""", "subs", "journal"))
def q_opt4(spark, sf_dir):
    """CV↔LB agreement per problem type: regression slope, intercept, correlation."""
    b = _backfilled(spark, sf_dir).where(F.col("lb_score").isNotNull() & ~F.isnan("cv_score"))
    return b.groupBy("problem_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("lb_score", "cv_score"), 6).alias("slope"),
        F.round(F.regr_intercept("lb_score", "cv_score"), 6).alias("intercept"),
        F.round(F.corr("lb_score", "cv_score"), 6).alias("corr"))


# --------------------------------------------------------------------------- OPT-5 cost per day
@query("OPT-5", with_ctes("""
SELECT CAST(competition AS VARCHAR) AS competition,
       strftime(make_date(1970, 1, 1) + CAST(ts_s // 86400 AS INTEGER), '%Y-%m-%d') AS day,
       round(sum(cost_usd), 10) AS cost_usd
FROM ledger GROUP BY ROLLUP (competition, ts_s // 86400)""", "ledger"))
def q_opt5(spark, sf_dir):
    """Spend per competition per UTC day with subtotals (rollup over a 1-day window)."""
    lg = ledger(spark, sf_dir)
    # the 1-day window is aligned to the epoch; name it by its UTC date whatever the session zone
    days = F.floor(F.unix_timestamp(F.window("ts", "1 day").start) / 86400).cast("int")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    r = lg.withColumn("day", day).rollup("competition", "day").agg(F.sum("cost_usd").alias("c"))
    return r.select(F.col("competition").cast("string"), "day", F.round("c", 10).alias("cost_usd"))


# --------------------------------------------------------------------------- OPT-6 log search, notes, diff, importance
@query("OPT-6a", with_ctes("""
SELECT competition, count(*) AS hits FROM journal
WHERE lower(coalesce(result_summary, '') || ' ' || coalesce(error, '')) LIKE '%failed%' GROUP BY competition""",
                           "journal"))
def q_opt6a(spark, sf_dir):
    """Log search: records whose result or error mentions 'failed', per competition."""
    j = journal(spark, sf_dir)
    text = F.lower(F.concat_ws(" ", F.coalesce("result_summary", F.lit("")), F.coalesce("error", F.lit(""))))
    return j.where(text.contains("failed")).groupBy("competition").agg(F.count(F.lit(1)).alias("hits"))


@query("OPT-6b", """
SELECT user_id AS competition, category, count(*) AS n_notes, arg_max(props, event_id) AS last_content
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'observation' WHEN 'view' THEN 'decision'
                     WHEN 'signup' THEN 'hypothesis' WHEN 'purchase' THEN 'todo' ELSE 'remark' END AS category
      FROM events) WHERE category <> 'remark' GROUP BY ALL""")
def q_opt6b(spark, sf_dir):
    """Notes summary: per competition and valid category, how many and the latest note."""
    from leakfree.operators.journal import notes_by_category
    good, _ = notes_by_category(notes(spark, sf_dir))
    return good.groupBy("competition", "category").agg(
        F.count(F.lit(1)).alias("n_notes"), F.max_by("content", "seq").alias("last_content"))


@query("OPT-6c", with_ctes(_RUNS_SQL + """
SELECT competition, run_no, round(cv_mean - lag(cv_mean) OVER (PARTITION BY competition ORDER BY run_no), 4) AS delta
FROM runs""", "journal"))
def q_opt6c(spark, sf_dir):
    """Version diff: change of the CV mean from each successful run to the next."""
    r = trc.cv_runs(journal(spark, sf_dir))
    d = running(r, ["competition"], ["run_no"], [Agg("_prev", "last", "cv_mean")], inclusive=False)
    return d.select("competition", "run_no", F.round(F.col("cv_mean") - F.col("_prev"), 4).alias("delta"))


@query("OPT-6d", with_ctes(_tr() + """,
st AS (SELECT tf, count(*) AS n, avg(x_acct) AS m1, avg(x_days) AS m2, avg(y_reg) AS my,
              sum(x_acct * x_acct) - count(*) * avg(x_acct) * avg(x_acct) + 1.0 AS a11,
              sum(x_acct * x_days) - count(*) * avg(x_acct) * avg(x_days) AS a12,
              sum(x_days * x_days) - count(*) * avg(x_days) * avg(x_days) + 1.0 AS a22,
              sum(x_acct * y_reg) - count(*) * avg(x_acct) * avg(y_reg) AS b1,
              sum(x_days * y_reg) - count(*) * avg(x_days) * avg(y_reg) AS b2
       FROM tr GROUP BY tf),
co AS (SELECT tf, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1,
              (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM st),
sd AS (SELECT stddev_pop(x_acct) AS s1, stddev_pop(x_days) AS s2 FROM kf)
SELECT tf AS fold, 'x_acct' AS feature, round(abs(w1) * s1, 4) AS importance FROM co, sd
UNION ALL SELECT tf, 'x_days', round(abs(w2) * s2, 4) FROM co, sd""", "kf"))
def q_opt6d(spark, sf_dir):
    """Feature importance per fold: |ridge coefficient| × feature spread."""
    folds = _kfold(spark, sf_dir)
    xs = ["x_acct", "x_days"]
    coefs = mdl.fit_ridge_folds(folds, xs, "y_reg", 1.0)
    sd = folds.df.agg(*[F.stddev_pop(x).alias(x) for x in xs]).first()
    imp = coefs.select("fold", F.explode(F.array(*[F.struct(F.lit(x).alias("feature"),
                                                            (F.abs(F.col("coef")[i]) * F.lit(sd[x])).alias("imp"))
                                                   for i, x in enumerate(xs)])).alias("e"))
    return imp.select(F.col("fold").cast("bigint"), "e.feature", F.round("e.imp", 4).alias("importance"))


# --------------------------------------------------------------------------- OPT-7 subsample, OPT-8 missingness
@query("OPT-7", f"""
WITH s AS (SELECT o_orderkey AS row_id FROM orders WHERE {h('o_orderkey')} < {int(0.5 * 2 ** 32)}),
r AS (SELECT row_id, row_number() OVER (ORDER BY {h('row_id')}, row_id) - 1 AS r,
             count(*) OVER () // 5 AS q, count(*) OVER () % 5 AS m FROM s)
SELECT CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // q END AS BIGINT) AS fold,
       count(*) AS n_rows
FROM r GROUP BY ALL""")
def q_opt7(spark, sf_dir):
    """CV on a deterministic 50 % subsample (hash threshold), rows per fold."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    f = cvf.kfold(cvf.subsample(o, 0.5), K)
    return f.df.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"))


_MISS_COLS = ["row_id", "grp", "order_date", "cat", "cat_missing", "segment", "x_acct", "x_acct_missing", "x_days", "y_reg", "y_bin", "y_cls"]


@query("OPT-8", with_ctes("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS \"rows\", "
    f"round((count(*) - count({c})) / count(*), 6) AS missing_frac FROM train" for c in _MISS_COLS), "train"))
def q_opt8(spark, sf_dir):
    """Missingness per column of the training table (from the one-pass profile)."""
    p = prof.column_profile(training(spark, sf_dir))
    return p.select("column", (F.col("rows") - F.col("non_null")).alias("missing"), "rows",
                    F.round((F.col("rows") - F.col("non_null")) / F.col("rows"), 6).alias("missing_frac"))
