"""Registered queries: fold assignment, leak-free features, metrics, models.

Training table = orders ⋈ customer (``bindings.training``); metric inputs = lineitem.
SQL oracles build the same folds with ``row_number()`` over the same md5 order and the
training-fold statistics with an explicit ``fold <> f`` join (the oracle may be slow;
the Spark side computes every fold from one scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakfree.operators import features as fe
from leakfree.operators import folds as cvf
from leakfree.operators import metrics as met
from leakfree.operators import models as mdl
from leakfree.operators.ordered import global_rank
from leakfree.plans.registry import query
from leakfree.plans.sql import h, with_ctes
from leakfree.sources.bindings import table, training

K = 5
ROUND = 6


def _r(c, name: str, digits: int = ROUND):
    return F.round(c, digits).alias(name)


def _kfold(spark: SparkSession, sf_dir: str) -> cvf.Folds:
    return cvf.kfold(training(spark, sf_dir), K, 42, True, "row_id")


_TRAIN_FOLDS = """, folds AS (SELECT DISTINCT fold AS tf FROM {src} WHERE fold >= 0),
tr AS (SELECT f.tf, k.* FROM {src} k JOIN folds f ON {cond})
"""


def _tr(src: str = "kf", expanding: bool = False) -> str:
    cond = "k.fold < f.tf" if expanding else "k.fold <> f.tf"
    return _TRAIN_FOLDS.format(src=src, cond=cond)


# --------------------------------------------------------------------------- flagship
FLAGSHIP_SQL = with_ctes(_tr() + """,
prior AS (SELECT tf, avg(y_reg) AS prior FROM tr GROUP BY tf),
enc AS (SELECT tr.tf, tr.cat, (sum(tr.y_reg) + 10 * any_value(p.prior)) / (count(tr.y_reg) + 10) AS te
        FROM tr JOIN prior p ON tr.tf = p.tf GROUP BY tr.tf, tr.cat),
val AS (SELECT k.fold, k.y_reg, coalesce(e.te, p.prior) AS te
        FROM kf k JOIN prior p ON k.fold = p.tf LEFT JOIN enc e ON e.tf = k.fold AND e.cat = k.cat)
SELECT fold, count(*) AS n_val, round(sqrt(avg(power(y_reg - te, 2))), 6) AS rmse
FROM val GROUP BY fold""", "kf")


@query("FLAGSHIP", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-fold → target-mean encoding of the order priority → per-fold RMSE of the encoding
    used as a predictor of the order price (SURVEY §7.2 minimum slice)."""
    folds = _kfold(spark, sf_dir)
    enc = fe.target_mean_encode(folds, "cat", "y_reg", keep=["row_id", "y_reg"], smoothing=10.0)
    return enc.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_val"),
        _r(met.rmse(F.col("y_reg"), F.col("te")), "rmse")).select(
        F.col("fold").cast("bigint").alias("fold"), "n_val", "rmse")


# --------------------------------------------------------------------------- CV-0..7
@query("CV-0", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS rank
FROM lineitem""")
def q_cv0(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_extendedprice")
    r = global_rank(li, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("rank").cast("bigint"))


@query("CV-1", with_ctes("SELECT row_id, fold FROM kf", "kf"))
def q_cv1(spark, sf_dir):
    return _kfold(spark, sf_dir).df.select("row_id", F.col("fold").cast("bigint"))


@query("CV-1u", with_ctes("""
SELECT row_id, CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // q END AS BIGINT) AS fold
FROM (SELECT row_id, row_number() OVER (ORDER BY order_date, row_id) - 1 AS r,
             count(*) OVER () // 5 AS q, count(*) OVER () % 5 AS m FROM train)""", "train"))
def q_cv1u(spark, sf_dir):
    """Unshuffled k-fold: contiguous blocks of the (order_date, row_id) order."""
    f = cvf.kfold(training(spark, sf_dir), K, shuffle=False, order_by=["order_date"])
    return f.df.select("row_id", F.col("fold").cast("bigint"))


@query("CV-1h", f"SELECT row_id, {h('row_id')} % 5 AS fold FROM train".replace(
    "SELECT", "WITH train AS (SELECT o_orderkey AS row_id FROM orders) SELECT", 1))
def q_cv1h(spark, sf_dir):
    """Hash fast path: no shuffle, balanced in expectation."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return cvf.kfold_hash(df, K, 42).df.select("row_id", F.col("fold").cast("bigint"))


@query("CV-2", with_ctes("SELECT row_id, y_cls, fold FROM skf", "skf"))
def q_cv2(spark, sf_dir):
    f = cvf.stratified_kfold(training(spark, sf_dir), "y_cls", K, 42)
    return f.df.select("row_id", F.col("y_cls").cast("int"), F.col("fold").cast("bigint"))


@query("CV-3", with_ctes("SELECT row_id, fold FROM tsf", "tsf"))
def q_cv3(spark, sf_dir):
    f = cvf.time_series(training(spark, sf_dir), ["order_date"], K)
    return f.df.select("row_id", F.col("fold").cast("bigint"))


@query("CV-4", "WITH RECURSIVE " + with_ctes("""
, sizes AS (SELECT grp, count(*) AS n FROM train GROUP BY grp),
ranked AS MATERIALIZED (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp) AS rn FROM sizes),
lpt(rn, loads, fold) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], (-1)::BIGINT
  UNION ALL
  SELECT r.rn, list_transform(l.loads, lambda x, i: CASE WHEN i = list_position(l.loads, list_min(l.loads)) THEN x + r.n ELSE x END),
         (list_position(l.loads, list_min(l.loads)) - 1)::BIGINT
  FROM lpt l JOIN ranked r ON r.rn = l.rn + 1)
SELECT t.row_id, lpt.fold FROM train t JOIN ranked r ON t.grp = r.grp JOIN lpt ON lpt.rn = r.rn""", "train")[len("WITH "):])
def q_cv4(spark, sf_dir):
    """Group k-fold by customer, every order's fold: the largest group to the lightest fold."""
    f = cvf.group_kfold(training(spark, sf_dir), "grp", K)
    return f.df.select("row_id", F.col("fold").cast("bigint"))


@query("CV-7", with_ctes("""
SELECT fold, y_cls, count(*) AS n_rows FROM skf GROUP BY fold, y_cls""", "skf"))
def q_cv7(spark, sf_dir):
    """Fold report of stratified k-fold: rows per (fold, class)."""
    f = cvf.stratified_kfold(training(spark, sf_dir), "y_cls", K, 42)
    rep = cvf.fold_report(f, label="y_cls")
    return rep.select(F.col("fold").cast("bigint"), F.col("y_cls").cast("int"), "n_rows")


# --------------------------------------------------------------------------- FE-1..6
@query("FE-1", with_ctes(_tr() + """,
st AS (SELECT tf, coalesce(avg(x_acct_missing), 0.0) AS mean FROM tr GROUP BY tf)
SELECT k.row_id, k.fold, round(coalesce(k.x_acct_missing, s.mean), 6) AS x_acct_missing
FROM kf k JOIN st s ON k.fold = s.tf""", "kf"))
def q_fe1(spark, sf_dir):
    out = fe.mean_impute(_kfold(spark, sf_dir), ["x_acct_missing"], keep=["row_id"])
    return out.select("row_id", F.col("fold").cast("bigint"), _r(F.col("x_acct_missing"), "x_acct_missing"))


@query("FE-2", with_ctes(_tr() + """,
cnt AS (SELECT tf, cat_missing, count(*) AS c FROM tr WHERE cat_missing IS NOT NULL GROUP BY tf, cat_missing),
mode AS (SELECT tf, arg_min(cat_missing, (-c, cat_missing)) AS mode FROM cnt GROUP BY tf)
SELECT k.row_id, k.fold, coalesce(k.cat_missing, m.mode, 'MISSING') AS cat_missing
FROM kf k LEFT JOIN mode m ON k.fold = m.tf""", "kf"))
def q_fe2(spark, sf_dir):
    out = fe.mode_impute(_kfold(spark, sf_dir), "cat_missing", keep=["row_id"])
    return out.select("row_id", F.col("fold").cast("bigint"), "cat_missing")


@query("FE-3", with_ctes(_tr("tsf", True) + """,
vocab AS (SELECT DISTINCT tf, cat FROM tr),
idx AS (SELECT tf, cat, row_number() OVER (PARTITION BY tf ORDER BY cat) - 1 AS cat_index FROM vocab),
sz AS (SELECT tf, count(*) AS vocab_size FROM vocab GROUP BY tf)
SELECT k.row_id, k.fold, i.cat_index, coalesce(s.vocab_size, 0) AS vocab_size
FROM tsf k LEFT JOIN idx i ON i.tf = k.fold AND i.cat = k.cat LEFT JOIN sz s ON s.tf = k.fold
WHERE k.fold >= 0""", "tsf"))
def q_fe3(spark, sf_dir):
    """One-hot vocabulary from the training fold of an expanding time split."""
    f = cvf.time_series(training(spark, sf_dir), ["order_date"], K)
    out = fe.one_hot_index(f, "cat", keep=["row_id"])
    return out.select("row_id", F.col("fold").cast("bigint"), F.col("cat_index").cast("bigint"), "vocab_size")


@query("FE-3x", with_ctes(_tr() + """,
vocab AS (SELECT DISTINCT tf, cat FROM tr WHERE cat IS NOT NULL),
idx AS (SELECT tf, cat, row_number() OVER (PARTITION BY tf ORDER BY cat) - 1 AS i FROM vocab)
SELECT k.row_id, k.fold, """ + ", ".join(f"CAST(coalesce(i.i = {j}, false) AS INTEGER) AS cat_{j}" for j in range(5)) + """
FROM kf k LEFT JOIN idx i ON i.tf = k.fold AND i.cat = k.cat""", "kf"))
def q_fe3x(spark, sf_dir):
    """The one-hot columns themselves, from the training vocabulary of each k-fold."""
    out = fe.one_hot(fe.one_hot_index(_kfold(spark, sf_dir), "cat", keep=["row_id"]), "cat")
    return out.select("row_id", F.col("fold").cast("bigint"), *[f"cat_{j}" for j in range(5)])


@query("FE-4", with_ctes("""
SELECT row_id, grp, x_acct, x_acct_missing, x_days, y_bin, y_cls FROM train""", "train"))
def q_fe4(spark, sf_dir):
    """Numeric pass-through: the numeric columns except the target (y_reg)."""
    out = fe.numeric_passthrough(training(spark, sf_dir), "y_reg")
    return out.select(*[F.col(c).cast("bigint") if c in ("row_id", "grp") else
                        (F.col(c).cast("int") if c in ("y_bin", "y_cls") else F.col(c)) for c in out.columns])


@query("FE-5", with_ctes(_tr("tsf", True) + """,
prior AS (SELECT tf, avg(y_reg) AS prior FROM tr GROUP BY tf),
enc AS (SELECT tr.tf, tr.segment, (sum(tr.y_reg) + 10 * any_value(p.prior)) / (count(tr.y_reg) + 10) AS te
        FROM tr JOIN prior p ON tr.tf = p.tf GROUP BY tr.tf, tr.segment)
SELECT k.row_id, k.fold, round(coalesce(e.te, p.prior), 6) AS te
FROM tsf k JOIN prior p ON k.fold = p.tf LEFT JOIN enc e ON e.tf = k.fold AND e.segment = k.segment""", "tsf"))
def q_fe5(spark, sf_dir):
    """Target-mean encoding of the customer segment on an expanding time split."""
    f = cvf.time_series(training(spark, sf_dir), ["order_date"], K)
    out = fe.target_mean_encode(f, "segment", "y_reg", keep=["row_id"], smoothing=10.0)
    return out.select("row_id", F.col("fold").cast("bigint"), _r(F.col("te"), "te"))


@query("FE-6", with_ctes("""
SELECT fold, count(*) AS n_before, count(*) AS n_after, count(DISTINCT row_id) AS n_distinct_after
FROM kf GROUP BY fold""", "kf"))
def q_fe6(spark, sf_dir):
    """Rows-preserved report of a fold transform (validation rows in, encoded rows out)."""
    folds = _kfold(spark, sf_dir)
    after = fe.target_mean_encode(folds, "cat", "y_reg", keep=["row_id"])
    rep = fe.rows_report(folds.df, after, "fold", "row_id")
    return rep.select(F.col("fold").cast("bigint"), "n_before", "n_after", "n_distinct_after")


# --------------------------------------------------------------------------- MET-1..9
def _li(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_linestatus", "l_returnflag", "l_discount", "l_extendedprice", "l_quantity",
        (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query("MET-1", """
SELECT l_linestatus, round(avg(CAST((l_returnflag = 'R') = (l_discount >= 0.05) AS DOUBLE)), 6) AS accuracy
FROM lineitem GROUP BY l_linestatus""")
def q_met1(spark, sf_dir):
    li = _li(spark, sf_dir).withColumn("pred", (F.col("l_discount") >= 0.05).cast("int"))
    s = met.get("accuracy").score(li, ["l_linestatus"], "y", "pred", "accuracy")
    return s.select("l_linestatus", _r(F.col("accuracy"), "accuracy"))


@query("MET-2", """
WITH s AS (SELECT l_linestatus, l_discount, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS neg
           FROM lineitem GROUP BY l_linestatus, l_discount),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY l_linestatus ORDER BY l_discount
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT l_linestatus, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc
FROM c GROUP BY l_linestatus""")
def q_met2(spark, sf_dir):
    """Exact AUC with ties: return flag R scored by the discount, per line status."""
    s = met.get("auc").score(_li(spark, sf_dir), ["l_linestatus"], "y", "l_discount", "auc")
    return s.select("l_linestatus", _r(F.col("auc"), "auc"))


@query("MET-3", """
SELECT l_linestatus, round(-avg(CASE WHEN l_returnflag = 'R'
         THEN ln(least(greatest(l_discount * 10, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
         ELSE ln(1 - least(greatest(l_discount * 10, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END), 6)
       AS logloss
FROM lineitem GROUP BY l_linestatus""")
def q_met3(spark, sf_dir):
    li = _li(spark, sf_dir).withColumn("p", F.col("l_discount") * 10)
    s = met.get("logloss").score(li, ["l_linestatus"], "y", "p", "logloss")
    return s.select("l_linestatus", _r(F.col("logloss"), "logloss"))


_REG_SQL = """
SELECT l_returnflag, round({expr}, 4) AS {name}
FROM lineitem GROUP BY l_returnflag"""


def _reg_query(name: str):
    def fn(spark, sf_dir):
        li = _li(spark, sf_dir).withColumn("pred", F.col("l_quantity") * 1000.0)
        s = met.get(name).score(li, ["l_returnflag"], "l_extendedprice", "pred", name)
        return s.select("l_returnflag", _r(F.col(name), name, 4))
    fn.__doc__ = f"{name} of a quantity-based price guess per return flag."
    return fn


query("MET-4", _REG_SQL.format(expr="sqrt(avg(power(l_extendedprice - l_quantity * 1000.0, 2)))",
                               name="rmse"))(_reg_query("rmse"))
query("MET-5", _REG_SQL.format(expr="avg(abs(l_extendedprice - l_quantity * 1000.0))",
                               name="mae"))(_reg_query("mae"))
query("MET-6", _REG_SQL.format(
    expr="1 - sum(power(l_extendedprice - l_quantity * 1000.0, 2)) / (var_pop(l_extendedprice) * count(*))",
    name="r2"))(_reg_query("r2"))


@query("MET-8", with_ctes(_tr() + """,
prior AS (SELECT tf, avg(y_reg) AS prior FROM tr GROUP BY tf),
enc AS (SELECT tr.tf, tr.cat, (sum(tr.y_reg) + 10 * any_value(p.prior)) / (count(tr.y_reg) + 10) AS te
        FROM tr JOIN prior p ON tr.tf = p.tf GROUP BY tr.tf, tr.cat),
val AS (SELECT k.fold, k.y_reg, coalesce(e.te, p.prior) AS te
        FROM kf k JOIN prior p ON k.fold = p.tf LEFT JOIN enc e ON e.tf = k.fold AND e.cat = k.cat),
sc AS (SELECT fold, sqrt(avg(power(y_reg - te, 2))) AS score FROM val GROUP BY fold)
SELECT count(*) AS n_folds, round(avg(score), 6) AS cv_mean, round(stddev_pop(score), 6) AS cv_std FROM sc""",
    "kf"))
def q_met8(spark, sf_dir):
    """CV summary (mean, population std of fold scores) of the flagship encoding."""
    folds = _kfold(spark, sf_dir)
    enc = fe.target_mean_encode(folds, "cat", "y_reg", keep=["row_id", "y_reg"])
    scores = met.get("rmse").score(enc, ["fold"], "y_reg", "te")
    s = met.cv_summary(scores)
    return s.select("n_folds", _r(F.col("cv_mean"), "cv_mean"), _r(F.col("cv_std"), "cv_std"))


# --------------------------------------------------------------------------- MDL-1..3
@query("MDL-1", with_ctes(_tr("skf") + """,
maj AS (SELECT tf, arg_min(y_bin, (-c, y_bin)) AS pred
        FROM (SELECT tf, y_bin, count(*) AS c FROM tr GROUP BY tf, y_bin) GROUP BY tf),
mu AS (SELECT tf, avg(y_reg) AS mu FROM tr GROUP BY tf)
SELECT k.fold, CAST(any_value(m.pred) AS INTEGER) AS majority,
       round(avg(CAST(k.y_bin = m.pred AS DOUBLE)), 6) AS accuracy,
       round(sqrt(avg(power(k.y_reg - u.mu, 2))), 6) AS rmse
FROM skf k JOIN maj m ON k.fold = m.tf JOIN mu u ON k.fold = u.tf GROUP BY k.fold""", "skf"))
def q_mdl1(spark, sf_dir):
    """Chance baselines per fold: majority class (accuracy) and training mean (RMSE)."""
    f = cvf.stratified_kfold(training(spark, sf_dir), "y_cls", K, 42)
    maj = mdl.majority_baseline(f, "y_bin")
    mu = mdl.mean_baseline(f, "y_reg")
    val = fe.val_rows(f).join(F.broadcast(maj), "fold").join(F.broadcast(mu), "fold")
    return val.groupBy("fold").agg(
        F.first("majority").cast("int").alias("majority"),
        _r(met.accuracy(F.col("y_bin"), F.col("majority")), "accuracy"),
        _r(met.rmse(F.col("y_reg"), F.col("mean")), "rmse")).withColumn("fold", F.col("fold").cast("bigint"))


@query("MDL-2", with_ctes(_tr() + """,
st AS (SELECT tf, count(*) AS n, avg(x_acct) AS m1, avg(x_days) AS m2, avg(y_reg) AS my,
              sum(x_acct * x_acct) - count(*) * avg(x_acct) * avg(x_acct) + 1.0 AS a11,
              sum(x_acct * x_days) - count(*) * avg(x_acct) * avg(x_days) AS a12,
              sum(x_days * x_days) - count(*) * avg(x_days) * avg(x_days) + 1.0 AS a22,
              sum(x_acct * y_reg) - count(*) * avg(x_acct) * avg(y_reg) AS b1,
              sum(x_days * y_reg) - count(*) * avg(x_days) * avg(y_reg) AS b2
       FROM tr GROUP BY tf),
co AS (SELECT tf, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1,
              (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2, m1, m2, my FROM st),
cf AS (SELECT tf, w1, w2, my - w1 * m1 - w2 * m2 AS b FROM co)
SELECT k.fold, round(any_value(c.b), 4) AS intercept, round(any_value(c.w1), 6) AS coef_x_acct,
       round(any_value(c.w2), 6) AS coef_x_days,
       round(sqrt(avg(power(k.y_reg - (c.b + c.w1 * k.x_acct + c.w2 * k.x_days), 2))), 4) AS rmse
FROM kf k JOIN cf c ON k.fold = c.tf GROUP BY k.fold""", "kf"))
def q_mdl2(spark, sf_dir):
    """Ridge (alpha=1, intercept) on two features for all folds from one scan."""
    folds = _kfold(spark, sf_dir)
    xs = ["x_acct", "x_days"]
    coefs = mdl.fit_ridge_folds(folds, xs, "y_reg", alpha=1.0)
    pred = mdl.predict_linear(fe.val_rows(folds), coefs, xs)
    sc = pred.groupBy("fold").agg(_r(met.rmse(F.col("y_reg"), F.col("prediction")), "rmse", 4))
    return coefs.join(sc, "fold").select(
        F.col("fold").cast("bigint"), _r(F.col("intercept"), "intercept", 4),
        _r(F.col("coef")[0], "coef_x_acct"), _r(F.col("coef")[1], "coef_x_days"), "rmse")


#: Newton's method for the same objective (sum of losses + half the squared weights, the intercept free), features in thousands.
_NEWTON = """,
x AS (SELECT tf, x_acct / 1000 AS x1, x_days / 1000 AS x2, y_bin AS y FROM tr),
nw(it, tf, b, v1, v2) AS (
  SELECT 0, tf, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM folds
  UNION ALL
  SELECT it + 1, tf,
         b - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
         v1 - (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
         v2 - (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
        FROM (SELECT it, tf, any_value(b) AS b, any_value(v1) AS v1, any_value(v2) AS v2, sum(p - y) AS g0,
                     sum((p - y) * x1) + 1e-6 * any_value(v1) AS g1, sum((p - y) * x2) + 1e-6 * any_value(v2) AS g2,
                     sum(s) AS h00, sum(s * x1) AS h01, sum(s * x2) AS h02, sum(s * x1 * x1) + 1e-6 AS h11,
                     sum(s * x1 * x2) AS h12, sum(s * x2 * x2) + 1e-6 AS h22
              FROM (SELECT *, p * (1 - p) AS s FROM (SELECT nw.*, x.x1, x.x2, x.y, 1 / (1 + exp(-(b + v1 * x1 + v2 * x2))) AS p
                                                     FROM nw JOIN x ON x.tf = nw.tf WHERE nw.it < 12))
              GROUP BY it, tf))),
val AS (SELECT k.fold, k.y_bin AS y, 1 / (1 + exp(-(b + v1 * x_acct / 1000 + v2 * x_days / 1000))) AS p
        FROM skb k JOIN nw ON nw.tf = k.fold AND nw.it = 12),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk FROM val)
SELECT fold, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 4) AS auc,
       round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 4) AS logloss
FROM r GROUP BY fold"""


@query("MDL-3", "WITH RECURSIVE " + with_ctes("""
, skb AS (SELECT * EXCLUDE (r), CAST(r % 5 AS BIGINT) AS fold
          FROM (SELECT *, row_number() OVER (ORDER BY y_bin, """ + h("row_id") + """, row_id) - 1 AS r FROM train))"""
                                              + _tr("skb") + _NEWTON, "train")[len("WITH "):])
def q_mdl3(spark, sf_dir):
    """Logistic regression (C=1, L2, no standardisation) per fold; per-fold AUC and logloss."""
    f = cvf.stratified_kfold(training(spark, sf_dir), "y_bin", K, 42)
    oof = mdl.logistic_oof(f, ["x_acct", "x_days"], "y_bin", c=1.0)
    auc = met.get("auc").score(oof, ["fold"], "y_bin", "p1", "auc")
    ll = met.get("logloss").score(oof, ["fold"], "y_bin", "p1", "logloss")
    return auc.join(ll, "fold").select(F.col("fold").cast("bigint"), _r(F.col("auc"), "auc", 4),
                                       _r(F.col("logloss"), "logloss", 4))


@query("CV-5", with_ctes("SELECT fold, y_cls, count(*) AS n_rows FROM skf GROUP BY fold, y_cls", "skf"))
def q_cv5(spark, sf_dir):
    """Auto-selected strategy for a classification target (no group/date column): the
    stratified split it picks, as rows per (fold, class)."""
    strategy = cvf.auto_select("classification", K)
    f = strategy.apply(training(spark, sf_dir), label="y_cls", row_id="row_id")
    return f.df.groupBy(F.col("fold").cast("bigint").alias("fold"), F.col("y_cls").cast("int").alias("y_cls")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("CV-6", with_ctes("""
SELECT row_id, CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // q END AS BIGINT) AS fold
FROM (SELECT row_id, row_number() OVER (ORDER BY """ + h("row_id") + """, row_id) - 1 AS r,
             count(*) OVER () // 10 AS q, count(*) OVER () % 10 AS m FROM train)""", "train"))
def q_cv6(spark, sf_dir):
    """Registry override: the strategy chosen by name with 10 splits (validated 2..20)."""
    f = cvf.get("kfold", n_splits=10).apply(training(spark, sf_dir), label="y_reg", row_id="row_id")
    return f.df.select("row_id", F.col("fold").cast("bigint"))
