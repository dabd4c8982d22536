"""Registered queries: the train_cv contract (CVR-1..3) and the final fit (FIN-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakfree.operators import cv
from leakfree.operators import folds as cvf
from leakfree.plans.q_ml import K, _tr
from leakfree.plans.registry import ORACLES, QUERIES, query
from leakfree.plans.sql import h, with_ctes
from leakfree.sources.bindings import training

_RIDGE_SQL = """
st AS (SELECT tf, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
              sum(x1 * x1) - count(*) * avg(x1) * avg(x1) + 1.0 AS a11,
              sum(x1 * x2) - count(*) * avg(x1) * avg(x2) AS a12,
              sum(x2 * x2) - count(*) * avg(x2) * avg(x2) + 1.0 AS a22,
              sum(x1 * y) - count(*) * avg(x1) * avg(y) AS b1,
              sum(x2 * y) - count(*) * avg(x2) * avg(y) AS b2
       FROM trx GROUP BY tf),
co AS (SELECT tf, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1,
              (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2, m1, m2, my FROM st),
cf AS (SELECT tf, w1, w2, my - w1 * m1 - w2 * m2 AS b FROM co)"""


@query("CVR-1", with_ctes(_tr() + """,
mu AS (SELECT tf, coalesce(avg(x_acct_missing), 0.0) AS mu FROM tr GROUP BY tf),
trx AS (SELECT tr.tf, coalesce(tr.x_acct_missing, mu.mu) AS x1, tr.x_days AS x2, tr.y_reg AS y
        FROM tr JOIN mu ON tr.tf = mu.tf),""" + _RIDGE_SQL + """,
val AS (SELECT k.fold, k.y_reg, c.b + c.w1 * coalesce(k.x_acct_missing, mu.mu) + c.w2 * k.x_days AS pred
        FROM kf k JOIN cf c ON k.fold = c.tf JOIN mu ON k.fold = mu.tf)
SELECT fold, round(sqrt(avg(power(y_reg - pred, 2))), 4) AS rmse FROM val GROUP BY fold""", "kf"))
def q_cvr1(spark, sf_dir):
    """train_cv: k-fold, mean imputation fitted per training fold, ridge per fold, RMSE."""
    df = training(spark, sf_dir).select("row_id", "x_acct_missing", "x_days", "y_reg")
    res = cv.train_cv(df, "y_reg", cvf.get("kfold", K), "rmse",
                      model=cv.Ridge(["x_acct_missing", "x_days"], 1.0),
                      features=cv.MeanImpute(["x_acct_missing"], passthrough=["x_days"]))
    return res.scores.select(F.col("fold").cast("bigint"), F.round("score", 4).alias("rmse"))


@query("CVR-1e", with_ctes(_tr() + f""",
s AS (SELECT tf, segment, {h('row_id', 7)} % 5 AS inn, sum(y_reg) AS sy, count(y_reg) AS n FROM tr GROUP BY ALL),
tot AS (SELECT tf, sum(sy) AS sy, sum(n) AS n FROM s GROUP BY tf),
pin AS (SELECT s.tf, inn, (any_value(tot.sy) - sum(s.sy)) / (any_value(tot.n) - sum(s.n)) AS prior FROM s JOIN tot ON s.tf = tot.tf GROUP BY s.tf, inn),
whole AS (SELECT tf, segment, sum(sy) AS sy, sum(n) AS n FROM s WHERE segment IS NOT NULL GROUP BY ALL),
te_in AS (SELECT w.tf, w.segment, pin.inn, pin.prior,
                 (w.sy - coalesce(s.sy, 0) + 10 * pin.prior) / (w.n - coalesce(s.n, 0) + 10) AS te
          FROM whole w JOIN pin ON pin.tf = w.tf LEFT JOIN s ON s.tf = w.tf AND s.segment = w.segment AND s.inn = pin.inn),
te_out AS (SELECT w.tf, w.segment, (w.sy + 10 * tot.sy / tot.n) / (w.n + 10) AS te FROM whole w JOIN tot ON tot.tf = w.tf),
trx AS (SELECT tr.tf, coalesce(e.te, pin.prior) AS x1, tr.x_days AS x2, tr.y_reg AS y
        FROM tr JOIN pin ON pin.tf = tr.tf AND pin.inn = {h('tr.row_id', 7)} % 5
        LEFT JOIN te_in e ON e.tf = tr.tf AND e.segment = tr.segment AND e.inn = pin.inn),""" + _RIDGE_SQL + """,
val AS (SELECT k.fold, k.y_reg, c.b + c.w1 * coalesce(e.te, tot.sy / tot.n) + c.w2 * k.x_days AS pred
        FROM kf k JOIN cf c ON k.fold = c.tf JOIN tot ON k.fold = tot.tf LEFT JOIN te_out e ON e.tf = k.fold AND e.segment = k.segment)
SELECT fold, round(sqrt(avg(power(y_reg - pred, 2))), 4) AS rmse FROM val GROUP BY fold""", "kf"))
def q_cvr1e(spark, sf_dir):
    """train_cv with a model fitted on target means: training rows are encoded by inner folds, validation rows by
    all training rows of their fold."""
    df = training(spark, sf_dir).select("row_id", "segment", "x_days", "y_reg")
    res = cv.train_cv(df, "y_reg", cvf.get("kfold", K), "rmse", model=cv.Ridge(["segment_te", "x_days"], 1.0),
                      features=cv.TargetMean("segment", 10.0, keep=["x_days"]))
    return res.scores.select(F.col("fold").cast("bigint"), F.round("score", 4).alias("rmse"))


class _Centred:
    """A user's own features: fitted on the training rows it is given, without the target in transform."""

    def fit(self, train, target):
        mean = train.agg(F.avg("x_acct")).first()[0]

        class _T:
            def transform(self, df):
                if target in df.columns:
                    raise AssertionError("the target reached transform")
                return df.select("row_id", (F.col("x_acct") - F.lit(mean)).alias("x1"), F.col("x_days").alias("x2"))
        return _T()


@query("FE-7", with_ctes(_tr() + """,
mu AS (SELECT tf, avg(x_acct) AS mu FROM tr GROUP BY tf),
trx AS (SELECT tr.tf, tr.x_acct - mu.mu AS x1, tr.x_days AS x2, tr.y_reg AS y FROM tr JOIN mu ON tr.tf = mu.tf),""" + _RIDGE_SQL + """
SELECT k.row_id, k.fold, round(c.b + c.w1 * (k.x_acct - mu.mu) + c.w2 * k.x_days, 4) AS prediction
FROM kf k JOIN cf c ON k.fold = c.tf JOIN mu ON k.fold = mu.tf""", "kf"))
def q_fe7(spark, sf_dir):
    """Out-of-fold predictions with features of the user's own (fit and transform only)."""
    df = training(spark, sf_dir).select("row_id", "x_acct", "x_days", "y_reg")
    res = cv.train_cv(df, "y_reg", cvf.get("kfold", K), "rmse", model=cv.Ridge(["x1", "x2"], 1.0), features=_Centred())
    return res.oof.select("row_id", F.col("fold").cast("bigint"), F.round("prediction", 4).alias("prediction"))


@query("CVR-2", with_ctes("""
, folds AS (SELECT DISTINCT fold AS tf FROM tsf WHERE fold >= 0),
mu AS (SELECT f.tf, avg(k.y_reg) AS mu FROM tsf k JOIN folds f ON k.fold < f.tf GROUP BY f.tf)
SELECT k.row_id, round(mu.mu, 6) AS prediction FROM tsf k LEFT JOIN mu ON k.fold = mu.tf""", "tsf"))
def q_cvr2(spark, sf_dir):
    """Out-of-fold assembly with partial coverage: expanding time split, mean model;
    warm-up rows are never validated and keep a null prediction."""
    df = training(spark, sf_dir).select("row_id", "order_date", "y_reg")
    folds = cvf.time_series(df, ["order_date"], K)
    res = cv.train_cv(df, "y_reg", folds, "rmse", model=cv.MeanModel())
    full = cv.oof_full(res, folds.df)
    return full.select("row_id", F.round("prediction", 6).alias("prediction"))


@query("CVR-3")
def q_cvr3(spark, sf_dir):
    """Probability selection: 3-class logistic regression keeps the whole probability row
    (width 3) and is scored by multiclass log loss per fold.  Iterative: no SQL oracle."""
    df = training(spark, sf_dir).select("row_id", "x_acct", "x_days", "y_cls")
    res = cv.train_cv(df, "y_cls", cvf.get("stratified_kfold", K), "logloss", model=cv.logistic(["x_acct", "x_days"]))
    widths = res.oof.groupBy("fold").agg(F.max(F.size("probability")).alias("width"),
                                         F.count(F.lit(1)).alias("n_val"))
    return res.scores.join(widths, "fold").select(F.col("fold").cast("bigint"), "n_val", "width",
                                                  F.round("score", 4).alias("logloss"))


@query("FIN-1", with_ctes(""",
trx AS (SELECT 0 AS tf, x_acct AS x1, x_days AS x2, y_reg AS y FROM train),""" + _RIDGE_SQL + """
SELECT t.row_id, round(c.b + c.w1 * t.x_acct + c.w2 * t.x_days, 4) AS y_reg FROM train t JOIN cf c ON c.tf = 0""",
                         "train").replace("),\n,\ntrx AS", "),\ntrx AS", 1))
def q_fin1(spark, sf_dir):
    """Final fit on the whole training table, one prediction per test row keyed by id."""
    df = training(spark, sf_dir).select("row_id", "x_acct", "x_days", "y_reg")
    out = cv.fit_final_predict(df, df, "y_reg", "row_id", model=cv.Ridge(["x_acct", "x_days"], 1.0))
    return out.select("row_id", F.round("y_reg", 4).alias("y_reg"))


@query("CVR-1b", with_ctes("""
, folds AS (SELECT DISTINCT fold AS tf FROM dskf),
tr AS (SELECT f.tf, k.lang, k.quality FROM dskf k JOIN folds f ON k.fold <> f.tf),
prior AS (SELECT tf, avg(quality) AS prior FROM tr GROUP BY tf),
enc AS (SELECT tr.tf, tr.lang, (sum(tr.quality) + 10 * any_value(p.prior)) / (count(tr.quality) + 10) AS te
        FROM tr JOIN prior p ON tr.tf = p.tf GROUP BY tr.tf, tr.lang),
val AS (SELECT k.fold, k.quality, coalesce(e.te, p.prior) AS te
        FROM dskf k JOIN prior p ON k.fold = p.tf LEFT JOIN enc e ON e.tf = k.fold AND e.lang = k.lang),
s AS (SELECT fold, te, sum(quality) AS pos, sum(1 - quality) AS neg FROM val GROUP BY fold, te),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY te
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                  THEN round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) END AS auc
FROM c GROUP BY fold""", "dskf"))
def q_cvr1b(spark, sf_dir):
    """Documents: stratified folds on the quality label, leak-free target encoding of the
    language, exact AUC of the encoding per fold."""
    from leakfree.operators import features as fe
    from leakfree.operators import metrics as met
    from leakfree.sources.bindings import documents_training

    f = cvf.stratified_kfold(documents_training(spark, sf_dir), "quality", K, 42)
    enc = fe.target_mean_encode(f, "lang", "quality", keep=["row_id", "quality"])
    auc = met.get("auc").score(enc, ["fold"], "quality", "te", "auc")
    return auc.select(F.col("fold").cast("bigint"), F.round("auc", 6).alias("auc"))


@query("CVR-3b")
def q_cvr3b(spark, sf_dir):
    """Embeddings: stratified folds over 10 classes, multinomial logistic regression on all
    64 dimensions, per-fold accuracy and probability width.  Iterative: no SQL oracle."""
    from leakfree.sources.bindings import table

    e = table(spark, sf_dir, "embeddings")
    dims = [f"e{i}" for i in range(64)]
    df = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"),
                  *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(dims)])
    res = cv.train_cv(df, "label", cvf.get("stratified_kfold", K), "accuracy", model=cv.logistic(dims))
    return res.scores.select(F.col("fold").cast("bigint"), F.round("score", 4).alias("accuracy"))


@query("MDL-2ml", with_ctes(_tr() + """,
trx AS (SELECT tr.tf, tr.x_acct AS x1, tr.x_days AS x2, tr.y_reg AS y FROM tr),""" + _RIDGE_SQL + """,
val AS (SELECT k.fold, k.y_reg, c.b + c.w1 * k.x_acct + c.w2 * k.x_days AS pred FROM kf k JOIN cf c ON k.fold = c.tf)
SELECT fold, round(sqrt(avg(power(y_reg - pred, 2))), 4) AS rmse FROM val GROUP BY fold""", "kf"))
def q_mdl2ml(spark, sf_dir):
    """Ridge (alpha=1) per fold through pyspark.ml LinearRegression with the rescaled
    regularisation — the same optimum as the one-scan sufficient-statistics ridge."""
    df = training(spark, sf_dir).select("row_id", "x_acct", "x_days", "y_reg")
    res = cv.train_cv(df, "y_reg", cvf.get("kfold", K), "rmse", model=cv.ridge_ml(["x_acct", "x_days"], 1.0))
    return res.scores.select(F.col("fold").cast("bigint"), F.round("score", 4).alias("rmse"))


def _center_fit(train, target):
    """State for the pandas transform: training-fold means (a Spark aggregation)."""
    r = train.agg(F.avg("x_acct").alias("a"), F.avg("x_days").alias("d")).first()
    return {"a": r["a"], "d": r["d"]}


def _center_apply(pdf, state):
    import pandas as pd
    return pd.DataFrame({"row_id": pdf["row_id"], "xa": pdf["x_acct"] - state["a"], "xd": pdf["x_days"] - state["d"]})


@query("UDF-1", ORACLES["MDL-2ml"])
def q_udf1(spark, sf_dir):
    """User pandas code as the feature step: per training fold, Spark computes the means
    and a pandas function centres each Arrow batch; ridge with an intercept is unchanged
    by centring, so the per-fold RMSE equals the plain ridge's."""
    df = training(spark, sf_dir).select("row_id", "x_acct", "x_days", "y_reg")
    feats = cv.PandasTransform(_center_fit, _center_apply, "row_id long, xa double, xd double")
    res = cv.train_cv(df, "y_reg", cvf.get("kfold", K), "rmse", model=cv.Ridge(["xa", "xd"], 1.0), features=feats)
    return res.scores.select(F.col("fold").cast("bigint"), F.round("score", 4).alias("rmse"))


query("UDF-2", ORACLES["MDL-2ml"])(QUERIES["MDL-2ml"])


@query("UDF-3", with_ctes(f"SELECT CAST({h('row_id', 7)} % 4 AS BIGINT) AS fold, count(*) AS n_rows "
                          "FROM train GROUP BY ALL", "train"))
def q_udf3(spark, sf_dir):
    """A strategy registered by name (hash folds with seed 7) is usable through the registry
    the moment it is registered."""
    cvf.register("hash7", lambda df, n_splits=5, row_id="row_id", **kw: cvf.kfold_hash(df, n_splits, 7, row_id))
    f = cvf.get("hash7", n_splits=4).apply(training(spark, sf_dir))
    return f.df.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("UDAF-1", """
SELECT l_returnflag, round(max(abs(l_extendedprice - l_quantity * 1000.0)), 4) AS max_error
FROM lineitem GROUP BY l_returnflag""")
def q_udaf1(spark, sf_dir):
    """A metric registered as a Column builder and scored through the registry."""
    from leakfree.operators import metrics as met
    from leakfree.sources.bindings import table
    if "max_error" not in met.list_metrics(include_optional=True):
        met.register(met.Metric("max_error", False, False, "regression",
                                column=lambda y, p: F.max(F.abs(y - p))), optional=True)
    li = table(spark, sf_dir, "lineitem").withColumn("pred", F.col("l_quantity") * 1000.0)
    s = met.get("max_error").score(li, ["l_returnflag"], "l_extendedprice", "pred", "max_error")
    return s.select("l_returnflag", F.round("max_error", 4).alias("max_error"))
