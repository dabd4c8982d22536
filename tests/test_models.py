import numpy as np
import pytest

from leakfree.operators import folds as cvf
from leakfree.operators import models as mdl


def test_ridge_folds_equal_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(400, 3))
    y = X @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(0, 0.1, 400)
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double")
    f = cvf.kfold(df, 4)
    coefs = {r["fold"]: r for r in mdl.fit_ridge_folds(f, ["a", "b", "c"], "y", alpha=1.0).collect()}
    pdf = f.df.toPandas()
    for k in range(4):
        tr = pdf[pdf.fold != k]
        Xt, yt = tr[["a", "b", "c"]].to_numpy(), tr["y"].to_numpy()
        xm, ym = Xt.mean(0), yt.mean()
        w = np.linalg.solve((Xt - xm).T @ (Xt - xm) + np.eye(3), (Xt - xm).T @ (yt - ym))
        assert np.allclose(coefs[k]["coef"], w) and coefs[k]["intercept"] == pytest.approx(ym - xm @ w)


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 2))
    y = (X @ np.array([1.2, -0.7]) + rng.normal(0, 0.7, 300) > 0).astype(float)
    rows = [(i, float(X[i, 0]), float(X[i, 1]), int(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y int")
    f = cvf.Folds(df.withColumn("fold", df.row_id * 0 + 1), 1, "all")
    oof_model = mdl.logistic_model(300, c=1.0)
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumnRenamed("y", "label"))
    m = oof_model.fit(data.withColumn("label", data.label.cast("double")))
    # Newton on C·Σ log-loss + ½‖w‖² with a free intercept
    Z = np.c_[np.ones(300), X]
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-Z @ beta))
        g = Z.T @ (p - y) + np.r_[0, beta[1:]]
        H = Z.T @ (Z * (p * (1 - p))[:, None]) + np.diag([0, 1, 1])
        beta -= np.linalg.solve(H, g)
    assert np.allclose([m.intercept, *m.coefficients], beta, atol=1e-4)
    assert f.n_splits == 1


def test_spark_ml_ridge_equals_sufficient_statistics(spark):
    from leakfree.operators import cv
    rng = np.random.default_rng(3)
    X = rng.normal(size=(500, 2)) * [3.0, 0.5]
    y = X @ np.array([2.0, -1.0]) + 4 + rng.normal(0, 2.0, 500)
    rows = [(i, float(X[i, 0]), float(X[i, 1]), float(y[i])) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double")
    a = cv.Ridge(["a", "b"], alpha=25.0).fit(df, "y", "regression", "rmse")
    b = cv.ridge_ml(["a", "b"], alpha=25.0).fit(df, "y", "regression", "rmse")
    pa = a.transform(df).select("row_id", "prediction").toPandas().sort_values("row_id")
    pb = b.transform(df).select("row_id", "prediction").toPandas().sort_values("row_id")
    assert np.allclose(pa.prediction.to_numpy(), pb.prediction.to_numpy(), atol=1e-6)
