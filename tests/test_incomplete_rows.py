"""Metrics, ridge and imputation on nulls, NaN, mixed label types and values far from zero."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from leakfree.operators import cv, features, folds, metrics, models

NAN = float("nan")


def test_f1_compares_numbers_and_keeps_every_fold(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 0, 0.0), (1, 0, 0.0), (1, 0, None)], "fold int, y int, p double")
    for name, want in (("f1", [1.0, 0.0]), ("f1_macro", [1.0, 1.0]), ("f1_weighted", [1.0, 1.0])):
        got = metrics.get(name).score(df, ["fold"], "y", "p").orderBy("fold").collect()
        assert [r.score for r in got] == want, name


def test_auc_ignores_rows_without_label_or_score(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.1), (0, None, 0.95), (0, 1, None), (0, 0, NAN), (1, None, 0.5)],
                               "fold int, y int, p double")
    assert [r.score for r in metrics.auc(df, ["fold"], "y", "p").orderBy("fold").collect()] == [1.0, None]
    with pytest.raises(ValueError, match="probabilities"):
        metrics.auc(df.withColumn("p", F.array("p")), ["fold"], "y", "p")


def test_r2_counts_scored_rows_only(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 3.5), (900.0, None)], "y double, p double")
    assert df.agg(metrics.r2(F.col("y"), F.col("p"))).first()[0] == pytest.approx(0.75)


def test_mean_impute_skips_nan_in_both_forms(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, NAN), (2, 1, 3.0), (3, 1, None), (4, 1, 5.0)], "row_id int, fold int, x double")
    f = folds.Folds(df, 2, "given")
    got = {r.row_id: r.x for r in features.mean_impute(f, ["x"], ["row_id"]).collect()}
    assert got == {0: 1.0, 1: 4.0, 2: 3.0, 3: 1.0, 4: 5.0}
    step = cv.MeanImpute(["x"]).fit(df.where("fold = 1"), "fold")
    assert {r.row_id: r.x for r in step.transform(df).collect()}[1] == 4.0


def test_mode_impute_on_a_number_column(spark):
    df = spark.createDataFrame([(0, 0, None), (1, 0, 7), (2, 1, None)], "row_id int, fold int, x int")
    got = {r.row_id: r.x for r in features.mode_impute(folds.Folds(df, 2, "given"), "x", ["row_id"]).collect()}
    assert got == {0: None, 1: 7, 2: 7}


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_ridge_with_nulls_and_far_values(spark, offset):
    r = random.Random(7)
    rows = []
    for i in range(400):
        z = r.gauss(0, 1)
        x = [offset + z, None, NAN][0 if i % 5 else 1 + i % 2]
        rows.append((i, i % 3, x, 3 * z + 1))
    df = spark.createDataFrame(rows, "row_id int, fold int, x double, y double")
    per_fold = models.fit_ridge_folds(folds.Folds(df, 3, "given"), ["x"], "y", alpha=1e-9).collect()
    assert [c.coef[0] for c in per_fold] == pytest.approx([3.0] * 3, rel=1e-5)
    one = cv.Ridge(["x"], alpha=1e-9).fit(df, "y", "regression", "rmse")
    assert one.coef[0] == pytest.approx(3.0, rel=1e-5)
    with pytest.raises(folds.CVError):
        cv.Ridge(["x"]).fit(df.where("x IS NULL"), "y", "regression", "rmse")


def test_train_cv_leaves_the_callers_cache_alone(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"),
                                (F.col("id") * 2.0).alias("y"))
    f = folds.kfold(df, 3)
    assert f.df.is_cached
    res = cv.train_cv(df, "y", f, "rmse", cv.Ridge(["x"]))
    assert f.df.is_cached and f.df.storageLevel.useMemory and res.oof.count() == 60
    res.unpersist()
    f.unpersist()
