import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakfree.operators import metrics as met


def _score(spark, name, y, p, schema="y double, p double"):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], schema)
    return met.get(name).score(df, [], "y", "p").first()["score"]


def test_metric_vectors(spark):
    assert _score(spark, "accuracy", [0, 1, 1, 0, 1], [0, 1, 1, 0, 1]) == 1.0
    assert _score(spark, "accuracy", [0, 1, 1, 0, 1], [1, 0, 0, 1, 0]) == 0.0
    assert _score(spark, "auc", [0, 0, 1, 1], [.1, .2, .8, .9]) == 1.0
    assert _score(spark, "logloss", [0, 1, 1, 0], [.01, .99, .99, .01]) < 0.05
    assert _score(spark, "rmse", [1, 2, 3], [1.5, 2.5, 3.5]) == pytest.approx(0.5)
    assert _score(spark, "mae", [1, 2, 3], [1.5, 2.5, 3.5]) == pytest.approx(0.5)
    assert _score(spark, "r2", [1, 2, 3, 4], [1, 2, 3, 4]) == 1.0


def test_r2_zero_variance(spark):
    assert _score(spark, "r2", [2, 2, 2], [2, 2, 2]) == 1.0
    assert _score(spark, "r2", [2, 2, 2], [1, 2, 3]) == 0.0


def test_directions_pinned():
    expected = {"accuracy": True, "auc": True, "r2": True, "logloss": False, "rmse": False, "mae": False}
    assert met.list_metrics() == sorted(expected)
    for name, hib in expected.items():
        assert met.get(name).higher_is_better is hib
    with pytest.raises(KeyError):
        met.get("no_such_metric")


def test_auc_with_ties_equals_pairwise(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(3):
        y = rng.integers(0, 2, 200)
        s = np.round(rng.random(200), 1)  # many ties
        rows += [(g, int(a), float(b)) for a, b in zip(y, s)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    got = {r["g"]: r["score"] for r in met.auc(df, ["g"], "y", "s").collect()}
    for g in range(3):
        pos = [s for gg, y, s in rows if gg == g and y == 1]
        neg = [s for gg, y, s in rows if gg == g and y == 0]
        pair = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
        assert got[g] == pytest.approx(pair / (len(pos) * len(neg)))


def test_auc_split_path_equals_plain(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 3000), rng.random(3000))]
    df = spark.createDataFrame(rows, "y int, s double").withColumn("g", F.lit(1))
    plain = met.auc(df, ["g"], "y", "s").first()["score"]
    spark.conf.set("spark.leakfree.scan.maxRowsPerTask", "100")
    try:
        split = met.auc(df, ["g"], "y", "s").first()["score"]
    finally:
        spark.conf.unset("spark.leakfree.scan.maxRowsPerTask")
    assert split == pytest.approx(plain)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert met.auc(df, [], "y", "s").first()["score"] is None


def test_multiclass_logloss(spark):
    df = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (2, [0.1, 0.1, 0.8])], "y int, p array<double>")
    got = met.get("logloss").score(df, [], "y", "p").first()["score"]
    assert got == pytest.approx(-(math.log(0.7) + math.log(0.8)) / 2)


def test_cv_summary_population_std(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7)], "fold int, score double")
    r = met.cv_summary(df).first()
    assert r["cv_mean"] == pytest.approx(0.6) and r["cv_std"] == pytest.approx(0.1)
