import numpy as np
import pytest
from pyspark.sql import functions as F

from leakfree.operators import features as fe
from leakfree.operators import folds as cvf
from leakfree.operators.complement import train_sums


def _folded(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 11), ["a", "b", "b", "c"][i % 4] if i % 7 else None, float(i))
            for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string, y double")
    return cvf.kfold(df, 4)


def test_complement_equals_direct(spark):
    f = _folded(spark)
    got = {r["fold"]: r for r in train_sums(f, {"s": F.col("y"), "n": F.lit(1)}).collect()}
    pdf = f.df.toPandas()
    for k in range(4):
        tr = pdf[pdf.fold != k]
        assert got[k]["s"] == pytest.approx(tr.y.sum()) and got[k]["n"] == len(tr)


def test_mean_impute_uses_training_rows_only(spark):
    f = _folded(spark)
    out = fe.mean_impute(f, ["x"], keep=["row_id"]).toPandas()
    pdf = f.df.toPandas()
    for k in range(4):
        mu = pdf[pdf.fold != k].x.mean()
        filled = out[(out.fold == k) & out.row_id.isin(pdf[pdf.x.isna()].row_id)]
        assert np.allclose(filled.x, mu)


def test_mode_ties_smallest_and_missing(spark):
    rows = [(0, "b", 0), (1, "a", 0), (2, None, 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, c string, fold int")
    f = cvf.Folds(df, 2, "given")
    modes = {r["fold"]: r["mode"] for r in fe.fit_mode_impute(f, "c").collect()}
    assert modes[1] == "a"          # a/b tie → smallest
    assert modes[0] == fe.MISSING   # training rows of fold 0 are all null


def test_one_hot_unseen_value(spark):
    rows = [(0, "a", 0), (1, "b", 0), (2, "z", 1), (3, "a", 1)]
    f = cvf.Folds(spark.createDataFrame(rows, "row_id long, c string, fold int"), 2, "given")
    out = {r["row_id"]: r for r in fe.one_hot_index(f, "c", ["row_id"]).collect()}
    assert out[2]["c_index"] is None          # z never seen in fold 1's training rows
    assert out[3]["c_index"] == 0 and out[3]["vocab_size"] == 2


def test_target_encoding_unseen_gets_prior(spark):
    rows = [(0, "a", 1.0, 0), (1, "a", 3.0, 0), (2, "b", 5.0, 1), (3, "c", 7.0, 1)]
    f = cvf.Folds(spark.createDataFrame(rows, "row_id long, c string, y double, fold int"), 2, "given")
    out = {r["row_id"]: r["te"] for r in fe.target_mean_encode(f, "c", "y", ["row_id"], smoothing=1.0).collect()}
    prior1 = 2.0  # fold 1 trains on rows 0, 1
    assert out[2] == pytest.approx(prior1) and out[3] == pytest.approx(prior1)
    prior0 = 6.0
    assert out[0] == pytest.approx(prior0)


def test_rows_report_and_assert(spark):
    f = _folded(spark)
    rep = fe.rows_report(f.df, f.df.union(f.df.limit(1)), "fold", "row_id").collect()
    assert any(r["n_after"] != r["n_before"] for r in rep)
    with pytest.raises(cvf.CVError, match=r"rows changed \(3 -> 4\)"):
        fe.assert_rows_preserved(3, 4)


def test_numeric_passthrough(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True, 1)], "id long, a double, s string, b boolean, target int")
    assert fe.numeric_columns(df, ["target"]) == ["id", "a", "b"]
