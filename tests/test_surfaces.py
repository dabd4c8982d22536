import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leakfree.operators import cv
from leakfree.operators import folds as cvf
from leakfree.operators import metrics as met
from leakfree.operators import profile as prof
from leakfree.sources import io


def test_csv_source_and_missing_path(spark):
    d = tempfile.mkdtemp(prefix="lf-csv-", dir="/tmp")
    with open(os.path.join(d, "train.csv"), "w") as f:
        f.write("PassengerId,Survived,Age,Sex\n1,0,22.0,male\n2,1,,female\n")
    df = io.read_table(spark, os.path.join(d, "train.csv"), fmt="csv")
    assert dict(df.dtypes)["Age"] == "double" and df.count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, os.path.join(d, "test.csv"), fmt="csv")


def test_brief_profile_and_targets(spark):
    rows = [(i, i % 2, 3, None if i == 9 else 20.0 + i, "male" if i % 2 else "female") for i in range(10)]
    df = spark.createDataFrame(rows, "PassengerId long, Survived int, Pclass int, Age double, Sex string")
    b = prof.brief(spark, {"train": df, "test": None})
    p = {r["column"]: r for r in b["tables"]["train"]["profile"].collect()}
    assert p["Age"]["non_null"] == 9 and p["Age"]["rows"] == 10 and p["Sex"]["n_distinct"] == 2
    assert [r["name"] for r in b["targets"].collect()] == ["Survived"]
    assert b["messages"] == ["table 'test' is missing"]


def test_custom_metric_and_problem_type(spark):
    met.register(met.Metric("max_error", False, False, "regression",
                            column=lambda y, p: F.max(F.abs(y - p))), optional=True)
    df = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("target"))
    res = cv.train_cv(df, "target", cvf.get("kfold", 5), "max_error", model=cv.MeanModel())
    assert res.metadata["problem_type"] == "regression" and all(s > 0 for s in res.fold_scores)


def test_pandas_transform_adapter(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"),
                                F.col("id").cast("double").alias("target"))

    def fit(train, target):
        return {"mu": train.agg(F.avg("x")).first()[0]}

    def apply(pdf: pd.DataFrame, state) -> pd.DataFrame:
        return pd.DataFrame({"row_id": pdf["row_id"], "xc": pdf["x"] - state["mu"]})

    feats = cv.PandasTransform(fit, apply, "row_id long, xc double")
    res = cv.train_cv(df, "target", cvf.get("kfold", 4), "rmse", model=cv.Ridge(["xc"]), features=feats)
    assert len(res.fold_scores) == 4 and res.oof.count() == 40


def test_write_predictions_header(spark):
    d = tempfile.mkdtemp(prefix="lf-sub-", dir="/tmp")
    out = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, target double")
    io.write_predictions(out, d + "/sub", single_file=True)
    files = [f for f in os.listdir(d + "/sub") if f.endswith(".csv")]
    assert len(files) == 1
    with open(os.path.join(d, "sub", files[0])) as f:
        assert f.readline().strip() == "id,target"
