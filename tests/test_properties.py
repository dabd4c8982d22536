"""Property tests of the fold invariants over random sizes and fold counts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakfree.functions.cost import cost_expr
from leakfree.operators import folds as cvf

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(n=st.integers(min_value=20, max_value=400), k=st.integers(min_value=2, max_value=20),
       seed=st.integers(min_value=0, max_value=10_000))
def test_kfold_partitions_rows_evenly(spark, n, k, seed):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    f = cvf.kfold(df, k, seed).df
    counts = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    f.unpersist()
    assert sorted(counts) == list(range(k)) and sum(counts.values()) == n
    q, m = divmod(n, k)
    assert all(counts[i] == q + (1 if i < m else 0) for i in range(k))


@SETTINGS
@given(n=st.integers(min_value=30, max_value=300), k=st.integers(min_value=2, max_value=6),
       classes=st.integers(min_value=2, max_value=4))
def test_stratified_per_class_balance(spark, n, k, classes):
    df = spark.range(n).select(F.col("id").alias("row_id"), ((F.col("id") * 7919) % classes).alias("y"))
    f = cvf.stratified_kfold(df, "y", k).df
    per = f.groupBy("y", "fold").count().toPandas()
    for _, g in per.groupby("y"):
        assert g["count"].max() - g["count"].min() <= 1
    f.unpersist()


@SETTINGS
@given(n=st.integers(min_value=12, max_value=300), k=st.integers(min_value=2, max_value=5))
def test_time_series_expanding_windows(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 3 % 101).alias("t"))
    f = cvf.time_series(df, ["t"], k)
    pdf = f.df.toPandas()
    f.unpersist()
    ts = n // (k + 1)
    for i in range(k):
        val, train = pdf[pdf.fold == i], pdf[pdf.fold < i]
        assert len(val) == ts and len(train) == n - (k - i) * ts
        last_train = max(zip(train.t, train.row_id))
        first_val = min(zip(val.t, val.row_id))
        assert last_train < first_val   # forward only, in the (t, row_id) order


def test_cached_tokens_are_cheaper_and_added(spark):
    r = spark.range(1).select(
        cost_expr(F.lit(1000), F.lit(0), F.lit(0), F.lit(1.25), F.lit(0.3125), F.lit(10.0)).alias("inp"),
        cost_expr(F.lit(0), F.lit(1000), F.lit(0), F.lit(1.25), F.lit(0.3125), F.lit(10.0)).alias("cached"),
        cost_expr(F.lit(1000), F.lit(1000), F.lit(0), F.lit(1.25), F.lit(0.3125), F.lit(10.0)).alias("both")).first()
    assert r["cached"] < r["inp"] and abs(r["both"] - (r["inp"] + r["cached"])) < 1e-15
