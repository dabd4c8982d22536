import numpy as np
from pyspark.sql import functions as F

from leakfree.operators.ordered import Agg, global_rank, running


def test_split_path_equals_plain_window(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    aggs = [Agg("n", "count"), Agg("s", "sum", "value"), Agg("mx", "max", "value"), Agg("mn", "min", "value"),
            Agg("lst", "last", F.when(F.col("event_type") == "purchase", F.col("value")))]
    for inclusive in (True, False):
        a = running(ev, ["user_id"], ["event_id"], aggs, inclusive).orderBy("event_id").toPandas()
        b = running(ev, ["user_id"], ["event_id"], aggs, inclusive, max_rows=3).orderBy("event_id").toPandas()
        for c in ["n", "s", "mx", "mn", "lst"]:
            assert np.allclose(a[c].astype(float).fillna(-1), b[c].astype(float).fillna(-1))


def test_global_rank_matches_sort(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 50, 2000)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(vals)], "id long, v long")
    for max_rows in (None, 97):
        r = global_rank(df, ["v", "id"], max_rows=max_rows).orderBy("id").toPandas()
        expected = np.empty(len(vals), dtype=int)
        expected[np.lexsort((np.arange(len(vals)), vals))] = np.arange(len(vals))
        assert (r["rank"].to_numpy() == expected).all()


def test_large_global_order_is_range_partitioned(spark):
    """Above the per-task cap the global order is a range-partitioned sort, never a
    single-partition window; a low-cardinality leading column still splits."""
    df = spark.range(0, 1000).withColumn("v", F.col("id") % 3)
    r = global_rank(df, ["v", "id"], max_rows=100)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = r.orderBy("id").toPandas()["rank"].to_numpy()
    vals = (np.arange(1000) % 3)
    expected = np.empty(1000, dtype=int)
    expected[np.lexsort((np.arange(1000), vals))] = np.arange(1000)
    assert (got == expected).all()


def test_keyed_split_runs_per_sub_range(spark):
    ev = spark.range(0, 1000).withColumn("k", F.lit(1))
    plan = running(ev, ["k"], ["id"], [Agg("n", "count")], max_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "_lf_sub" in plan


def test_hot_key_with_tied_leading_column(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), int(v), i, float(x)) for i, (k, v, x) in
            enumerate(zip(rng.choice([1, 1, 1, 2, 3], 3000), rng.integers(0, 3, 3000), rng.random(3000)))]
    df = spark.createDataFrame(rows, "k long, v long, id long, x double")
    aggs = [Agg("n", "count"), Agg("s", "sum", "x"), Agg("mx", "max", "x")]
    a = running(df, ["k"], ["v", "id"], aggs).orderBy("id").toPandas()
    b = running(df, ["k"], ["v", "id"], aggs, max_rows=50).orderBy("id").toPandas()
    for c in ["n", "s", "mx"]:
        assert np.allclose(a[c].astype(float), b[c].astype(float))


def test_large_rank_survives_cache_loss(spark):
    """Above the cap the ranked table is checkpointed: dropping every cached block and
    recomputing gives the same ranks."""
    df = spark.range(0, 2000).withColumn("v", (F.col("id") * 37) % 11)
    r = global_rank(df, ["v", "id"], max_rows=150)
    first = r.orderBy("id").toPandas()["rank"].to_numpy()
    spark.catalog.clearCache()
    again = r.orderBy("id").toPandas()["rank"].to_numpy()
    assert (first == again).all() and sorted(first) == list(range(2000))
