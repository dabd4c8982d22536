import numpy as np
import pytest
from pyspark.sql import functions as F

from leakfree.operators import folds as cvf


def _binary(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = (1.5 * x1 - 0.8 * x2 + rng.normal(0, 0.5, n) > 0).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(t)) for i, (a, b, t) in enumerate(zip(x1, x2, y))],
                                 "row_id long, x1 double, x2 double, target int")


def test_unshuffled_kfold_is_contiguous(spark):
    df = spark.createDataFrame([(i, i, 0 if i < 15 else 1) for i in range(30)], "row_id long, x int, target int")
    f = cvf.kfold(df, 3, shuffle=False, order_by=["x"]).df.toPandas().sort_values("x")
    assert f["fold"].tolist() == [0] * 10 + [1] * 10 + [2] * 10


def test_kfold_disjoint_covering_balanced(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "row_id")
    f = cvf.kfold(df, 5).df
    counts = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sum(counts) == 1003 and max(counts) - min(counts) <= 1
    assert f.select("row_id").distinct().count() == 1003
    again = cvf.kfold(df, 5).df.orderBy("row_id").toPandas()["fold"]
    assert (f.orderBy("row_id").toPandas()["fold"] == again).all()  # deterministic by seed
    other = cvf.kfold(df, 5, seed=7).df.orderBy("row_id").toPandas()["fold"]
    assert not (again == other).all()


def test_stratified_class_rate(spark):
    df = _binary(spark)
    f = cvf.stratified_kfold(df, "target", 5).df
    rate = df.agg(F.avg("target")).first()[0]
    per = f.groupBy("fold").agg(F.avg("target").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r["r"] - rate) < 0.05 for r in per)
    cls = f.groupBy("fold", "target").count().toPandas()
    for _, g in cls.groupby("target"):
        assert g["count"].max() - g["count"].min() <= 1


def test_time_series_forward_only(spark):
    df = spark.range(0, 300).select(F.col("id").alias("row_id"), F.col("id").alias("t"))
    f = cvf.time_series(df, ["t"], 5)
    pdf = f.df.toPandas()
    for k in range(5):
        val = pdf[pdf.fold == k]
        train = pdf[pdf.fold < k]
        assert len(val) == 300 // 6
        assert train["t"].max() < val["t"].min()


def _lightest(counts, k):
    """Group -> fold, one group after the other."""
    load, out = [0] * k, {}
    for g, n in sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0])):
        f = load.index(min(load))
        out[g], load[f] = f, load[f] + n
    return out


@pytest.mark.parametrize("max_rows", [None, 3])
def test_group_kfold_gives_each_group_to_the_lightest_fold(spark, max_rows):
    import collections
    import random
    r = random.Random(4)
    sizes = {g: r.choice([1, 1, 1, 2, 3, 3, 7, 50, 51, 400]) for g in range(300)}
    sizes[None] = 3
    rows = [g for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(rows)], "row_id long, g long")
    for k in (2, 5, 20):
        got = cvf.group_kfold(df, "g", k, max_rows).df.collect()
        want = _lightest(collections.Counter(rows), k)
        assert len(got) == len(rows)
        assert all(x.fold == want[x.g] for x in got)


def test_deals_equal_the_lightest_fold():
    import random
    r = random.Random(9)
    for _ in range(300):
        k = r.randint(2, 8)
        sizes = sorted(r.sample(range(1, 60), r.randint(1, 8)), reverse=True)
        table = [(s, r.choice([1, 2, 3, 10, 40])) for s in sizes]
        want = _lightest({(-s, i): s for s, c in table for i in range(c)}, k)
        for s, ranks, levels, cycles in cvf._deals(iter(table), k):
            for i in range(dict(table)[s]):
                j = sum(x <= i for x in ranks)
                assert cycles[j - 1][(i - ranks[j - 1]) % j] == want[(-s, i)]


def test_group_kfold_errors(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "row_id long, g long")
    with pytest.raises(cvf.CVError):
        cvf.group_kfold(df, "g", 5)
    with pytest.raises(cvf.CVError):
        cvf.group_kfold(df, "missing", 2)


def test_registry_and_auto_select():
    assert cvf.list_strategies() == ["group_kfold", "kfold", "stratified_kfold", "time_series"]
    assert cvf.auto_select("classification").name == "stratified_kfold"
    assert cvf.auto_select("regression").name == "kfold"
    assert cvf.auto_select("regression", date_col="d").name == "time_series"
    assert cvf.auto_select("regression", date_col="d", group_col="g").name == "group_kfold"
    with pytest.raises(cvf.CVError):
        cvf.auto_select("ranking")
    with pytest.raises(cvf.CVError):
        cvf.get("nope")
    with pytest.raises(cvf.CVError):
        cvf.get("kfold", n_splits=21)
    with pytest.raises(cvf.CVError):
        cvf.get("group_kfold")


def test_register_custom_strategy(spark):
    cvf.register("even_odd", lambda df, n_splits=2, row_id="row_id", **kw:
                 cvf.Folds(df.withColumn("fold", (F.col(row_id) % 2).cast("int")), 2, "even_odd"))
    s = cvf.get("even_odd", n_splits=2)
    f = s.apply(spark.range(10).withColumnRenamed("id", "row_id"))
    assert f.df.where("fold = 1").count() == 5
