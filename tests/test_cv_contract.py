import numpy as np
import pytest
from pyspark.sql import functions as F

from leakfree.operators import cv
from leakfree.operators import folds as cvf


def _binary(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2, x3 = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = (1.5 * x1 - 0.8 * x2 + rng.normal(0, 0.5, n) > 0).astype(int)
    rows = [(i, float(a), float(b), float(c), int(t)) for i, (a, b, c, t) in enumerate(zip(x1, x2, x3, y))]
    return spark.createDataFrame(rows, "row_id long, x1 double, x2 double, x3 double, target int")


def _regression(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    x1, x2, x3 = rng.normal(size=n), rng.normal(size=n), rng.random(n)
    y = 2 * x1 + 0.5 * x2 ** 2 - x3 + rng.normal(0, 0.3, n)
    rows = [(i, float(a), float(b), float(c), float(t)) for i, (a, b, c, t) in enumerate(zip(x1, x2, x3, y))]
    return spark.createDataFrame(rows, "row_id long, x1 double, x2 double, x3 double, target double"), float(np.std(y))


def test_classification_floors(spark):
    df = _binary(spark)
    model = cv.logistic(["x1", "x2", "x3"])
    acc = cv.train_cv(df, "target", cvf.get("stratified_kfold", 5), "accuracy", model=model)
    assert acc.mean > 0.70 and len(acc.fold_scores) == 5
    auc = cv.train_cv(df, "target", cvf.get("stratified_kfold", 5), "auc", model=model)
    assert auc.mean > 0.75
    assert auc.metadata["metric"] == "auc" and auc.metadata["problem_type"] == "classification"


def test_regression_ceiling(spark):
    df, sd = _regression(spark)
    res = cv.train_cv(df, "target", cvf.get("kfold", 5), "rmse", model=cv.Ridge(["x1", "x2", "x3"]),
                      features=cv.MeanImpute(["x1", "x2", "x3"]))
    assert res.mean < 0.7 * sd
    assert res.std == pytest.approx(float(np.std(res.fold_scores)))  # population std


def test_oof_covers_every_row_once(spark):
    df, _ = _regression(spark)
    res = cv.train_cv(df, "target", cvf.get("kfold", 5), "rmse", model=cv.Ridge(["x1"]))
    assert res.oof.count() == 500 and res.oof.select("row_id").distinct().count() == 500


def test_metadata_builtins_not_overwritten(spark):
    df, _ = _regression(spark)
    res = cv.train_cv(df, "target", cvf.get("kfold", 3), "rmse", model=cv.MeanModel(),
                      metadata_extra={"metric": "hacked", "fe_version": "fe_v01"})
    assert res.metadata["metric"] == "rmse" and res.metadata["fe_version"] == "fe_v01"


class _Dropper:
    def fit(self, train, target):
        class T:
            def transform(self, df):
                return df.limit(3)
        return T()


class _NoTransform:
    def fit(self, train, target):
        return object()


class _PeekTarget:
    seen = []

    def fit(self, train, target):
        _PeekTarget.seen.append(target in train.columns)

        class T:
            def transform(self, df):
                _PeekTarget.seen.append(target in df.columns)
                return df
        return T()


def test_contract_errors(spark):
    df, _ = _regression(spark)
    with pytest.raises(cvf.CVError, match="rows changed"):
        cv.train_cv(df, "target", cvf.get("kfold", 3), "rmse", model=cv.MeanModel(), features=_Dropper())
    with pytest.raises(cvf.CVError, match="no transform"):
        cv.train_cv(df, "target", cvf.get("kfold", 3), "rmse", model=cv.MeanModel(), features=_NoTransform())
    with pytest.raises(cvf.CVError, match="needs probabilities"):
        cv.train_cv(df.withColumn("target", (F.col("target") > 0).cast("int")), "target",
                    cvf.get("kfold", 3), "auc", model=cv.Ridge(["x1"]))


def test_target_never_reaches_transform(spark):
    df, _ = _regression(spark)
    _PeekTarget.seen.clear()
    cv.train_cv(df, "target", cvf.get("kfold", 2), "rmse", model=cv.MeanModel(), features=_PeekTarget(),
                parallelism=1)
    assert _PeekTarget.seen[0] is True and not any(_PeekTarget.seen[1:3])


def test_multiclass_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), int(t)) for i, (a, b, t) in
            enumerate(zip(rng.normal(size=300), rng.normal(size=300), rng.integers(0, 3, 300)))]
    df = spark.createDataFrame(rows, "row_id long, x1 double, x2 double, target int")
    res = cv.train_cv(df, "target", cvf.get("stratified_kfold", 3), "logloss", model=cv.logistic(["x1", "x2"]))
    p = res.oof.select(F.size("probability").alias("k"), F.aggregate("probability", F.lit(0.0),
                                                                       lambda a, x: a + x).alias("s")).toPandas()
    assert (p.k == 3).all() and np.allclose(p.s, 1.0)


def test_time_series_partial_oof(spark):
    df = spark.range(0, 120).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("target"))
    folds = cvf.time_series(df, ["row_id"], 5)
    res = cv.train_cv(df, "target", folds, "rmse", model=cv.MeanModel())
    full = cv.oof_full(res, folds.df)
    assert full.count() == 120 and full.where(F.col("prediction").isNull()).count() == 120 - 5 * 20


def test_final_fit_multiclass_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), int(t)) for i, (a, b, t) in
            enumerate(zip(rng.normal(size=300), rng.normal(size=300), rng.integers(0, 3, 300)))]
    train = spark.createDataFrame(rows, "id long, x1 double, x2 double, target int")
    test = spark.createDataFrame([(1000 + i, float(a), float(b)) for i, (a, b) in
                                  enumerate(zip(rng.normal(size=60), rng.normal(size=60)))], "id long, x1 double, x2 double")
    out = cv.fit_final_predict(train, test, "target", "id", cv.logistic(["x1", "x2"]), problem_type="classification",
                               metric="logloss")
    assert out.columns == ["id", "target_0", "target_1", "target_2"] and out.count() == 60


class _SwapRow:
    """Drops one row and duplicates another: the count stays, the ids do not."""

    def fit(self, train, target):
        class T:
            def transform(self, df):
                first = df.orderBy("row_id").limit(1)
                return df.join(first.select("row_id"), "row_id", "left_anti").unionByName(
                    df.join(df.orderBy(F.desc("row_id")).limit(1).select("row_id"), "row_id", "left_semi"))
        return T()


def test_contract_catches_drop_and_duplicate(spark):
    df, _ = _regression(spark)
    with pytest.raises(cvf.CVError, match="changed or duplicated"):
        cv.train_cv(df, "target", cvf.get("kfold", 3), "rmse", model=cv.MeanModel(), features=_SwapRow())


def test_final_fit_binary_probability_and_auto_id(spark):
    train = _binary(spark).withColumnRenamed("row_id", "PassengerId")
    test = train.drop("target").limit(100)
    out = cv.fit_final_predict(train, test, "target", "auto", cv.logistic(["x1", "x2", "x3"]),
                               problem_type="classification", metric="auc")
    assert out.columns == ["PassengerId", "target"] and out.count() == 100
    assert out.agg(F.min("target"), F.max("target")).first()[0] >= 0.0   # probabilities
    labels = cv.fit_final_predict(train, test, "target", "auto", cv.logistic(["x1", "x2", "x3"]),
                                  problem_type="classification", metric="accuracy")
    assert set(r[0] for r in labels.select("target").distinct().collect()) <= {0.0, 1.0}


def test_summary_line_round_trips_and_problem_type_checked(spark):
    from leakfree.functions.parse import parse_cv_summary
    df, _ = _regression(spark)
    res = cv.train_cv(df, "target", cvf.get("kfold", 3), "rmse", model=cv.Ridge(["x1"]))
    line = res.summary()
    p = spark.createDataFrame([(line,)], "s string").select(parse_cv_summary(F.col("s")).alias("p")).first()["p"]
    assert p["metric"] == "rmse" and p["n_splits"] == 3 and p["mean"] == pytest.approx(round(res.mean, 4))
    assert len(p["fold_scores"]) == 3
    assert res.run_row(spark, "c1", 1).first()["fe_version"] == "fe_v01"
    with pytest.raises(cvf.CVError, match="disagrees"):
        cv.train_cv(df, "target", cvf.get("kfold", 3), "rmse", model=cv.MeanModel(), problem_type="classification")


def test_training_rows_are_encoded_without_their_own_target(spark):
    """Target means inside train_cv: a row's own target can't reach its encoding, other rows get the mean of all."""
    rows = [(i, f"v{i % 4}" if i % 11 else None, float(i % 7), float((i * 37) % 101)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, c string, x double, y double")
    fit = cv.TargetMean("c", smoothing=2.0, keep=["x"]).fit
    a = {r.row_id: r for r in fit(df, "y").apply_train(df, ["y"]).collect()}
    changed = df.withColumn("y", F.when(F.col("row_id") == 17, F.lit(1e6)).otherwise(F.col("y")))
    b = {r.row_id: r for r in fit(changed, "y").apply_train(changed, ["y"]).collect()}
    assert len(a) == 200 and a[17].c_te == pytest.approx(b[17].c_te) and a[17].y != b[17].y
    assert any(a[i].c_te != pytest.approx(b[i].c_te) for i in range(200) if rows[i][1] == rows[17][1])
    mean = sum(r[3] for r in rows) / 200
    group = [r[3] for r in rows if r[1] == "v1"]
    new = spark.createDataFrame([(1, "v1", 0.0), (2, "unseen", 0.0), (3, None, 0.0)], "row_id long, c string, x double")
    got = {r.row_id: r.c_te for r in fit(df, "y").transform(new).collect()}
    assert got[1] == pytest.approx((sum(group) + 2 * mean) / (len(group) + 2))
    assert got[2] == got[3] == pytest.approx(mean)


def test_one_hot_and_chains_in_train_cv(spark):
    rows = [(i, "abc"[i % 3], None if i % 9 == 0 else float(i % 7), 10.0 * (i % 3) + (i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, c string, x double, y double")
    with pytest.raises(cvf.CVError):
        cv.OneHot("c", most=2).fit(df, "y")
    chain = cv.Chain(cv.OneHot("c"), cv.TargetMean("c"), keep=["x"])
    fitted = chain.fit(df, "y")
    assert fitted.transform(df.drop("y")).columns == ["row_id", "x", "c_0", "c_1", "c_2", "c_te"]
    res = cv.train_cv(df.na.drop(), "y", cvf.get("kfold", 3, seed=5), "rmse", model=cv.Ridge(["x", "c_0", "c_1", "c_2", "c_te"], 0.01), features=chain)
    assert res.mean < 1.0
    with pytest.raises(cvf.CVError):
        cvf.get("kfold", 3, shuffle=False)
    a = cvf.get("kfold", 3, shuffle=False, order_by=["row_id"]).apply(df).df.collect()
    assert all(r.fold == r.row_id // 30 for r in a)
