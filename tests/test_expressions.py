import pytest
from pyspark.sql import functions as F

from leakfree.functions import catalog as cat
from leakfree.functions import maps as fm
from leakfree.functions import parse as fp
from leakfree.functions import text as ft


def test_redaction(spark):
    keys = ["AUTHORIZATION", "MY_BEARER_TOKEN", "SESSION_COOKIE", "GH_PAT", "MY_CREDENTIAL", "PRIVATE_KEY",
            "DB_PASSWD", "HOME", "PATH", "PATTERN"]
    env = F.create_map(*[x for k in keys for x in (F.lit(k), F.lit("v"))])
    out = spark.range(1).select(fm.redact_map(env).alias("m")).first()["m"]
    assert all(out[k] == "<redacted>" for k in keys[:7])
    assert all(out[k] == "v" for k in keys[7:])


def test_target_and_id_detection(spark):
    frames = [("a", spark.createDataFrame([(1, 1, 1)], "Target int, class_label int, outcome_var int")),
              ("b", spark.createDataFrame([(1, 1, 1, 1)], "valid int, covid int, paranoid int, x1 int")),
              ("c", spark.createDataFrame([(1, 1)], "x1 int, entry_id int")),
              ("d", spark.createDataFrame([(1, 1)], "user_id int, Id int"))]
    c = cat.catalog(spark, frames)
    assert sorted(r["name"] for r in cat.target_candidates(c).collect()) == ["Target", "class_label"]
    ids = {r["table"]: r["id_column"] for r in cat.detect_id_column(c).collect()}
    assert ids == {"c": "entry_id", "d": "Id"}


def test_text_caps(spark):
    df = spark.createDataFrame([("x" * 9000,), ("short",)], "t string")
    r = df.select(ft.cap_text(F.col("t")).alias("c"), ft.truncate_value(F.col("t")).alias("a")).collect()
    assert r[0]["c"].endswith("[truncated, 1000 more chars]") and r[0]["c"].startswith("x" * 8000)
    assert r[0]["a"] == "<truncated, 9000 chars>" and r[1]["c"] == "short" and r[1]["a"] == "short"


def test_parse_summary_and_scores(spark):
    s = ("train_cv complete: kfold (5 folds), metric=rmse, mean=-0.1234, std=0.0100, fold_scores=[0.1, 0.2], "
         "duration_s=1.50")
    df = spark.createDataFrame([(s,), ("mean=nan metric=x",), ("mean=1.2.3",)], "s string")
    p = df.select(fp.parse_cv_summary(F.col("s")).alias("p")).collect()
    assert p[0]["p"]["mean"] == pytest.approx(-0.1234) and p[0]["p"]["n_splits"] == 5
    assert p[0]["p"]["fold_scores"] == [0.1, 0.2] and p[0]["p"]["metric"] == "rmse"
    assert p[1]["p"]["mean"] is None and p[2]["p"]["mean"] is None
    sc = spark.createDataFrame([("0.91",), ("n/a",)], "s string").select(fp.parse_score(F.col("s"))).collect()
    assert [r[0] for r in sc] == [0.91, 0.0]


def test_transient(spark):
    df = spark.createDataFrame([(429, "x"), (400, "rate limit"), (None, "Connection reset by peer"),
                                (None, "model gemini-503-test")], "status int, msg string")
    got = [r[0] for r in df.select(fp.is_transient(F.col("status"), F.col("msg"))).collect()]
    assert got == [True, False, True, False]


def test_canonical_args(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "x"}',), ('{"a": "x", "b": 1}',), (None,)], "a string")
    got = [r[0] for r in df.select(fm.canonical_args(F.col("a"))).collect()]
    assert got[0] == got[1] == '{"a":"x","b":"1"}' and got[2] == "{}"


def test_truncate_args_map_and_timeline(spark):
    m = F.create_map(F.lit("code"), F.lit("x" * 3000), F.lit("path"), F.lit("a.py"))
    out = spark.range(1).select(ft.truncate_args(m).alias("m")).first()["m"]
    assert out["code"] == "<truncated, 3000 chars>" and out["path"] == "a.py"
    df = spark.createDataFrame([("", "boom"), (None, None), ("r" * 200, "e")], "r string, e string")
    got = [x[0] for x in df.select(ft.timeline_summary(F.col("r"), F.col("e"))).collect()]
    assert got == ["boom", "", "r" * 120]
