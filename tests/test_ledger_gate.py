import numpy as np
import pytest
from pyspark.sql import functions as F

from leakfree.functions.cost import call_cost
from leakfree.operators import gate
from leakfree.operators import ledger as led


def _ledger(spark, rows):
    df = spark.createDataFrame(rows, "competition long, seq long, model string, input_tokens long, "
                                     "output_tokens long, cached_tokens long")
    return call_cost(df)


def test_prices(spark):
    lg = _ledger(spark, [(1, 0, "gemini-2.5-flash", 1000, 500, 0), (1, 1, "mystery", 1_000_000, 0, 0),
                         (1, 2, "gemini-2.5-flash", 1000, 0, 1000)])
    c = {r["seq"]: r["cost_usd"] for r in lg.collect()}
    assert c[0] == pytest.approx(0.000225)
    assert c[1] == pytest.approx(1.25)  # default rate
    assert c[2] == pytest.approx(1000 * 0.075 / 1e6 + 1000 * 0.01875 / 1e6)  # cached added on top


def test_totals_rollup_and_null_cost(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, 3.0)], "competition long, seq long, cost_usd double")
    t = {r["competition"]: r["total_usd"] for r in led.totals(df).collect()}
    assert t == {1: 1.0, 2: 3.0, None: 4.0}


def _brute_doublings(costs, budget):
    spent, cur, n = 0.0, budget, 0
    for c in costs:
        if spent > cur:
            n += 1
            cur *= 2
        spent += c
    return n


def _brute_extensions(ts, limit):
    start, n = ts[0], 0
    for t in ts:
        if t - start > limit:
            n += 1
            start = t
    return n


def test_budget_rules_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, costs, stamps = [], {}, {}
    for comp in range(6):
        m = int(rng.integers(1, 60))
        cs = rng.exponential(0.01, m)
        ts = np.cumsum(rng.integers(0, 400, m)) + 1000
        costs[comp], stamps[comp] = cs, ts
        rows += [(comp, i, float(cs[i]), int(ts[i])) for i in range(m)]
    df = spark.createDataFrame(rows, "competition long, seq long, cost_usd double, ts_s long")
    got = {r["competition"]: r["doublings"] for r in led.budget_doublings(df, 0.02).collect()}
    assert got == {c: _brute_doublings(costs[c], 0.02) for c in costs}
    ext = {r["competition"]: r["extensions"] for r in led.wall_clock_extensions(df, 900).collect()}
    assert ext == {c: _brute_extensions(stamps[c], 900) for c in stamps}
    br = {r["competition"]: r["breach_seq"] for r in led.budget_breach(df, 0.05).collect()}
    for c, cs in costs.items():
        cum = np.cumsum(cs)
        idx = np.nonzero(cum > 0.05)[0]
        assert br.get(c) == (int(idx[0]) if len(idx) else None)


def _subs(spark, rows, metric="accuracy"):
    return spark.createDataFrame([(1, i, cv, metric) for i, cv in enumerate(rows)],
                                 "competition long, seq long, cv_at_submit double, metric string")


def test_gate_classification(spark):
    t = [r["trigger"] for r in gate.classify_submissions(_subs(spark, [None, None])).orderBy("seq").collect()]
    assert t == [gate.FIRST, gate.NON_REGRESSION]
    t = [r["trigger"] for r in gate.classify_submissions(_subs(spark, [.85, .80])).orderBy("seq").collect()]
    assert t == [gate.FIRST, gate.REGRESSION]
    t = [r["trigger"] for r in gate.classify_submissions(_subs(spark, [.85, .80], "rmse")).orderBy("seq").collect()]
    assert t == [gate.FIRST, gate.NON_REGRESSION]
    t = [r["trigger"] for r in gate.classify_submissions(_subs(spark, [.85, .85, None])).orderBy("seq").collect()]
    assert t == [gate.FIRST, gate.NON_REGRESSION, gate.REGRESSION]


def test_sticky_skip_and_auto_safe(spark):
    req = spark.createDataFrame([(1, 0, "t1", "skip_check"), (1, 1, "t1", "deny"), (1, 2, "t2", "deny")],
                                "competition long, seq long, trigger string, raw_decision string")
    d = [r["decision"] for r in gate.sticky_skip(req).orderBy("seq").collect()]
    assert d == ["skip_check", "approve", "deny"]
    df = spark.createDataFrame([(gate.NON_REGRESSION,), (gate.REGRESSION,)], "trigger string")
    assert [r[0] for r in df.select(gate.decide(F.col("trigger"))).collect()] == ["approve", "deny"]


def test_running_best_with_switched_metric(spark):
    """accuracy .5, then rmse .4 (.4 < .5 → better), then accuracy .45 (> .4 → better):
    a submit after them sees .45 (max/min over all would give .5 or .4)."""
    def summ(metric, mean):
        return f"train_cv complete: kfold (5 folds), metric={metric}, mean={mean:.4f}, std=0.0"
    rows = [(1, 1, "tool_call", "train_cv", summ("accuracy", .5)), (1, 2, "tool_call", "train_cv", summ("rmse", .4)),
            (1, 3, "tool_call", "train_cv", summ("accuracy", .45)), (1, 4, "tool_call", "submit_kaggle", "ok"),
            (2, 1, "tool_call", "train_cv", summ("accuracy", .3)), (2, 2, "tool_call", "submit_kaggle", "ok")]
    j = spark.createDataFrame(rows, "competition long, seq long, kind string, tool string, result_summary string")
    got = {(r["competition"], r["seq"]): r["best_cv_mean"] for r in gate.running_best(j).collect()}
    assert got[(1, 4)] == pytest.approx(.45) and got[(1, 3)] == pytest.approx(.4) and got[(1, 2)] == pytest.approx(.5)
    assert got[(2, 2)] == pytest.approx(.3)


def test_running_best_in_full_precision(spark):
    rows = [(1, i, "tool_call", "train_cv", f"train_cv complete: kfold (5 folds), metric={m}, mean={x:.4f}, std=0.0")
            for i, (m, x) in enumerate([("auc", 0.71234567), ("auc", 0.71234999), ("auc", 0.7), ("auc", 0.8)])]
    j = spark.createDataFrame(rows, "competition long, seq long, kind string, tool string, result_summary string")
    runs = spark.createDataFrame([(1, 0, 0.71234567), (1, 1, 0.71234999), (1, 2, 0.7)], "competition long, seq long, cv_mean double")
    got = [r.best_cv_mean for r in gate.running_best(j, runs).orderBy("seq").collect()]
    assert got == [None, 0.71234567, 0.71234999, 0.71234999]
    assert [r.best_cv_mean for r in gate.running_best(j).orderBy("seq").collect()] == [None, 0.7123, 0.7123, 0.7123]
