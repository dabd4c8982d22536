import json

import pytest

from leakfree.operators import journal as jr

SCHEMA = ("competition long, seq long, kind string, tool string, args string, result_summary string, "
          "error string, tool_call_id string")


def _j(spark, recs, comp=1):
    rows = []
    for i, r in enumerate(recs):
        rows.append((comp, i, r.get("kind"), r.get("tool"), json.dumps(r["args"]) if "args" in r else None,
                     r.get("result_summary"), r.get("error"), r.get("tool_call_id")))
    return spark.createDataFrame(rows, SCHEMA)


def call(tool, **kw):
    return {"kind": "tool_call", "tool": tool, "args": kw.pop("args", {}), **kw}


def cv_call(mean, metric=None):
    seg = f", metric={metric}" if metric else ""
    return call("train_cv", result_summary=f"train_cv complete: kfold (5 folds){seg}, mean={mean:.4f}, std=0.0")


def test_counts_and_first_submission(spark):
    recs = [call("read_file"), call("write_file"), call("train_cv"), call("submit_kaggle")]
    b = jr.behaviour(_j(spark, recs)).first()
    assert b["turns_per_run"] == 4 and b["turns_to_first_submission"] == 4
    assert jr.behaviour(_j(spark, recs[:3])).first()["turns_per_run"] == 3


def test_best_score_direction(spark):
    b = jr.best_score(_j(spark, [cv_call(.5, "accuracy"), cv_call(.8, "accuracy"), cv_call(.7, "accuracy")])).first()
    assert b["best_cv_mean"] == pytest.approx(.8) and b["turns_to_best_score"] == 2
    b = jr.best_score(_j(spark, [cv_call(.5, "rmse"), cv_call(.3, "rmse"), cv_call(.4, "rmse")])).first()
    assert b["best_cv_mean"] == pytest.approx(.3) and b["turns_to_best_score"] == 2
    b = jr.best_score(_j(spark, [cv_call(-.1, "r2")])).first()
    assert b["best_cv_mean"] == pytest.approx(-.1)
    b = jr.best_score(_j(spark, [cv_call(.3), cv_call(.2)])).first()   # no metric → higher is better
    assert b["best_cv_mean"] == pytest.approx(.3)


def test_best_score_mixed_metrics_is_ordered(spark):
    # accuracy .5, then rmse .4 (lower wins → .4 < .5 → better), then accuracy .45 (> .4 → better)
    recs = [cv_call(.5, "accuracy"), cv_call(.4, "rmse"), cv_call(.45, "accuracy")]
    b = jr.best_score(_j(spark, recs)).first()
    assert b["best_cv_mean"] == pytest.approx(.45) and b["turns_to_best_score"] == 3


def test_failure_rate(spark):
    recs = [call("a"), {"kind": "tool_error", "tool": "b", "error": "x"}, call("c")]
    b = jr.behaviour(_j(spark, recs)).first()
    assert b["error_count"] == 1 and b["tool_call_failure_rate"] == pytest.approx(1 / 3)


def test_stuck_loop(spark):
    recs = [call("read_file", args={"path": "x"}) for _ in range(5)] + [call("train_cv")]
    s = jr.stuck_loop(_j(spark, recs)).first()
    assert s["stuck"] and s["repeats"] == 5 and s["tool"] == "read_file"
    varied = [call("read_file", args={"path": str(i)}) for i in range(8)]
    assert not jr.stuck_loop(_j(spark, varied)).first()["stuck"]


def test_checkpoint_not_counted_nor_last(spark):
    recs = [call("train_cv"), {"kind": "checkpoint"}]
    assert jr.behaviour(_j(spark, recs)).first()["turns_per_run"] == 1
    assert jr.last_call(_j(spark, recs)).first()["tool"] == "train_cv"


def test_rebuild_conversation(spark):
    recs = [call("read_file", args={"path": "a"}, result_summary="ok", tool_call_id="c1"),
            {"kind": "checkpoint"},
            {"kind": "tool_error", "tool": "train_cv", "args": {}, "error": "boom"}]
    msgs = jr.rebuild_conversation(_j(spark, recs)).orderBy("msg_no").collect()
    assert [m["role"] for m in msgs] == ["model", "tool", "model", "tool"]
    assert msgs[0]["tool_call_id"] == "c1" and msgs[2]["tool_call_id"] == "resume_2"
    assert json.loads(msgs[3]["content"]) == {"tool": "train_cv", "result": "boom"}
    done = _j(spark, recs + [call("done")])
    assert jr.rebuild_conversation(done).count() == 0
    assert jr.run_finished(done).first()["finished"]


def test_args_conformance(spark):
    recs = [call("sample_rows", args={"table": "t", "n": 500}), call("take_note", args={"category": "bad",
                                                                                    "content": "c"}),
            call("set_cv", args={"kind": "kfold", "extra": 1}), call("nope"), call("read_file")]
    v = {(r["tool"], r["key"], r["violation"]) for r in jr.args_conformance(_j(spark, recs)).collect()}
    assert ("sample_rows", "n", "above_maximum") in v
    assert ("take_note", "category", "not_in_enum") in v
    assert ("set_cv", "extra", "unexpected_key") in v
    assert ("nope", None, "unknown_tool") in v
    assert ("read_file", "path", "missing_required") in v


def test_notes_category(spark):
    notes = spark.createDataFrame([(1, 0, "todo", "x"), (1, 1, "whatever", "y")],
                                  "competition long, seq long, category string, content string")
    good, bad = jr.notes_by_category(notes, "todo")
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        jr.notes_by_category(notes, "whatever")


def test_mixed_direction_chunked_fold_equals_brute_force(spark):
    import random

    from leakfree.functions.parse import METRIC_DIRECTION
    rnd = random.Random(7)
    recs, expect = [], {}
    for comp in range(5):
        best, turn = None, None
        for i in range(1, rnd.randint(2, 40)):
            metric = rnd.choice(["accuracy", "rmse", "r2", "mae"])
            mean = round(rnd.random(), 4)
            recs.append((comp, i, metric, mean))
            hib = METRIC_DIRECTION[metric]
            if best is None or (mean > best if hib else mean < best):
                best, turn = mean, i
        expect[comp] = (best, turn)
    df = spark.createDataFrame(recs, "competition long, ordinal long, metric string, mean double")
    df = df.withColumn("hib", df.metric.isin("accuracy", "r2"))
    for chunk in (3, 1000):
        got = {r["competition"]: (r["best_cv_mean"], r["turns_to_best_score"])
               for r in jr._mixed_best(df, chunk_rows=chunk).collect()}
        assert got == expect


def test_next_version_keeps_gaps_and_ignores_others(spark):
    from leakfree.operators import trace as trc
    files = spark.createDataFrame([("fe_v01.py",), ("fe_v04.py",), ("fe_vx.py",), ("model_v02.py",), ("notes.md",)],
                                  "name string")
    assert trc.next_version(files, "fe").first()[0] == 5
    assert trc.next_version(files, "model").first()[0] == 3
    assert trc.next_version(files.where("name = 'notes.md'"), "fe").first()[0] == 1
    with pytest.raises(ValueError):
        trc.next_version(files, "data")


def test_span_tree_depth_is_not_capped(spark):
    from leakfree.operators import trace as trc
    rows = [("t", f"s{i}", None if i == 0 else f"s{i - 1}", "OK") for i in range(25)]
    rows.append(("t", "orphan", "missing", "OK"))
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, status string")
    got = {r["span_id"]: r["depth"] for r in trc.resolve_tree(spans).collect()}
    assert got["s24"] == 24 and got["orphan"] is None
