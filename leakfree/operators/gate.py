"""GATE-1..5, CAL-1/2: the regression-aware submission gate and calibration records.

Every rule is a running (exclusive) aggregate per competition in ``seq`` order —
prior count, prior best CV in the metric's direction, earlier ``skip_check`` for the
same trigger — computed with the split-aware ordered scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakfree.functions.parse import cv_mean, cv_metric, higher_is_better
from leakfree.operators.metrics import names_of
from leakfree.operators.ordered import Agg, running

COMP = "competition"
FIRST, REGRESSION, NON_REGRESSION = ("submit_kaggle_first", "submit_kaggle_regression",
                                     "submit_kaggle_non_regression")
# The checkpoint triggers and decisions.
TRIGGERS = ["submit_kaggle_first", "submit_kaggle_regression", "submit_kaggle_non_regression",
            "set_metric", "wall_clock_budget", "cost_budget", "memory_sustained", "agent_initiated"]
DECISIONS = ["approve", "deny", "abort", "skip_check"]
AUTO_SAFE_APPROVES = [NON_REGRESSION]


def _numeric(c: Column) -> Column:
    """A usable CV value: not null and not NaN (NaN would win every Spark max)."""
    return F.when(c.isNotNull() & ~F.isnan(c), c)


def classify_submissions(subs: DataFrame, metric: str = "metric", carry: DataFrame | None = None,
                         total_rows: int | None = None) -> DataFrame:
    """GATE-1: classify each leaderboard record against the records before it.

    first → no prior record; non-regression → priors without a numeric CV, or the CV is
    not strictly worse than the best prior CV; regression → strictly worse (a missing
    current CV counts as ∓∞).  ``carry`` (from ``gate_state``) holds what earlier records of a
    competition amount to, for rows that go on from there."""
    cv = _numeric(F.col("cv_at_submit"))
    r = running(subs.withColumn("_lf_cv", cv), [COMP], ["seq"],
                [Agg("_n_prior", "count"), Agg("_n_num", "count", "_lf_cv"),
                 Agg("_mx", "max", "_lf_cv"), Agg("_mn", "min", "_lf_cv")], inclusive=False, total_rows=total_rows)
    if carry is not None:
        base = carry.select(F.col(COMP).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in ("n_prior", "n_num", "mx", "mn")])
        r = r.join(base, F.col(COMP).eqNullSafe(F.col("_k")), "left").withColumns({
            "_n_prior": F.col("_n_prior") + F.coalesce("_c_n_prior", F.lit(0)), "_n_num": F.col("_n_num") + F.coalesce("_c_n_num", F.lit(0)),
            "_mx": F.greatest("_mx", "_c_mx"), "_mn": F.least("_mn", "_c_mn")}).drop("_k", "_c_n_prior", "_c_n_num", "_c_mx", "_c_mn")
    hib = higher_is_better(F.col(metric))
    prev_best = F.when(hib, F.col("_mx")).otherwise(F.col("_mn"))
    current = F.coalesce(F.col("_lf_cv"), F.when(hib, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    regressed = F.when(hib, current < prev_best).otherwise(current > prev_best)
    trigger = (F.when(F.col("_n_prior") == 0, F.lit(FIRST))
               .when(F.col("_n_num") == 0, F.lit(NON_REGRESSION))
               .when(regressed, F.lit(REGRESSION)).otherwise(F.lit(NON_REGRESSION)))
    return r.withColumn("trigger", trigger).withColumn(
        "prev_best", F.when(F.col("_n_num") > 0, prev_best)).drop("_lf_cv", "_n_prior", "_n_num", "_mx", "_mn")


def gate_state(subs: DataFrame, carry: DataFrame) -> DataFrame:
    """What the records so far amount to per competition: ``n_prior, n_num, mx, mn`` (order plays no part) and ``last_seq``."""
    cv = _numeric(F.col("cv_at_submit"))
    now = subs.groupBy(COMP).agg(F.count(F.lit(1)).alias("n_prior"), F.count(cv).alias("n_num"), F.max(cv).alias("mx"), F.min(cv).alias("mn"),
                                 F.max("seq").alias("last_seq"))
    both = now.alias("a").join(carry.alias("b"), F.col(f"a.{COMP}").eqNullSafe(F.col(f"b.{COMP}")), "left")
    add = lambda c: (F.col(f"a.{c}") + F.coalesce(F.col(f"b.{c}"), F.lit(0))).alias(c)
    return both.select(f"a.{COMP}", add("n_prior"), add("n_num"), F.greatest("a.mx", "b.mx").alias("mx"), F.least("a.mn", "b.mn").alias("mn"), "a.last_seq")


def running_best(journal: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """GATE-2: for every journal record, the direction-aware best and the last CV mean of
    the successful train_cv calls strictly before it.

    A summary line holds four decimals.  ``means`` (competition, seq, cv_mean: the tracked runs' scores) gives
    them in full precision, for calls that were tracked."""
    is_cv = (F.col("kind") == "tool_call") & (F.col("tool") == "train_cv")
    summary = F.coalesce(F.col("result_summary"), F.lit(""))
    if means is not None:
        full = means.select(F.col(COMP).alias("_k"), F.col("seq").alias("_s"), F.col("cv_mean").alias("_full"))
        journal = journal.join(full, F.col(COMP).eqNullSafe(F.col("_k")) & (F.col("seq") == F.col("_s")), "left").drop("_k", "_s")
    else:
        journal = journal.withColumn("_full", F.lit(None).cast("double"))
    mean = F.when(is_cv, _numeric(F.coalesce("_full", cv_mean(summary))))
    j = journal.withColumn("_m", mean).withColumn("_metric", F.when(F.col("_m").isNotNull(), cv_metric(summary)))
    r = running(j, [COMP], ["seq"], [Agg("_mx", "max", "_m"), Agg("_mn", "min", "_m"),
                                     Agg("last_cv_mean", "last", "_m"), Agg("_last_metric", "last", "_metric")],
                inclusive=False)
    hib = higher_is_better(F.col("_last_metric"))
    r = r.withColumn("best_cv_mean", F.when(hib, F.col("_mx")).otherwise(F.col("_mn")))
    r = r.drop("_m", "_metric", "_mx", "_mn", "_last_metric", "_full")
    # competitions that switched metric direction (TRAP-3: the best is not reset and each
    # record compares in its own direction) take the order-dependent running best
    from leakfree.operators.journal import cv_records, mixed_running_best
    cv = cv_records(journal, "_full")
    journal = journal.drop("_full")
    dirs = cv.groupBy(COMP).agg((F.min(F.col("hib").cast("int")) != F.max(F.col("hib").cast("int"))).alias("_mixed"))
    mixed = dirs.where("_mixed").select(COMP)
    if mixed.isEmpty():
        return r
    mcv = cv.join(mixed, COMP, "left_semi")
    after = mixed_running_best(mcv).drop("improved").join(mcv.select(COMP, "ordinal", "seq"), [COMP, "ordinal"]).drop("ordinal")
    jm = journal.join(mixed, COMP, "left_semi").join(after, [COMP, "seq"], "left")
    jm = running(jm, [COMP], ["seq"], [Agg("_mb", "last", "best_after")], inclusive=False)
    return (r.join(jm.select(COMP, "seq", "_mb"), [COMP, "seq"], "left")
            .withColumn("best_cv_mean", F.coalesce(F.col("_mb"), F.col("best_cv_mean"))).drop("_mb"))


def decide(trigger: Column, mode: str = "auto_safe", stub: str | None = None) -> Column:
    """GATE-3: auto_safe approves only non-regression submissions; stub is constant."""
    if mode == "stub":
        if stub not in DECISIONS:
            raise ValueError(f"stub decision must be one of {DECISIONS}")
        return F.lit(stub)
    if mode == "auto_safe":
        return F.when(trigger.isin(*AUTO_SAFE_APPROVES), F.lit("approve")).otherwise(F.lit("deny"))
    raise ValueError(f"unsupported batch mode {mode!r}")


def sticky_skip(requests: DataFrame, decision: str = "raw_decision") -> DataFrame:
    """GATE-4: once a trigger got ``skip_check`` in a run, later requests for it approve."""
    flag = F.when(F.col(decision) == "skip_check", F.lit(1)).otherwise(F.lit(0))
    r = running(requests.withColumn("_lf_s", flag), [COMP, "trigger"], ["seq"], [Agg("_skipped", "max", "_lf_s")],
                inclusive=False)
    return r.withColumn("decision", F.when(F.coalesce(F.col("_skipped"), F.lit(0)) == 1, F.lit("approve"))
                        .otherwise(F.col(decision))).drop("_lf_s", "_skipped")


def approved(decision: Column) -> Column:
    """GATE-5: deny / abort stop the submit; approve and skip_check let it through."""
    return decision.isin("approve", "skip_check")


def leaderboard_rows(requests: DataFrame) -> DataFrame:
    return requests.where(approved(F.col("decision"))).select(COMP, "seq", "ts", "csv", "cv_at_submit", "message")


def calibration_rows(requests: DataFrame, cv_override: str | None = None) -> DataFrame:
    """CAL-1: one row per approved submit — last CV (NaN if none), metric, problem type,
    CV strategy (override, else stratified for classification / kfold); no LB score yet."""
    metric = F.col("metric")
    problem = F.when(metric.isin(*names_of("classification")), F.lit("classification")).otherwise(F.lit("regression"))
    strategy = F.lit(cv_override) if cv_override else F.when(problem == "classification", F.lit("stratified_kfold")) \
        .otherwise(F.lit("kfold"))
    return requests.where(approved(F.col("decision"))).select(
        COMP, "seq", "ts", F.coalesce(F.col("last_cv_mean"), F.lit(float("nan"))).alias("cv_score"),
        F.lit(None).cast("double").alias("lb_score"), problem.alias("problem_type"), metric.alias("metric"),
        strategy.alias("cv_strategy"))


def backfill_lb(calibration: DataFrame, lb: DataFrame, score: str = "lb_new") -> DataFrame:
    """OPT-3: upsert leaderboard scores that arrived later into calibration rows
    (left join on competition and seq; rows without a score keep theirs)."""
    j = calibration.join(lb.select(COMP, "seq", score), [COMP, "seq"], "left")
    return j.withColumn("lb_score", F.coalesce(F.col(score), F.col("lb_score"))).drop(score)


def history(calibration: DataFrame, competition=None) -> DataFrame:
    """CAL-2: calibration records (optionally of one competition) in write order."""
    df = calibration if competition is None else calibration.where(F.col(COMP) == competition)
    return df.orderBy(COMP, "seq")
