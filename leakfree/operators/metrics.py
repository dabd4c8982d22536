"""MET-1..9 and UDAF-1: metrics as aggregate Columns usable under any groupBy.

Exact AUC is not a plain aggregate: it is computed from (positives, negatives) per
distinct score with a running sum (hot groups split, see ``ordered.running``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakfree.functions.directions import declare
from leakfree.operators.ordered import Agg, running

LOGLOSS_EPS = 2.220446049250313e-16  # float64 machine epsilon


def accuracy(y: Column, pred: Column) -> Column:
    return F.avg((y == pred).cast("double"))


def rmse(y: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - pred, 2)))


def mae(y: Column, pred: Column) -> Column:
    return F.avg(F.abs(y - pred))


def r2(y: Column, pred: Column) -> Column:
    """Over the rows with a target and a prediction (time-series warm-up rows have none)."""
    scored = F.when(pred.isNotNull(), y)
    ss_res = F.sum(F.pow(y - pred, 2))
    ss_tot = F.var_pop(scored) * F.count(scored)
    return F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - ss_res / ss_tot)


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(LOGLOSS_EPS)), F.lit(1 - LOGLOSS_EPS))


def logloss_binary(y: Column, p: Column) -> Column:
    pc = _clip(p)
    return -F.avg(F.when(y == 1, F.log(pc)).otherwise(F.log(F.lit(1.0) - pc)))


def logloss_multi(y: Column, probs: Column) -> Column:
    return -F.avg(F.log(_clip(F.element_at(probs, (y + 1).cast("int")))))


def auc(df: DataFrame, by: list[str], y: str, score: str, out: str = "score") -> DataFrame:
    """Exact ROC AUC with ties (Mann-Whitney): Σ pos·(neg below + neg tied / 2) / (P·N).

    One aggregation to (group, score) → (pos, neg), then a running sum of negatives per
    group; a group without positives or negatives has no AUC (null).  Rows without a label or
    a score (null, NaN) count on neither side; class probabilities of K > 2 have no AUC."""
    if dict(df.dtypes)[score].startswith("array"):
        raise ValueError("AUC needs one score per row, got an array of class probabilities")
    lab, value = F.col(y).cast("double"), F.col(score).cast("double")
    scored = value.isNotNull() & ~F.isnan(value)
    per_score = df.groupBy(*by, score).agg(
        F.sum(F.when(scored & (lab == 1), 1).otherwise(0)).alias("_lf_pos"),
        F.sum(F.when(scored & (lab != 1) & ~F.isnan(lab), 1).otherwise(0)).alias("_lf_neg"))
    run = running(per_score, by, [score], [Agg("_lf_below", "sum", "_lf_neg")], inclusive=False)
    contrib = F.col("_lf_pos") * (F.coalesce(F.col("_lf_below"), F.lit(0)) + F.col("_lf_neg") / 2.0)
    g = run.groupBy(*by).agg(F.sum(contrib).alias("_lf_u"), F.sum("_lf_pos").alias("_lf_p"),
                             F.sum("_lf_neg").alias("_lf_n"))
    return g.select(*by, F.when((F.col("_lf_p") > 0) & (F.col("_lf_n") > 0),
                                F.col("_lf_u") / (F.col("_lf_p") * F.col("_lf_n"))).alias(out))


# ---------------------------------------------------------------- registry
@dataclass(frozen=True)
class Metric:
    name: str
    higher_is_better: bool
    needs_proba: bool
    kind: str  # classification | regression
    column: Callable[[Column, Column], Column] | None = None
    frame: Callable[[DataFrame, list[str], str, str, str], DataFrame] | None = None

    def score(self, df: DataFrame, by: list[str], y: str, pred: str, out: str = "score") -> DataFrame:
        """Scores per ``by`` group (e.g. per fold) in one job."""
        if self.frame is not None:
            return self.frame(df, by, y, pred, out)
        agg = self.column(F.col(y).cast("double"), F.col(pred))
        return (df.groupBy(*by).agg(agg.alias(out)) if by else df.agg(agg.alias(out)))


def _logloss_frame(df: DataFrame, by: list[str], y: str, pred: str, out: str) -> DataFrame:
    is_array = dict(df.dtypes)[pred].startswith("array")
    fn = logloss_multi if is_array else logloss_binary
    agg = fn(F.col(y).cast("int"), F.col(pred))
    return df.groupBy(*by).agg(agg.alias(out)) if by else df.agg(agg.alias(out))


_REGISTRY: dict[str, Metric] = {}
_OPTIONAL: dict[str, Metric] = {}


def register(metric: Metric, optional: bool = False) -> None:
    """UDAF-1: add a metric (Column builder or frame function) to the registry.
    ``optional`` metrics are resolvable by name but not listed with the core six."""
    (_OPTIONAL if optional else _REGISTRY)[metric.name] = metric
    declare(metric.name, metric.higher_is_better)


register(Metric("accuracy", True, False, "classification", column=accuracy))
register(Metric("auc", True, True, "classification", frame=auc))
register(Metric("logloss", False, True, "classification", frame=_logloss_frame))
register(Metric("rmse", False, False, "regression", column=rmse))
register(Metric("mae", False, False, "regression", column=mae))
register(Metric("r2", True, False, "regression", column=r2))


def get(name: str) -> Metric:
    if name in _REGISTRY:
        return _REGISTRY[name]
    if name in _OPTIONAL:
        return _OPTIONAL[name]
    raise KeyError(f"metric '{name}' not in registry; known: {sorted(_REGISTRY)}")


def list_metrics(include_optional: bool = False) -> list[str]:
    return sorted({**_REGISTRY, **_OPTIONAL} if include_optional else _REGISTRY)


def names_of(kind: str) -> list[str]:
    """Every registered metric of a kind, optional ones included."""
    return sorted(m.name for m in {**_REGISTRY, **_OPTIONAL}.values() if m.kind == kind)


def metric_dim(spark, include_optional: bool = False) -> DataFrame:
    """The registry as a dimension table (name, higher_is_better, needs_proba, kind)."""
    metrics = {**_REGISTRY, **_OPTIONAL} if include_optional else _REGISTRY
    rows = [(m.name, m.higher_is_better, m.needs_proba, m.kind) for m in metrics.values()]
    return spark.createDataFrame(rows, "name string, higher_is_better boolean, needs_proba boolean, kind string")


def cv_summary(scores: DataFrame, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """MET-8: mean and population std of the fold scores (not pooled out-of-fold)."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("n_folds"), F.avg(score).alias("cv_mean"),
            F.stddev_pop(score).alias("cv_std")]
    return scores.groupBy(*by).agg(*aggs) if by else scores.agg(*aggs)


# ---------------------------------------------------------------- OPT-1: further metrics
def rmsle(y: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(F.pow(F.log1p(pred) - F.log1p(y), 2)))


def pinball(alpha: float):
    def fn(y: Column, pred: Column) -> Column:
        d = y - pred
        return F.avg(F.greatest(F.lit(alpha) * d, F.lit(alpha - 1) * d))
    return fn


def qwk(y: Column, pred: Column) -> Column:
    """Quadratic weighted kappa of integer ratings as plain aggregates: with weights
    (i-j)², Σ w·O = Σ(y-p)² and Σ w·E = (n·Σy² + n·Σp² − 2·Σy·Σp) / n."""
    n = F.count(y)
    num = n * F.sum(F.pow(y - pred, 2))
    den = n * F.sum(y * y) + n * F.sum(pred * pred) - 2 * F.sum(y) * F.sum(pred)
    return F.when(den != 0, F.lit(1.0) - num / den)


def f1_frame(average: str):
    """F1 from one count table of (label, prediction): ``binary`` (class 1), ``macro`` or ``weighted``.

    Labels and predictions are compared as numbers unless both are strings.  Rows without either
    aren't scored; a group that never sees class 1 has binary F1 0, one without scored rows has null
    macro and weighted F1."""
    def frame(df: DataFrame, by: list[str], y: str, pred: str, out: str) -> DataFrame:
        types = dict(df.dtypes)
        kind = "string" if types[y] == types[pred] == "string" else "double"
        pairs = df.groupBy(*by, F.col(y).try_cast(kind).alias("_y"), F.col(pred).try_cast(kind).alias("_p")).agg(
            F.count(F.lit(1)).alias("_n"))
        seen = F.col("_y").isNotNull() & F.col("_p").isNotNull()
        none = F.lit(0).cast("long")
        hit = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(none)
        sides = F.array(
            F.struct(F.when(seen, F.col("_y")).alias("_c"), F.col("_n").alias("support"), none.alias("npred"), hit.alias("tp")),
            F.struct(F.when(seen, F.col("_p")).alias("_c"), none.alias("support"), F.col("_n").alias("npred"), none.alias("tp")))
        c = pairs.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*").groupBy(*by, "_c").agg(
            F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("npred").alias("npred"))
        f1 = F.when(F.col("_c").isNotNull(), 2 * F.col("tp") / (F.col("support") + F.col("npred")))
        support = F.when(F.col("_c").isNotNull(), F.col("support"))
        one = F.lit("1") if kind == "string" else F.lit(1.0)
        value = {"binary": F.coalesce(F.max(F.when(F.col("_c") == one, f1)), F.lit(0.0)),
                 "macro": F.avg(f1),
                 "weighted": F.try_divide(F.sum(f1 * support), F.sum(support))}[average]
        return c.groupBy(*by).agg(value.alias(out))
    return frame


def map_at_k(df: DataFrame, query: str, score: str, relevant: str, k: int, by: list[str] | None = None,
             tie: list[str] | None = None) -> DataFrame:
    """MAP@K: per query rank items by score (top k kept per map task before the shuffle,
    WindowGroupLimit), average precision at each relevant hit divided by
    min(#relevant, k); mean over queries that have a relevant item."""
    from pyspark.sql import Window

    by = by or []
    order = [F.col(score).desc()] + [F.col(t).asc() for t in (tie or [])]
    w = Window.partitionBy(*by, query).orderBy(*order)
    top = df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    rel = F.col(relevant).cast("int")
    w2 = Window.partitionBy(*by, query).orderBy("_rk").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("_hits", F.sum(rel).over(w2))  # at most k rows per query
    ap = top.groupBy(*by, query).agg(F.sum(F.when(rel == 1, F.col("_hits") / F.col("_rk"))).alias("_s"))
    nrel = df.groupBy(*by, query).agg(F.sum(rel).alias("_nrel"))
    j = ap.join(nrel, [*by, query]).where(F.col("_nrel") > 0)
    res = j.groupBy(*by).agg(F.avg(F.coalesce(F.col("_s"), F.lit(0.0)) / F.least(F.col("_nrel"), F.lit(k))).alias("map"))
    return res


def mcrmse(ys: list[str], preds: list[str]) -> Column:
    """Mean column-wise RMSE over several targets."""
    parts = [F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))) for y, p in zip(ys, preds)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


register(Metric("rmsle", False, False, "regression", column=rmsle), optional=True)
register(Metric("pinball_0.9", False, False, "regression", column=pinball(0.9)), optional=True)
register(Metric("qwk", True, False, "classification", column=qwk), optional=True)
register(Metric("f1", True, False, "classification", frame=f1_frame("binary")), optional=True)
register(Metric("f1_macro", True, False, "classification", frame=f1_frame("macro")), optional=True)
register(Metric("f1_weighted", True, False, "classification", frame=f1_frame("weighted")), optional=True)
