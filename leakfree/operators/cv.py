"""CVR-1..4, FIN-1, UDF-1/2: the leak-free cross-validation contract over DataFrames.

Users pass two objects (duck-typed, like the original callables):

* features: ``fit(train: DataFrame, target: str) -> transformer`` where
  ``transformer.transform(df) -> DataFrame`` keeps the reserved ``row_id`` column.
  ``fit`` only ever sees the fold's training rows (target included); ``transform``
  never sees the target column.
* model: ``fit(train: DataFrame, target, problem_type, metric) -> fitted`` where
  ``fitted.transform(df)`` adds ``prediction`` and, for probabilistic models,
  ``probability`` (``array<double>`` or an ML vector).

Folds run as independent Spark jobs submitted from a small driver thread pool; the
folded input is persisted once; out-of-fold predictions are a union; all folds are
scored in one grouped job.  Built-in estimators below fit from sufficient statistics
(one pass) or ``pyspark.ml``.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakfree.functions.hashing import seeded_hash
from leakfree.operators import metrics as met
from leakfree.operators.features import number
from leakfree.operators.folds import CVError, Folds, Strategy
from leakfree.operators.models import complete, logistic_model, moments, ridge_model, solve_ridge
from leakfree.session import materialize

ROW_ID = "row_id"
_TARGET = "_lf_target"
BUILTIN_META = ("cv_strategy", "n_splits", "metric", "problem_type", "n_rows")


@dataclass
class CVResult:
    scores: DataFrame                 # (fold, score)
    oof: DataFrame                    # (row_id, fold, target, prediction | probability)
    fold_scores: list[float]
    mean: float
    std: float
    duration_s: float
    metadata: dict = field(default_factory=dict)

    def unpersist(self) -> None:
        """Release the cached out-of-fold predictions."""
        self.oof.unpersist()

    def summary(self) -> str:
        """The journal line a train_cv call writes (parsed back by PRJ-3)."""
        m = self.metadata
        folds = [round(s, 4) for s in self.fold_scores]
        return (f"train_cv complete: {m['cv_strategy']} ({m['n_splits']} folds), metric={m['metric']}, "
                f"mean={self.mean:.4f}, std={self.std:.4f}, fold_scores={folds}, duration_s={self.duration_s:.2f}")

    def run_row(self, spark, competition, run_no: int) -> DataFrame:
        """RUN-1 producer side: the tracking row of this run (append it with SNK-1)."""
        m = self.metadata
        row = [(competition, run_no, m["cv_strategy"], m["n_splits"], m["metric"], m["problem_type"],
                m.get("fe_version", f"fe_v{run_no:02d}"), m.get("model_version", f"model_v{run_no:02d}"),
                self.mean, self.std, self.duration_s, [float(s) for s in self.fold_scores])]
        return spark.createDataFrame(row, "competition string, run_no long, cv_strategy string, n_splits int, "
                                          "metric string, problem_type string, fe_version string, "
                                          "model_version string, cv_mean double, cv_std double, "
                                          "wall_clock_s double, fold_scores array<double>")


# ---------------------------------------------------------------- built-in fitters
class RowWise:
    """A fitted transform that can't change rows: projections, and left joins with tables of unique keys.

    ``apply(df, carry)`` returns ``row_id``, the features and the columns to carry, so the target stays in the row
    (no join by ``row_id``) and the row contract holds by construction.  ``apply_train`` is for the rows the
    transform was fitted on."""

    def apply(self, df: DataFrame, carry: list[str]) -> DataFrame:
        raise NotImplementedError

    def apply_train(self, df: DataFrame, carry: list[str]) -> DataFrame:
        return self.apply(df, carry)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df, [])


class Columns(RowWise):
    """Features that are expressions over the row."""

    def __init__(self, columns: list[Column]):
        self.columns = columns

    def apply(self, df: DataFrame, carry: list[str]) -> DataFrame:
        return df.select(ROW_ID, *self.columns, *carry)


class Chain:
    """Feature fitters one after another: each adds its columns to the rows that the one before it
    returned; the last columns are those of ``keep`` and all that were added."""

    def __init__(self, *fitters, keep: list[str] | None = None):
        self.fitters, self.keep = fitters, keep or []

    def fit(self, train: DataFrame, target: str):
        keep, fitted = self.keep, [f.fit(train, target) for f in self.fitters]
        if not all(isinstance(f, Adds) for f in fitted):
            raise CVError("a chain takes fitters that add columns")

        class _T(RowWise):
            def _all(self, df: DataFrame, carry: list[str], step: str) -> DataFrame:
                for f in fitted:
                    df = getattr(f, step)(df)
                return df.select(ROW_ID, *keep, *[c for f in fitted for c in f.names], *carry)

            def apply(self, df: DataFrame, carry: list[str]) -> DataFrame:
                return self._all(df, carry, "add")

            def apply_train(self, df: DataFrame, carry: list[str]) -> DataFrame:
                return self._all(df, carry, "add_train")

        return _T()


class Adds(RowWise):
    """A row-wise transform that adds columns ``names`` to whatever the rows have."""

    names: list[str]
    keep: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def add_train(self, df: DataFrame) -> DataFrame:
        return self.add(df)

    def apply(self, df: DataFrame, carry: list[str]) -> DataFrame:
        return self.add(df).select(ROW_ID, *self.keep, *self.names, *carry)

    def apply_train(self, df: DataFrame, carry: list[str]) -> DataFrame:
        return self.add_train(df).select(ROW_ID, *self.keep, *self.names, *carry)


class TargetMean:
    """FE-5 as a feature fitter: smoothed training mean of the target per value of a column.

    A training row is encoded without its own target: the training rows are dealt into ``inner`` folds by a hash of their id,
    and a row's encoding leaves out its inner fold, so a model can be fitted on it.  Other rows get the mean over
    all training rows; null and unseen values get the overall mean.  One aggregation gives both tables."""

    def __init__(self, col: str, smoothing: float = 10.0, inner: int = 5, seed: int = 7, out: str | None = None, keep: list[str] | None = None):
        self.col, self.smoothing, self.inner, self.seed, self.out, self.keep = col, smoothing, inner, seed, out or f"{col}_te", keep or []

    def fit(self, train: DataFrame, target: str):
        col, out, smoothing, k = self.col, self.out, self.smoothing, self.inner
        part = (seeded_hash(F.col(ROW_ID), self.seed) % k).cast("int")
        y = F.col(target).cast("double")
        sums = materialize(train.where(y.isNotNull() & ~F.isnan(y)).groupBy(F.col(col).alias("_v"), part.alias("_in")).agg(
            F.sum(y).alias("sy"), F.count(F.lit(1)).alias("n")))
        per_part = {r["_in"]: (r["sy"], r["n"]) for r in sums.groupBy("_in").agg(F.sum("sy").alias("sy"), F.sum("n").alias("n")).collect()}
        total = [sum(x[i] for x in per_part.values()) for i in (0, 1)]
        mean = total[0] / total[1] if total[1] else 0.0
        rest = {j: (total[0] - s) / (total[1] - n) if total[1] > n else mean for j, (s, n) in per_part.items()}
        smooth = lambda sy, n, prior: (sy + smoothing * prior) / (n + smoothing)
        whole = sums.where(F.col("_v").isNotNull()).groupBy("_v").agg(F.sum("sy").alias("sy"), F.sum("n").alias("n"))
        enc = whole.select("_v", smooth(F.col("sy"), F.col("n"), F.lit(mean)).alias(out))
        prior = F.coalesce(F.get(F.array(*[F.lit(float(rest.get(j, mean))) for j in range(k)]), F.col("_in")), F.lit(mean))
        without = whole.withColumn("_in", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).alias("w").join(
            sums.alias("s"), (F.col("w._v") == F.col("s._v")) & (F.col("w._in") == F.col("s._in")), "left").select(
            "w._v", "w._in", (F.col("w.sy") - F.coalesce("s.sy", F.lit(0.0))).alias("sy"), (F.col("w.n") - F.coalesce("s.n", F.lit(0))).alias("n"))
        enc_train = without.select("_v", "_in", smooth(F.col("sy"), F.col("n"), prior).alias(out))
        fitter = self

        class _T(Adds):
            names, keep = [out], fitter.keep

            def add(self, df: DataFrame) -> DataFrame:
                return df.join(enc, F.col(col) == F.col("_v"), "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(mean)))

            def add_train(self, df: DataFrame) -> DataFrame:
                e = enc_train.withColumnRenamed("_in", "_e")
                j = df.withColumn("_in", part).join(e, (F.col(col) == F.col("_v")) & (F.col("_in") == F.col("_e")), "left")
                return j.withColumn(out, F.coalesce(F.col(out), prior)).drop("_v", "_e", "_in")

        return _T()


class OneHot:
    """FE-3 as a feature fitter: a 0/1 column per value that the training rows have, in order; an unseen or null value
    has none.  Columns are part of a plan, so a column with more than ``most`` values is refused, not cut."""

    def __init__(self, col: str, most: int = 1000, keep: list[str] | None = None):
        self.col, self.most, self.keep = col, most, keep or []

    def fit(self, train: DataFrame, target: str):
        col = self.col
        values = [r[0] for r in train.where(F.col(col).isNotNull()).select(col).distinct().limit(self.most + 1).collect()]
        if len(values) > self.most:
            raise CVError(f"column {col!r} has more than {self.most} values: encode it by target mean")
        values.sort()
        fitter = self

        class _T(Adds):
            names, keep = [f"{col}_{i}" for i in range(len(values))], fitter.keep

            def add(self, df: DataFrame) -> DataFrame:
                return df.select("*", *[F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(n) for v, n in zip(values, self.names)])

        return _T()


class MeanImpute:
    """Feature fitter: training mean per column (nulls/NaN skipped, none → 0.0)."""

    def __init__(self, cols: list[str], passthrough: list[str] | None = None):
        self.cols, self.passthrough = cols, passthrough or []

    def fit(self, train: DataFrame, target: str):
        row = train.agg(*[F.avg(number(c)).alias(c) for c in self.cols]).first()
        means = {c: (row[c] if row[c] is not None else 0.0) for c in self.cols}
        return Columns([*[F.coalesce(number(c), F.lit(means[c])).alias(c) for c in self.cols], *map(F.col, self.passthrough)])


class Ridge:
    """Model fitter: ridge with intercept from one pass of moments over the complete rows
    (null and NaN left out, as in :func:`models.fit_ridge_folds`)."""

    adds_columns = True  # transform keeps whatever else a row carries

    def __init__(self, xs: list[str], alpha: float = 1.0):
        self.xs, self.alpha = xs, alpha

    def fit(self, train: DataFrame, target: str, problem_type: str, metric: str):
        xs = self.xs
        row = complete(train, [*xs, target]).agg(*moments(xs, target)).first()
        intercept, w = solve_ridge([row], len(xs), self.alpha)

        class _M:
            coef, bias = w, intercept

            def transform(self, df: DataFrame) -> DataFrame:
                pred = F.lit(intercept)
                for i, x in enumerate(xs):
                    pred = pred + F.lit(float(w[i])) * F.col(x)
                return df.withColumn("prediction", pred)
        return _M()


class MeanModel:
    """Model fitter: predicts the training mean (regression chance level)."""

    adds_columns = True

    def fit(self, train: DataFrame, target: str, problem_type: str, metric: str):
        mu = train.agg(F.avg(F.col(target).cast("double"))).first()[0]

        class _M:
            def transform(self, df: DataFrame) -> DataFrame:
                return df.withColumn("prediction", F.lit(mu))
        return _M()


class SparkML:
    """UDF-2 adapter: any ``pyspark.ml`` estimator built per fold from the training size."""

    adds_columns = True

    def __init__(self, xs: list[str], make_estimator):
        self.xs, self.make = xs, make_estimator

    def fit(self, train: DataFrame, target: str, problem_type: str, metric: str):
        asm = VectorAssembler(inputCols=self.xs, outputCol="features", handleInvalid="keep")
        data = asm.transform(train.withColumn("label", F.col(target).cast("double")))
        model = self.make(train.count()).fit(data)

        class _M:
            def transform(self, df: DataFrame) -> DataFrame:
                out = model.transform(asm.transform(df))
                cols = [c for c in df.columns] + ["prediction"]
                if "probability" in out.columns:
                    return out.select(*cols, vector_to_array("probability").alias("probability"))
                return out.select(*cols)
        return _M()


class PandasTransform:
    """UDF-1 adapter for per-row pandas code: ``fit(train, target) -> state`` computes a
    small state with Spark (aggregations; never collects rows) and ``apply(pdf, state)``
    transforms one Arrow batch at a time through ``mapInPandas`` — Spark partitions the
    rows, Python only sees bounded batches."""

    def __init__(self, fit, apply, schema: str):
        self.fit_state, self.apply, self.schema = fit, apply, schema

    def fit(self, train: DataFrame, target: str):
        state = self.fit_state(train, target)
        apply, schema = self.apply, self.schema

        class _T:
            def transform(self, df: DataFrame) -> DataFrame:
                return df.mapInPandas(lambda batches: (apply(pdf, state) for pdf in batches), schema)
        return _T()


def ridge_ml(xs: list[str], alpha: float = 1.0, target_std: float | None = None) -> SparkML:
    """MDL-2 through ``pyspark.ml`` (same optimum as :class:`Ridge`); the target's
    population std comes from the training fold unless given."""
    class _Ridge(SparkML):
        def fit(self, train: DataFrame, target: str, problem_type: str, metric: str):
            n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop(F.col(target).cast("double"))).first()
            self.make = lambda _n: ridge_model(n, target_std or sd, alpha)
            return SparkML.fit(self, train, target, problem_type, metric)
    return _Ridge(xs, None)


def logistic(xs: list[str], c: float = 1.0) -> SparkML:
    return SparkML(xs, lambda n: logistic_model(n, c))


# ---------------------------------------------------------------- the contract
def _row_sig(df: DataFrame) -> list[Column]:
    """Count and exact checksum of the row ids (decimal sum of 64-bit hashes): equal
    multisets of ids give equal pairs; a partial aggregate, no shuffle."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(ROW_ID).cast("decimal(38,0)")).alias("h")]


def _check_rows(expected: dict[str, tuple], outs: dict[str, DataFrame]) -> None:
    """Row contract of a transform, for train and validation outputs in one job: the
    row count must not change and neither may the set of row ids (a transform that
    drops and duplicates rows in equal number, or rewrites ids, is caught too)."""
    for what, out in outs.items():
        if ROW_ID not in out.columns:
            raise CVError(f"{what} transform dropped the {ROW_ID} column")
    tagged = None
    for what, out in outs.items():
        t = out.select(F.lit(what).alias("_lf_part"), ROW_ID)
        tagged = t if tagged is None else tagged.unionByName(t)
    stats = {r["_lf_part"]: (r["n"], r["h"]) for r in tagged.groupBy("_lf_part").agg(*_row_sig(tagged)).collect()}
    for what, (n_in, h_in) in expected.items():
        n_out, h_out = stats.get(what, (0, None))
        if n_out != n_in:
            raise CVError(f"{what} transform rows changed ({n_in} -> {n_out})")
        if h_out != h_in:
            raise CVError(f"{what} transform changed or duplicated {ROW_ID} values")


def _fold(folds: Folds, f: int, target: str, features, model, metric: met.Metric,
          sizes: dict[int, int]) -> DataFrame:
    # each fold's jobs in their own scheduler pool (shares the cluster under FAIR mode)
    folds.df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", f"leakfree-fold-{f}")
    train = folds.df.where(folds.train_mask(f)).drop(folds.col)
    val = folds.df.where(folds.val_mask(f)).drop(folds.col)
    keeps = getattr(model, "adds_columns", False)  # the target may ride along under another name
    hidden = val.withColumnRenamed(target, _TARGET) if keeps else val.drop(target)
    if features is not None:
        if not hasattr(features, "fit"):
            raise CVError("features must provide fit(train, target)")
        fitted = features.fit(train, target)
        if isinstance(fitted, RowWise):  # rows can't change, and the target stays in the row
            x_train = fitted.apply_train(train, [target])
            x_val = fitted.apply(hidden, [_TARGET] if keeps else [])
        else:
            if not hasattr(fitted, "transform"):
                raise CVError("fitted features object has no transform()")
            x_train = fitted.transform(train.drop(target))   # the target never reaches transform
            x_val = fitted.transform(val.drop(target))
            blocks = folds.train_blocks(f)
            train_sig = (sum(sizes[b][0] for b in blocks if b in sizes),
                         sum((sizes[b][1] for b in blocks if b in sizes), Decimal(0)))
            _check_rows({"train": train_sig, "val": sizes.get(f, (0, None))}, {"train": x_train, "val": x_val})
            x_train = x_train.join(train.select(ROW_ID, target), ROW_ID)
            if keeps:
                x_val = x_val.join(val.select(ROW_ID, F.col(target).alias(_TARGET)), ROW_ID)
    else:
        x_train, x_val = train, hidden
    fitted_model = model.fit(x_train, target, metric.kind, metric.name)
    pred = fitted_model.transform(x_val)
    if not keeps:
        pred = pred.join(val.select(F.col(ROW_ID).alias("_lf_id"), F.col(target).alias(_TARGET)), F.col(ROW_ID) == F.col("_lf_id"))
    cols = [F.col(ROW_ID), F.lit(f).alias("fold"), F.col(_TARGET).alias(target)]
    if metric.needs_proba:
        if "probability" not in pred.columns:
            raise CVError(f"metric {metric.name} needs probabilities but the model has no probability output")
        p = F.col("probability")
        if not isinstance(pred.schema["probability"].dataType, T.ArrayType):
            p = vector_to_array(p)
        cols.append(p.alias("probability"))
    else:
        cols.append(F.col("prediction").cast("double").alias("prediction"))
    return pred.select(*cols)


def train_cv(df: DataFrame, target: str, strategy: Strategy | Folds, metric: str | met.Metric,
             model, features=None, metadata_extra: dict | None = None, parallelism: int = 4,
             problem_type: str | None = None) -> CVResult:
    """CVR-1: leak-free k-fold training, out-of-fold predictions and per-fold scores.

    The problem type is the metric's kind (CVR-4); a stated ``problem_type`` that
    disagrees with it is rejected instead of silently mixing the two."""
    t0 = time.time()
    m = met.get(metric) if isinstance(metric, str) else metric
    if problem_type is not None and problem_type != m.kind:
        raise CVError(f"problem_type {problem_type!r} disagrees with metric {m.name!r} ({m.kind})")
    given = isinstance(strategy, Folds)
    folds = strategy if given else strategy.apply(df, label=target, row_id=ROW_ID)
    if not given:  # a caller's folds stay as they are, cached or not
        folds.df.persist()
    try:
        # rows and id checksum per validation block, one job for all folds (training
        # signatures are sums over blocks)
        sizes = {r[0]: (r["n"], r["h"]) for r in folds.df.groupBy(folds.col).agg(*_row_sig(folds.df)).collect()}
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, folds.n_splits))) as pool:
            outs = list(pool.map(lambda f: _fold(folds, f, target, features, model, m, sizes),
                                 range(folds.n_splits)))
        oof = outs[0]
        for o in outs[1:]:
            oof = oof.unionByName(o)
        pred_col = "prediction"
        if m.needs_proba:
            widths = oof.select(F.size("probability").alias("w")).distinct().collect()  # ≤ a few rows
            if len(widths) > 1:
                raise CVError(f"prediction width changed between folds: {sorted(r.w for r in widths)}")
            k = widths[0].w if widths else 2
            # CVR-3: two columns → P(class 1); more → the whole row of probabilities
            oof = oof.withColumn("prediction", F.element_at("probability", 2) if k == 2 else F.col("probability"))
        oof = oof.persist(StorageLevel.MEMORY_AND_DISK)  # scoring fills it; scores and later reads share it
        scores = m.score(oof, ["fold"], target, pred_col).orderBy("fold")
        rows = scores.collect()  # k rows
        fold_scores = [r["score"] for r in rows]
        arr = np.array([np.nan if s is None else s for s in fold_scores], dtype=float)
        meta = {"cv_strategy": folds.name, "n_splits": folds.n_splits, "metric": m.name,
                "problem_type": m.kind}
        for key, val in (metadata_extra or {}).items():
            meta.setdefault(key, val)  # built-ins cannot be overwritten
        return CVResult(scores, oof, fold_scores, float(arr.mean()), float(arr.std()), time.time() - t0, meta)
    finally:
        if not given:
            folds.df.unpersist()  # a lost block of oof recomputes the (deterministic) folds


def oof_full(result: CVResult, folds_df: DataFrame) -> DataFrame:
    """CVR-2: one row per input row; rows never validated (time-series warm-up) have a
    null prediction."""
    return folds_df.select(ROW_ID).join(result.oof.drop("fold"), ROW_ID, "left")


def fit_final_predict(train: DataFrame, test: DataFrame, target: str, id_col: str | None = "auto", model=None,
                      features=None, problem_type: str = "regression", metric: str = "rmse") -> DataFrame:
    """FIN-1: fit on the whole training table, predict every test row.

    ``id_col="auto"`` detects the test id column by the id rules (PRJ-9).  The id is never
    a feature (dropped from both sides — a deliberate fix of the original, which trained
    with it); predictions are re-attached by id, never by position.  Output: ``(id,
    target)`` — P(class 1) for a binary probabilistic metric, the prediction otherwise —
    or ``(id, target_0..target_{K-1})`` for K > 2 class probabilities."""
    from leakfree.functions.catalog import id_column_of

    if id_col == "auto":
        id_col = id_column_of(test.columns)
    if id_col is not None and id_col not in test.columns:
        raise CVError(f"id column {id_col!r} not in test")
    m = met.get(metric)
    # the id (when present) becomes the reserved row handle: carried through, never a feature
    def handled(df: DataFrame, named: str | None) -> DataFrame:
        if named is not None:
            return df.withColumnRenamed(named, ROW_ID)
        # generated ids are written once: two evaluations could number rows differently
        return materialize(df.withColumn(ROW_ID, F.monotonically_increasing_id()), reliable=True)

    tr, te = handled(train, id_col if id_col in train.columns else None), handled(test, id_col)
    if features is not None:
        fitted = features.fit(tr, target)
        if isinstance(fitted, RowWise):
            x_tr = fitted.apply_train(tr, [target])
        else:
            x_tr = fitted.transform(tr.drop(target)).join(tr.select(ROW_ID, target), ROW_ID)
        x_te = fitted.transform(te.drop(target) if target in te.columns else te)
        sig = te.agg(*_row_sig(te)).first()
        _check_rows({"test": (sig["n"], sig["h"])}, {"test": x_te})
    else:
        x_tr, x_te = tr, te
    fitted_model = model.fit(x_tr, target, problem_type, m.name)
    pred = fitted_model.transform(x_te)
    key = [F.col(ROW_ID).alias(id_col)] if id_col else []
    if m.needs_proba and "probability" in pred.columns:
        p = F.col("probability")
        if not isinstance(pred.schema["probability"].dataType, T.ArrayType):
            p = vector_to_array(p)
        k = pred.select(F.max(F.size(p))).first()[0]
        if k and k > 2:
            return pred.select(*key, *[p[i].alias(f"{target}_{i}") for i in range(k)])
        return pred.select(*key, F.element_at(p, 2).alias(target))
    return pred.select(*key, F.col("prediction").alias(target))
