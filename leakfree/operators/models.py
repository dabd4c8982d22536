"""MDL-1..3: fold models.

* Baselines and ridge regression are fitted for *all* folds from one scan: additive
  sufficient statistics per validation block (complement trick), then a d×d solve per
  fold on the driver — k·d² numbers, independent of the row count.
* Logistic regression uses ``pyspark.ml`` (distributed L-BFGS) with the regularisation
  rescaled so the optimum equals an L2 logistic regression with inverse strength ``C``
  and an unpenalised intercept.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakfree.operators.complement import train_sums
from leakfree.operators.folds import CVError, Folds


def mean_baseline(folds: Folds, target: str) -> DataFrame:
    """Per fold: the training mean of the target (regression chance level)."""
    y = F.col(target).cast("double")
    st = train_sums(folds, {"s": y, "n": F.when(y.isNotNull(), F.lit(1))})
    return st.select("fold", (F.col("s") / F.col("n")).alias("mean"))


def majority_baseline(folds: Folds, target: str) -> DataFrame:
    """Per fold: the most frequent training class (smallest class on ties)."""
    st = train_sums(folds, {"n": F.when(F.col(target).isNotNull(), F.lit(1))}, by=[target])
    return (st.where(F.col("n") > 0).groupBy("fold")
            .agg(F.min_by(F.col(target), F.struct(-F.col("n"), F.col(target))).alias("majority")))


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """The rows that have a number (no null, no NaN) in every column."""
    for c in cols:
        v = F.col(c).cast("double")
        df = df.where(v.isNotNull() & ~F.isnan(v))
    return df


def moments(xs: list[str], target: str) -> list[Column]:
    """Count, means and covariances of features and target (the last column): Spark's central
    moments, which keep their digits when values are far from zero."""
    cols = [F.col(c).cast("double") for c in [*xs, target]]
    out = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    return out + [F.covar_pop(a, cols[j]).alias(f"c{i}_{j}") for i, a in enumerate(cols[:-1])
                  for j in range(i, len(cols))]


def solve_ridge(blocks: list, d: int, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from the moments of the blocks of training rows.  Blocks are combined
    around their common mean, so nothing is subtracted from a large total."""
    blocks = [b for b in blocks if b["n"]]
    if not blocks:
        raise CVError("no training row has a number in the target and every feature")
    n = np.array([b["n"] for b in blocks], dtype=float)
    means = np.array([[b[f"m{i}"] for i in range(d + 1)] for b in blocks])
    mean = means[0] + (n / n.sum()) @ (means - means[0])
    co = np.zeros((d, d + 1))
    for k, b, m in zip(n, blocks, means):
        for i in range(d):
            for j in range(i, d + 1):
                co[i, j] += k * (b[f"c{i}_{j}"] + (m[i] - mean[i]) * (m[j] - mean[j]))
    g = np.triu(co[:, :d]) + np.triu(co[:, :d], 1).T
    w = np.linalg.solve(g + alpha * np.eye(d), co[:, d])
    return float(mean[d] - mean[:d] @ w), w


def fit_ridge_folds(folds: Folds, xs: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Ridge with intercept (centred, intercept not penalised) for every fold in one scan.

    Returns ``(fold, intercept, coef array<double>)`` — k rows.  Rows with a null or NaN in a feature
    or the target are left out of the fit (impute first, FE-1)."""
    per_block = complete(folds.df, [*xs, target]).groupBy(folds.col).agg(*moments(xs, target))
    found = {r[0]: r for r in per_block.collect()}  # k + 1 rows of O(d²) numbers
    rows = []
    for f in range(folds.n_splits):
        bias, w = solve_ridge([found[b] for b in folds.train_blocks(f) if b in found], len(xs), alpha)
        rows.append((f, bias, [float(v) for v in w]))
    return folds.df.sparkSession.createDataFrame(rows, "fold int, intercept double, coef array<double>")


def predict_linear(df: DataFrame, coefs: DataFrame, xs: list[str], fold_col: str = "fold",
                   out: str = "prediction") -> DataFrame:
    """Apply per-fold linear coefficients (k rows, broadcast) to rows of the same fold."""
    j = df.join(F.broadcast(coefs), fold_col)
    pred = F.col("intercept")
    for i, x in enumerate(xs):
        pred = pred + F.col("coef")[i] * F.col(x)
    return j.withColumn(out, pred).drop("intercept", "coef")


def logistic_model(n_train: int, c: float = 1.0, max_iter: int = 500, family: str = "auto",
                   features: str = "features", label: str = "label") -> LogisticRegression:
    """L2 logistic regression equal to minimising ``C·Σ loss + ½‖w‖²`` (intercept free):
    Spark minimises ``(1/n)Σ loss + (λ/2)‖w‖²``, so ``λ = 1/(C·n)``."""
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (c * n_train),
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                              tol=1e-10, family=family)


def logistic_oof(folds: Folds, xs: list[str], target: str, c: float = 1.0,
                 row_id: str = "row_id") -> DataFrame:
    """Out-of-fold class probabilities: ``(row_id, fold, target, p1, probability array)``."""
    assembler = VectorAssembler(inputCols=xs, outputCol="features", handleInvalid="keep")
    data = assembler.transform(folds.df.withColumn("label", F.col(target).cast("double")))
    sizes = {r[0]: r[1] for r in folds.df.groupBy(folds.col).count().collect()}  # k + 1 rows

    def one(f: int) -> DataFrame:
        n = sum(sizes.get(b, 0) for b in folds.train_blocks(f))
        model = logistic_model(n, c).fit(data.where(folds.train_mask(f)))
        return model.transform(data.where(folds.val_mask(f))).select(
            row_id, F.col(folds.col).alias("fold"), target, vector_to_array("probability").alias("probability"))

    # folds are independent: their iterations share the cluster
    with ThreadPoolExecutor(max_workers=min(4, folds.n_splits)) as pool:
        outs = list(pool.map(one, range(folds.n_splits)))
    oof = outs[0]
    for o in outs[1:]:
        oof = oof.unionByName(o)
    return oof.withColumn("p1", F.element_at("probability", 2))


def ridge_model(n_train: int, std_y: float, alpha: float = 1.0, features: str = "features",
                label: str = "label") -> LinearRegression:
    """Ridge ``‖y − Xw − b‖² + α‖w‖²`` through ``pyspark.ml``: Spark minimises
    ``(1/2n)‖…‖² + (λ/2)‖w‖²`` on a label scaled by its (population) standard deviation,
    so the same optimum needs ``λ = α·std(y)/n`` with the normal-equation solver."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=alpha * std_y / n_train,
                            elasticNetParam=0.0, standardization=False, solver="normal", fitIntercept=True)
