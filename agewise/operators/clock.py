"""Training and evaluation of linear age clocks over long methylation matrices (sample_id, cpg, beta)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agewise.functions.lineage import settle
from agewise.operators.methyl import clock_metrics, mae_by_decade, mae_by_stratum, score_clock
from agewise.operators.tables import filter_valid_age

# The grid of the search.
L1_RATIOS = (0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)
N_ALPHAS, N_FOLDS, MAX_ITER = 20, 10, 5000


def split_features_target(wide: DataFrame, age: str, sample: str = "sample_id", prefix: str = "cg") -> tuple[DataFrame, DataFrame]:
    """(long matrix of the columns that begin with ``prefix``, samples with their age)."""
    held = [c for c in wide.columns if c.startswith(prefix)]
    values = wide.select(sample, *[F.col(f"`{c}`").cast("double").alias(c) for c in held])
    return values.unpivot(sample, [f"`{c}`" for c in held], "cpg", "beta"), wide.select(sample, F.col(age).cast("double").alias("age"))


def train_test_split(samples: DataFrame, share: float = 0.2, seed: int = 42, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(train, test): a sample's side depends on its id and the seed alone."""
    test = F.pmod(F.xxhash64(F.lit(seed), F.col(sample).cast("string")), F.lit(1_000_000)) < int(share * 1_000_000)
    return samples.where(~test), samples.where(test)


def feature_statistics(matrix: DataFrame) -> DataFrame:
    """(cpg, mean, std): of the values that are there; std is that of the population, 1 where there is no spread."""
    x = F.nanvl(F.col("beta").cast("double"), F.lit(None))
    stats = matrix.groupBy("cpg").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return stats.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def impute_mean(matrix: DataFrame, statistics: DataFrame, default: float = 0.5) -> DataFrame:
    """Missing values filled by the means of ``statistics``, which come from the training samples."""
    x = F.nanvl(F.col("beta").cast("double"), F.lit(None))
    return matrix.join(statistics.select("cpg", "mean"), "cpg", "left").select(*[c for c in matrix.columns if c != "beta"], F.coalesce(x, "mean", F.lit(default)).alias("beta"))


def standard_scale(matrix: DataFrame, statistics: DataFrame) -> DataFrame:
    """Values as distances from their feature's mean in its standard deviations; a missing value is at the mean."""
    x = F.nanvl(F.col("beta").cast("double"), F.lit(None))
    z = F.coalesce((x - F.col("mean")) / F.col("std"), F.lit(0.0))
    return matrix.join(statistics, "cpg").select(*[c for c in matrix.columns if c != "beta"], z.alias("beta"))


def sample_order(target: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample_id, i, age, ...): samples with an age, numbered from 0 by their id; of a repeated id the row of the least age stays."""
    one = target.where(F.col(sample).isNotNull() & F.col("age").isNotNull()).groupBy(sample).agg(F.min("age").cast("double").alias("age"), *[F.min(c).alias(c) for c in target.columns if c == "fold"])
    return one.withColumn("i", (F.row_number().over(Window.orderBy(sample)) - 1).cast("int"))


def feature_vectors(scaled: DataFrame, order: DataFrame, n: int, sample: str = "sample_id") -> DataFrame:
    """(cpg, x): each feature's values of all ``n`` samples by their number, as packed doubles; a value that is missing is 0, a repeated one
    is averaged. Cells are met with the samples' numbers by a join and laid out by them, so the work is that of the cells."""

    def laid_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, v in zip(part["i"], part["v"], strict=True):
                times = np.bincount(i, minlength=n)
                out.append((np.bincount(i, weights=v, minlength=n) / np.maximum(times, 1)).tobytes())
            yield pd.DataFrame({"cpg": part["cpg"], "x": out})

    cells = scaled.join(order.select(sample, "i"), sample).groupBy("cpg").agg(F.collect_list(F.struct("i", F.col("beta").cast("double").alias("v"))).alias("c"))
    return settle(cells.select("cpg", "c.i", "c.v").mapInPandas(laid_out, "cpg string, x binary"), "features")


class _Paths:
    """Elastic nets along falling penalties, all models (ratio and left-out fold) at once, over the features met so far.

    Held on the driver: the features that some model may use (``names``, ``x``), and what is left of the ages (samples by models). All
    other features stay in their table; a pass over it finds those that a solution or the next penalty needs.
    """

    def __init__(self, y: np.ndarray, fold: np.ndarray, ratios: Sequence[float], folds: int):
        self.models = [(r, f) for r in ratios for f in (*range(folds), None)]
        self.ratio = np.array([r for r, _ in self.models])
        self.train = np.stack([np.ones(len(y)) if f is None else (fold != f).astype(float) for _, f in self.models], axis=1)
        self.weight = self.train / np.maximum(self.train.sum(axis=0), 1)
        self.y, self.fold = y, fold
        self.mean = y @ self.weight
        self.names: list[str] = []
        self.x = np.zeros((0, len(y)))
        self.center = np.zeros((0, len(self.models)))
        self.known, self.curved = -1, np.ones(len(self.models))
        self.beta = np.zeros((0, len(self.models)))
        self.left = (y[:, None] - self.mean) * self.weight

    def add(self, names: list[str], x: np.ndarray) -> None:
        self.names += names
        self.x, self.center = np.r_[self.x, x], np.r_[self.center, x @ self.weight]
        self.beta = np.r_[self.beta, np.zeros((len(x), len(self.models)))]

    def errors(self, beta: np.ndarray) -> np.ndarray:
        """What is left of every sample's age, those left out too."""
        return self.y[:, None] - self.mean - (self.x.T @ beta - (self.center * beta).sum(axis=0))

    def solve(self, alpha: np.ndarray, tol: float, rounds: int) -> None:
        """Accelerated proximal steps of all models together, begun anew for a model whose steps turn back, until none moves by ``tol``."""
        cut, ridge = alpha * self.ratio, alpha * (1 - self.ratio)
        beta = ahead = self.beta
        pace = np.ones(len(self.models))
        size = 1 / (self.bound() + ridge)
        for _ in range(rounds if len(beta) else 0):
            left = self.errors(ahead) * self.weight
            down = self.x @ left - self.center * left.sum(axis=0) - ridge * ahead
            to = ahead + size * down
            new = np.sign(to) * np.maximum(np.abs(to) - size * cut, 0)
            step = new - beta
            moved = np.abs(step).max()
            turned = ((ahead - new) * step).sum(axis=0) > 0
            pace = np.where(turned, 1.0, pace)
            quick = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead = new + np.where(turned, 0.0, (pace - 1) / quick) * step
            beta, pace = new, quick
            if moved < tol:
                break
        self.beta = beta
        self.left = self.errors(beta) * self.weight

    def drop(self, least: float) -> None:
        """Lets go of features that no model uses and whose product is below ``least``; a pass brings them back if they are needed."""
        keep = self.beta.any(axis=1) | (np.abs(self.x @ self.left) > least).any(axis=1)
        self.names = [c for c, k in zip(self.names, keep, strict=True) if k]
        self.x, self.center, self.beta = self.x[keep], self.center[keep], self.beta[keep]

    def bound(self) -> np.ndarray:
        """A bound of each model's curvature: the largest eigenvalue of its products of samples, which is that of its products of features."""
        if self.known == len(self.x):
            return self.curved
        self.known = len(self.x)
        for m in range(len(self.models)):
            if self.models[m][1] in [f for _, f in self.models[:m]]:
                self.curved[m] = self.curved[[f for _, f in self.models].index(self.models[m][1])]
                continue
            v = np.ones(len(self.y)) + np.arange(len(self.y)) / len(self.y)
            w = self.weight[:, m]
            for _ in range(30):
                v /= np.linalg.norm(v) or 1.0
                b = self.x @ (w * v) - self.center[:, m] * (w @ v)
                v = (self.x.T @ b - self.center[:, m] @ b) * (w > 0)
            self.curved[m] = max(1.1 * float(np.linalg.norm(v)), 1e-9)
        return self.curved


def _needed(vectors: DataFrame, left: np.ndarray, least: float, known: list[str]) -> list[tuple[str, bytes]]:
    """Features, none of ``known``, whose product with what is left reaches a model's bound: those that the models may take up, which are few."""
    sent = vectors.sparkSession.sparkContext.broadcast((left, least, set(known)))

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, least, known = sent.value
        for part in parts:
            for k in range(0, len(part), 512):
                some = part.iloc[k : k + 512]
                x = np.stack([np.frombuffer(b) for b in some["x"]])
                yield some[(np.abs(x @ left) > least).any(axis=1) & ~some["cpg"].isin(known)]

    rows = vectors.mapInPandas(over, "cpg string, x binary").toArrow()
    sent.unpersist()
    return sorted(zip(rows["cpg"].to_pylist(), rows["x"].to_pylist(), strict=True))


def train_elastic_net_cv(
    matrix: DataFrame,
    target: DataFrame,
    *,
    l1_ratios: Sequence[float] = L1_RATIOS,
    n_alphas: int = N_ALPHAS,
    folds: int = N_FOLDS,
    max_iter: int = MAX_ITER,
    seed: int = 42,
    span: float = 1e-3,
    tol: float = 1e-5,
    sample: str = "sample_id",
) -> tuple[DataFrame, dict[str, float]]:
    """(coefficients (cpg, coef, fill), {intercept, alpha, l1_ratio, cv_mse}) of the elastic net of least squared error over folds:
    squared error / 2n + alpha * (ratio * sum |b| + (1 - ratio) / 2 * sum b^2).

    Features are standardised by the training samples; missing values take their means, which are the model's fills. Folds come
    from a hash of the sample, or from a column ``fold`` of ``target``. Penalties fall on a logarithmic scale from the least that leaves no
    coefficient to ``span`` of it. Coefficients are those of the values as they were, 0 for features that aren't used. Samples without an
    age take no part; without samples or features there are no coefficients.

    All models go down their paths together, each penalty from the solution of the last. Features stay in a table of their own, one
    vector each, and a pass over it at each penalty brings the few that a model's conditions ask for; every solution is checked against
    all features. The driver holds these few and a number for each sample and model; this suits hundred thousands of features and
    up to some ten thousand samples. Tables are written while this runs.
    """
    usable = target.where(F.col(sample).isNotNull() & F.col("age").isNotNull())
    held = matrix.join(usable.select(sample).distinct(), sample, "left_semi")
    statistics = settle(feature_statistics(held), "statistics")
    if "fold" not in target.columns:
        target = target.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(sample).cast("string")), F.lit(folds)).cast("int"))
    order = settle(sample_order(target, sample), "samples")
    samples = order.orderBy("i").select("age", "fold").toArrow()  # a number for each sample
    y, fold = samples["age"].to_numpy(), samples["fold"].to_numpy()
    paths = _Paths(y, fold, l1_ratios, folds)
    vectors = feature_vectors(standard_scale(held, statistics), order, len(y), sample)
    best, chosen = None, {}
    most = 0.0
    if len(y):
        # the bound of the first penalty, over all samples
        full = (y - y.mean()) / len(y)
        sent = matrix.sparkSession.sparkContext.broadcast(full)

        def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame({"c": [float(max(abs(np.frombuffer(b) @ sent.value) for b in part["x"]))] if len(part) else []}, dtype="float64")

        most = vectors.mapInPandas(products, "c double").agg(F.max("c")).first()[0] or 0.0
    steps = [max(most, 1e-12) * span ** (k / max(1, n_alphas - 1)) for k in range(n_alphas)]
    close = tol * (float(y.std()) if len(y) else 1.0)
    for k, step in enumerate(steps if most > 0 else steps[:1]):
        after = steps[k + 1] if k + 1 < len(steps) else step
        while True:
            paths.solve(step / paths.ratio, close, max_iter)
            # above this step's bound: a condition that fails; between it and the next one: what the next step will take up
            found = _needed(vectors, paths.left, after if after < step else step * (1 + 1e-3), paths.names)
            x = np.array([np.frombuffer(b) for _, b in found]).reshape(len(found), len(y))
            failed = len(found) and bool((np.abs(x @ paths.left) > step * (1 + 1e-3)).any())
            paths.add([c for c, _ in found], x)
            if not failed:
                break
        paths.drop(after)
        errors = paths.errors(paths.beta)
        for r in dict.fromkeys(l1_ratios):
            mse = [float(np.mean(errors[fold == f, m] ** 2)) for m, (q, f) in enumerate(paths.models) if q == r and f is not None and (fold == f).any()]
            score = float(np.mean(mse)) if mse else 0.0
            if best is None or score < best:
                m = paths.models.index((r, None))
                used = np.flatnonzero(paths.beta[:, m])
                best = score
                chosen = {"alpha": step / r, "l1_ratio": r, "mean": float(paths.mean[m]), "w": [(paths.names[j], float(paths.beta[j, m]), float(paths.center[j, m])) for j in used]}
    weights = matrix.sparkSession.createDataFrame([w[:2] for w in chosen["w"]], "cpg string, w double")
    coefs = statistics.join(weights, "cpg", "left").select("cpg", (F.coalesce("w", F.lit(0.0)) / F.col("std")).alias("coef"), F.col("mean").alias("fill"))
    shift = coefs.agg(F.sum(F.col("coef") * F.col("fill"))).first()[0] or 0.0
    intercept = chosen["mean"] - sum(w * c for _, w, c in chosen["w"]) - shift
    return coefs, {"intercept": intercept, "alpha": chosen["alpha"], "l1_ratio": chosen["l1_ratio"], "cv_mse": best}


def selected_features(coefs: DataFrame) -> DataFrame:
    """Features with a coefficient, largest first."""
    return coefs.where(F.col("coef") != 0).orderBy(F.abs("coef").desc(), "cpg")


def extract_coefficients(coefs: DataFrame, intercept: float, genes: DataFrame | None = None) -> DataFrame:
    """(cpg, coef, direction, label): the coefficients, (Intercept) among them, labelled by their genes (probe, gene)."""
    rows = coefs.select("cpg", "coef").unionByName(coefs.sparkSession.createDataFrame([("(Intercept)", float(intercept))], "cpg string, coef double"))
    direction = F.when(F.col("coef") > 0, "older").when(F.col("coef") < 0, "younger").otherwise("none")
    if genes is None:
        return rows.select("cpg", "coef", direction.alias("direction"), F.col("cpg").alias("label"))
    named = rows.join(genes.select(F.col("probe").alias("cpg"), "gene"), "cpg", "left")
    label = F.coalesce(F.concat("gene", F.lit(" ("), "cpg", F.lit(")")), F.col("cpg"))
    return named.select("cpg", "coef", direction.alias("direction"), label.alias("label"))


def per_sample_predictions(matrix: DataFrame, coefs: DataFrame, intercept: float, ages: DataFrame, predictions: DataFrame | None = None, sample: str = "sample_id") -> DataFrame:
    """(sample_id, age, predicted_age); given ``predictions`` are taken as they are."""
    found = score_clock(matrix, coefs, intercept, sample=sample) if predictions is None else predictions.select(sample, "predicted_age")
    return ages.select(sample, "age").join(found, sample)


def evaluate_clock(matrix: DataFrame, coefs: DataFrame, intercept: float, ages: DataFrame, sample: str = "sample_id") -> dict[str, DataFrame]:
    """predictions, metrics, by_decade and by_stratum of a clock; samples without a usable age are left out."""
    rows = per_sample_predictions(matrix, coefs, intercept, filter_valid_age(ages, "age"), sample=sample)
    return {"predictions": rows, "metrics": clock_metrics(rows), "by_decade": mae_by_decade(rows), "by_stratum": mae_by_stratum(rows)}


def clock_precision_gate(metrics: DataFrame, most: float = 4.0) -> DataFrame:
    """PASS where the mean absolute error is under ``most`` years."""
    return metrics.withColumn("gate", F.when(F.col("mae") < most, "PASS").otherwise("FAIL"))

