"""Linear models from additive moments, one model per zone, fitted where Spark puts the zone.

The rows are read once to build moments per zone and fold block; every penalty, fold and
candidate set is then k-by-k algebra inside ``applyInPandas`` on those moments.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpanel.functions import cooling_degrees, heating_degrees
from voltpanel.operators.moments import centred, gram, standardised, unpack

N_FOLDS = 5
# The penalty grid, 50 points from 1e-4 to 1e4 evenly spaced in the exponent.
ALPHAS = np.logspace(-4, 4, 50)


def _by_block(cells: pd.DataFrame, n_columns: int) -> dict[int, np.ndarray]:
    return {int(b): unpack(part, n_columns) for b, part in cells.groupby("block")}


def _fit(moments: np.ndarray, alpha: float, chosen: list[int] | None = None) -> tuple[np.ndarray, float]:
    """Ridge coefficients (last column is the target) and intercept; alpha 0 is least squares."""
    means, cross = centred(moments)
    k = len(means) - 1
    use = list(range(k)) if chosen is None else chosen
    lhs = cross[np.ix_(use, use)] + alpha * np.eye(len(use))
    coef = np.zeros(k)
    coef[use] = np.linalg.lstsq(lhs, cross[use, k], rcond=None)[0]
    return coef, float(means[k] - means[:k] @ coef)


def _r2(moments: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    """R squared of a given linear model on the rows behind ``moments``."""
    n, k = moments[0, 0], len(coef)
    direction = np.concatenate([[-intercept], -coef, [1.0]])
    residual = direction @ moments @ direction
    total = moments[k + 1, k + 1] - moments[0, k + 1] ** 2 / n
    return float(1 - residual / total) if n > 1 and total > 0 else float("nan")


def _ridge_path(moments: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Models for all penalties from one decomposition: columns ``[-intercept, -coef, 1]``."""
    means, cross = centred(moments)
    k = len(means) - 1
    strength, axes = np.linalg.eigh(cross[:k, :k])
    rotated = axes.T @ cross[:k, k]
    coefs = axes @ (rotated[:, None] / (np.maximum(strength, 0)[:, None] + alphas[None, :]))
    return np.vstack([means[:k] @ coefs - means[k], -coefs, np.ones(len(alphas))])


def _r2_path(moments: np.ndarray, path: np.ndarray) -> np.ndarray:
    n = moments[0, 0]
    total = moments[-1, -1] - moments[0, -1] ** 2 / n
    residual = np.einsum("ia,ij,ja->a", path, moments, path)
    return 1 - residual / total if n > 1 and total > 0 else np.full(path.shape[1], np.nan)


def _expanding(blocks: dict[int, np.ndarray], n_folds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(train, test) moments per fold; a fold a zone has no rows for is left out."""
    folds = []
    for fold in range(1, n_folds + 1):
        before = [m for b, m in blocks.items() if b < fold]
        if before and fold in blocks:
            folds.append((np.sum(before, axis=0), blocks[fold]))
    return folds


def ridge_cv(
    train: DataFrame,
    features: list[str],
    target: str = "target",
    alphas: np.ndarray = ALPHAS,
    n_folds: int = N_FOLDS,
    fold_scaling: bool = False,
) -> DataFrame:
    """Per zone: penalty with the best mean fold R squared, and the refitted coefficients.

    ``train`` carries ``block`` (see ``expanding_blocks``).  Features are standardised on
    all training rows before the folds are cut, as the recorded results were; with
    ``fold_scaling`` each fold uses its own training scale instead and leaks nothing.
    Returns one row per zone: ``alpha, r2, intercept, coefficients`` (array in feature
    order, on standardised features).
    """
    scaled = standardised(train, features, ["zone"])
    cells = gram(scaled, features + [target], ["zone", "block"])
    k = len(features)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        blocks = _by_block(part, k + 1)
        folds = _expanding(blocks, n_folds)
        if fold_scaling:
            folds = [_rescaled(tr, te) for tr, te in folds]
        scores = np.full(len(alphas), np.nan)
        if folds:
            by_fold = np.array([_r2_path(te, _ridge_path(tr, alphas)) for tr, te in folds])
            scores = by_fold[~np.isnan(by_fold).any(axis=1)].mean(axis=0) if not np.isnan(by_fold).all() else scores
        best = 0 if np.isnan(scores).all() else int(np.nanargmax(scores))
        coef, intercept = _fit(np.sum(list(blocks.values()), axis=0), alphas[best])
        return pd.DataFrame(
            {
                "zone": [part["zone"].iloc[0]],
                "n_rows": [int(sum(m[0, 0] for m in blocks.values()))],
                "alpha": [float(alphas[best])],
                "r2": [scores[best]],
                "intercept": [intercept],
                "coefficients": [coef],
            }
        )

    schema = "zone string, n_rows bigint, alpha double, r2 double, intercept double, coefficients array<double>"
    return cells.groupBy("zone").applyInPandas(solve, schema)


def _rescaled(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both moment matrices with features scaled by the training part's deviations."""
    _, cross = centred(train)
    sd = np.sqrt(np.maximum(np.diag(cross) / train[0, 0], 0))
    scale = np.concatenate([[1.0], np.where(sd[:-1] > 0, 1 / np.where(sd[:-1] > 0, sd[:-1], 1), 0.0), [1.0]])
    return train * np.outer(scale, scale), test * np.outer(scale, scale)


def ridge_predict(rows: DataFrame, models: DataFrame, features: list[str], train_rows: DataFrame) -> DataFrame:
    """Add ``predicted``; the scale comes from ``train_rows``, the weights from ``ridge_cv``."""
    tagged = train_rows.select("zone", *features).withColumn("_fit", F.lit(True)).unionByName(
        rows.withColumn("_fit", F.lit(False)), allowMissingColumns=True
    )
    scaled = standardised(tagged, features, ["zone"], fit_on=F.col("_fit")).filter(~F.col("_fit"))
    weighted = [F.col(c) * F.col("coefficients")[i] for i, c in enumerate(features)]
    predicted = reduce(lambda a, b: a + b, weighted, F.col("intercept"))
    return scaled.join(models.select("zone", "intercept", "coefficients"), "zone").select(
        *[c for c in rows.columns if c not in features], predicted.alias("predicted")
    )


def coefficient_importance(models: DataFrame, features: list[str]) -> DataFrame:
    """Coefficients on standardised features, with their absolute value as importance."""
    names = F.array(*map(F.lit, features))
    return models.select("zone", F.inline(F.arrays_zip(names.alias("feature"), F.col("coefficients").alias("coefficient")))).withColumn(
        "importance", F.abs("coefficient")
    )


#: A column of which the chosen ones leave less than this share of its training variation adds nothing.
ADDS_NOTHING = 1e-12


class _Sweep:
    """One fold's rows with the chosen features swept out of the target and of all other columns.

    Means and slopes come from the training rows and are taken off the test rows too, so the
    error with one feature more needs that feature's column alone, not a new solve.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, block: np.ndarray, fold: int):
        self.train, self.test = block < fold, block == fold
        # Fancy indexing copies: each fold sweeps its own columns.
        self.x, self.x_test = x[self.train], x[self.test]
        mean, level = self.x.mean(axis=0), y[self.train].mean()
        self.x, self.x_test = self.x - mean, self.x_test - mean
        self.y, self.y_test = y[self.train] - level, y[self.test] - level
        self.floor = ADDS_NOTHING * (self.x**2).sum(axis=0)

    def slopes(self, on: np.ndarray) -> np.ndarray:
        """Slope of ``on`` on each column; 0 for a column with nothing left."""
        left = (self.x**2).sum(axis=0)
        # Summed column by column in one order, so that equal columns have equal slopes.
        shared = (self.x * on[:, None]).sum(axis=0)
        return np.where(left > self.floor, shared / np.where(left > self.floor, left, 1.0), 0.0)

    def errors(self) -> np.ndarray:
        """Mean absolute test error after adding each column."""
        return np.abs(self.y_test[:, None] - self.x_test * self.slopes(self.y)).mean(axis=0)

    def add(self, j: int) -> None:
        column, column_test = self.x[:, j].copy(), self.x_test[:, j].copy()
        left = (column**2).sum()
        if left > self.floor[j]:
            gain, shared = column @ self.y / left, (self.x * column[:, None]).sum(axis=0) / left
            self.y, self.y_test = self.y - gain * column, self.y_test - gain * column_test
            self.x -= np.outer(column, shared)
            self.x_test -= np.outer(column_test, shared)
        self.x[:, j] = self.x_test[:, j] = 0.0


def _select(x: np.ndarray, y: np.ndarray, block: np.ndarray, names: list[str], steps: int | None, n_folds: int):
    """(step, feature, cv_mae) of the greedy choice on one zone's rows."""
    sweeps = [_Sweep(x, y, block, f) for f in range(1, n_folds + 1) if (block < f).any() and (block == f).any()]
    out, open_ = [], list(range(len(names)))
    while sweeps and open_ and (steps is None or len(out) < steps):
        maes = np.mean([s.errors() for s in sweeps], axis=0)
        best = min(open_, key=lambda j: (maes[j], names[j]))
        if steps is None and out and not maes[best] < out[-1][2]:
            break
        out.append((len(out) + 1, names[best], float(maes[best])))
        open_.remove(best)
        for s in sweeps:
            s.add(best)
    return out


def forward_selection(
    train: DataFrame, features: list[str], target: str = "target", steps: int | None = None, n_folds: int = N_FOLDS
) -> DataFrame:
    """Greedy selection by expanding-window CV MAE, one choice per zone and step.

    A zone ends when its best candidate no longer lowers the CV MAE, or with a given
    number of ``steps`` after these, whatever they bring. Equal errors go to the first name.

    All zones run at once, each on its own rows (at most one a day, so the calendar bounds
    them). A step sweeps the chosen column out of the others and keeps the residuals: a
    zone costs one pass over its columns per step and fold, and no Spark job per step.
    Rows with a null feature or target take no part; a zone without a fold gives no rows.
    """
    names = [*features, target]
    rows = train.select("zone", "block", *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=["block", *names])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part[features].to_numpy(), part[target].to_numpy()
        found = _select(x, y, part["block"].to_numpy(), features, steps, n_folds)
        out = pd.DataFrame(found, columns=["step", "feature", "cv_mae"])
        out.insert(0, "zone", part["zone"].iloc[0])
        return out

    return rows.groupBy("zone").applyInPandas(choose, "zone string, step int, feature string, cv_mae double")


def variance_inflation(rows: DataFrame, features: list[str], tolerance: float = 1e-9) -> DataFrame:
    """VIF per zone and feature; infinite for a feature that others determine exactly.

    Constant features have no VIF and are null.
    """
    cells = gram(standardised(rows, features, ["zone"]), features, ["zone"])
    k = len(features)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        moments = unpack(part, k)
        _, cross = centred(moments)
        sd = np.sqrt(np.maximum(np.diag(cross), 0))
        live = [i for i in range(k) if sd[i] > 1e-6 * np.sqrt(max(moments[0, 0], 1))]
        vif = np.full(k, np.nan)
        for i in live:
            others = [j for j in live if j != i]
            beta = np.linalg.lstsq(cross[np.ix_(others, others)], cross[others, i], rcond=tolerance)[0]
            left = cross[i, i] - beta @ cross[others, i]
            vif[i] = cross[i, i] / left if left > tolerance * cross[i, i] else np.inf
        return pd.DataFrame({"zone": part["zone"].iloc[0], "feature": features, "vif": vif})

    return cells.groupBy("zone").applyInPandas(solve, "zone string, feature string, vif double")


def base_scan(
    rows: DataFrame,
    heating_bases: tuple[float, ...] = (45, 49, 50, 51, 55, 60, 65),
    cooling_bases: tuple[float, ...] = (60, 63, 65, 67, 70),
    held_heating: float = 50.0,
    held_cooling: float = 65.0,
) -> DataFrame:
    """R squared of demand on degree days and calendar flags per candidate base.

    One side is scanned while the other is held.  All candidates are columns of a single
    moment pass; each fit picks its own columns out of the matrix.
    """
    heat = sorted({float(b) for b in heating_bases} | {held_heating})
    cool = sorted({float(b) for b in cooling_bases} | {held_cooling})
    flags = ["is_weekend", "is_holiday"]
    columns = [f"hdd_{b:g}" for b in heat] + [f"cdd_{b:g}" for b in cool] + flags
    derived = {f"hdd_{b:g}": heating_degrees(F.col("tavg"), b) for b in heat}
    derived |= {f"cdd_{b:g}": cooling_degrees(F.col("tavg"), b) for b in cool}
    cells = gram(
        standardised(rows.withColumns(derived).select("zone", "value", *columns), columns, ["zone"]),
        columns + ["value"],
        ["zone"],
    )
    trials = [("heating", float(b), float(b), held_cooling) for b in heating_bases]
    trials += [("cooling", float(b), held_heating, float(b)) for b in cooling_bases]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        moments = unpack(part, len(columns) + 1)
        out = []
        for side, base, h, c in trials:
            use = [columns.index(f"hdd_{h:g}"), columns.index(f"cdd_{c:g}")] + [columns.index(f) for f in flags]
            out.append((part["zone"].iloc[0], side, base, _r2(moments, *_fit(moments, 0.0, use))))
        return pd.DataFrame(out, columns=["zone", "side", "base", "r2"])

    return cells.groupBy("zone").applyInPandas(solve, "zone string, side string, base double, r2 double")
