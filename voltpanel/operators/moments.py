"""Additive second moments: one pass over the rows, then algebra on k-by-k matrices.

Each task reduces its Arrow batches to a few sums per group with matrix products; Spark
adds them up per group and cell.  What leaves the rows behind depends only on the number
of columns and groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_SCHEMA = "cell int, amount double"


def gram(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``by..., cell, amount``: sums of ``[1, columns] x [1, columns]`` per group.

    ``cell`` numbers the upper triangle row by row; cell 0 is the row count.
    """
    upper = np.triu_indices(len(columns) + 1)
    cells = np.arange(len(upper[0]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False):
                x = np.column_stack([np.ones(len(part)), part[columns].to_numpy(dtype=float)])
                sums = pd.DataFrame({"cell": cells, "amount": (x.T @ x)[upper]})
                for position, (name, value) in enumerate(zip(by, key)):
                    sums.insert(position, name, None if pd.isna(value) else value)
                yield sums

    selected = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in selected.select(*by).schema)
    partials = selected.mapInPandas(partial, f"{key_schema}, {CELL_SCHEMA}")
    return partials.groupBy(*by, "cell").agg(F.sum("amount").alias("amount"))


def unpack(cells: pd.DataFrame, n_columns: int) -> np.ndarray:
    """Symmetric ``[1, columns] x [1, columns]`` matrix from summed cells."""
    size = n_columns + 1
    full = np.zeros((size, size))
    upper = np.triu_indices(size)
    values = np.zeros(len(upper[0]))
    values[cells["cell"].to_numpy()] = cells["amount"].to_numpy()
    full[upper] = values
    return full + np.triu(full, 1).T


def centred(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and centred cross products of the columns."""
    n = moments[0, 0]
    means = moments[0, 1:] / n
    return means, moments[1:, 1:] - n * np.outer(means, means)


def standardised(rows: DataFrame, columns: list[str], by: list[str], fit_on=None) -> DataFrame:
    """Columns to mean 0 and population standard deviation 1 within ``by``.

    Mean and deviation come from the rows where ``fit_on`` holds (all rows by default), so
    a model's test rows are scaled with training statistics.  A constant column becomes 0.
    """

    def chosen(c: str):
        return F.col(c) if fit_on is None else F.when(fit_on, F.col(c))

    stats = rows.groupBy(*by).agg(
        *[F.avg(chosen(c)).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(chosen(c)).alias(f"_sd_{c}") for c in columns],
    )
    joined = rows.join(stats, by, "left")
    scaled = {
        c: F.when(F.col(f"_sd_{c}") == 0, F.lit(0.0)).otherwise(
            F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}"))
        )
        for c in columns
    }
    return joined.withColumns(scaled).select(*rows.columns)


def pairwise_correlation(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Lower triangle of the Pearson matrix per group, each pair over rows where both are present.

    Masked matrix products give all pairs in one pass.  Columns are shifted by their
    group's mean first, so that large levels do not cost precision.
    """
    lower = np.tril_indices(len(columns), -1)
    pairs = np.arange(len(lower[0]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False):
                x = part[columns].to_numpy(dtype=float)
                seen = ~np.isnan(x)
                x, m = np.where(seen, x, 0.0), seen.astype(float)
                products = [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
                sums = pd.DataFrame({"pair": pairs, **{f"s{i}": p[lower] for i, p in enumerate(products)}})
                for position, (name, value) in enumerate(zip(by, key)):
                    sums.insert(position, name, None if pd.isna(value) else value)
                yield sums

    means = rows.groupBy(*by).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    shifted = rows.select(*by, *columns).join(means, by).select(
        *by, *[(F.col(c) - F.col(f"_mean_{c}")).alias(c) for c in columns]
    )
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shifted.select(*by).schema)
    sums = (
        shifted.mapInPandas(partial, f"{key_schema}, pair int, " + ", ".join(f"s{i} double" for i in range(6)))
        .groupBy(*by, "pair")
        .agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)])
    )
    n, sx, sy, sxx, syy, sxy = (F.col(f"s{i}") for i in range(6))
    # Below this share of the square sum a variance is rounding noise of a constant.
    noise = 1e-12

    def spread(ss: Column, s: Column) -> Column:
        centred_ss = ss - s * s / n
        return F.when(centred_ss > noise * ss, centred_ss)

    names = F.array(*[F.array(F.lit(columns[i]), F.lit(columns[j])) for i, j in zip(*lower)])
    r = F.try_divide(sxy - sx * sy / n, F.sqrt(spread(sxx, sx) * spread(syy, sy)))
    return (
        sums.filter(n > 0)
        .withColumn("_names", names[F.col("pair")])
        .select(
            *by,
            F.col("_names")[0].alias("feature_a"),
            F.col("_names")[1].alias("feature_b"),
            r.alias("correlation"),
        )
    )


def correlated_pairs(correlations: DataFrame, at_least: float = 0.85) -> DataFrame:
    return correlations.filter(F.abs("correlation") >= at_least)
