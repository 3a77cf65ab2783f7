"""Ordinary least squares by group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, join_keys, listed, nan_to_null


def _products(columns: Sequence[str], weight: str | None = None) -> list:
    """Sums of products of the columns: a group's cross-product matrix, without holding its rows together."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    return [F.sum(col(columns[i]) * col(columns[j]) * (F.col(weight) if weight else 1)).alias(f"m{i}_{j}") for i, j in pairs]


def _matrix(row: dict, size: int, name: str = "m") -> np.ndarray:
    return np.array([[row[f"{name}{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)], dtype=np.float64).reshape(size, size)


def _by_row(df: DataFrame, schema: T.StructType, solve: Callable[[dict], list]) -> DataFrame:
    """df's columns that schema has, and solve(row) for schema's others."""
    kept = [f.name for f in schema if f.name in df.columns]
    new = [f.name for f in schema if f.name not in df.columns]

    def run(batches):
        for batch in batches:
            found = [solve(row) for row in batch.to_dict("records")]
            out = batch[kept].copy()
            for i, c in enumerate(new):
                out[c] = pd.Series([f[i] for f in found], index=out.index, dtype="float64")
            yield out

    return df.mapInPandas(run, schema)


def reg_by(df: DataFrame, yvar: str, xvars: str | Sequence[str], groupvar: str | Sequence[str], merge: bool = False, cons: bool = True, stderr: bool = False) -> DataFrame:
    """Coefficients const and coef_<x> for each group, with stderr also HC1 standard errors.

    Rows with a missing value or key are left out. A group with fewer rows than coefficients plus one gets NULL. All
    comes from sums of products over a group's rows, which Spark adds up before the shuffle: one pass for the
    coefficients and a second one, over the residuals, for the errors; no group's rows are held together. With a
    constant the sums are centred, which keeps their digits. Solutions are of minimum norm where the regressors are
    collinear.
    """
    df, names, keys = nan_to_null(df), listed(xvars), listed(groupvar)
    columns, k = [*names, yvar], len(names)
    rows = df.select(*map(col, keys), *(col(c).cast("double").alias(c) for c in [yvar, *names])).dropna()
    labels = [*(["const"] if cons else []), *(f"coef_{x}" for x in names)]
    errors = [f"stderr_{x.removeprefix('coef_')}" for x in labels] if stderr else []
    double = lambda c: T.StructField(c, T.DoubleType())
    schema = T.StructType([*(df.schema[c] for c in keys), *map(double, labels)])
    least = len(labels) + 1
    n = F.count(F.lit(1)).alias("n")
    if cons:
        means = [F.avg(col(c)).alias(f"mean{i}") for i, c in enumerate(columns)]
        centred = [(F.covar_pop(col(columns[i]), col(columns[j])) * F.count(F.lit(1))).alias(f"m{i}_{j}") for i in range(k + 1) for j in range(i + 1)]
        sums = rows.groupBy(*map(col, keys)).agg(n, *means, *centred)
    else:
        sums = rows.groupBy(*map(col, keys)).agg(n, *_products(columns))

    def coefficients(row: dict) -> list:
        if row["n"] < least:
            return [None] * len(labels)
        m = _matrix(row, k + 1)
        slopes = np.linalg.pinv(m[:k, :k]) @ m[:k, k]
        return [row[f"mean{k}"] - sum(b * row[f"mean{i}"] for i, b in enumerate(slopes)), *slopes] if cons else list(slopes)

    if not stderr:
        result = _by_row(sums, schema, coefficients)
    else:
        found = _by_row(sums, T.StructType([*sums.schema.fields, *map(double, labels)]), coefficients)
        center = [F.col(f"mean{i}") if cons else F.lit(0.0) for i in range(k)]
        gap = col(yvar) - sum((col(f"coef_{x}") * col(x) for x in names), F.col("const") if cons else F.lit(0.0))
        first = [F.lit(1.0).alias("z0")] if cons else []
        own = [c for c in found.columns if c not in keys]
        around = join_keys(rows, found, keys, "inner").select(*map(col, keys), *first, *((col(x) - center[i]).alias(f"z{i + len(first)}") for i, x in enumerate(names)), (gap * gap).alias("e2"))
        size = k + len(first)
        meat = around.groupBy(*map(col, keys)).agg(*_products([f"z{i}" for i in range(size)], "e2")).withColumnsRenamed({f"m{i}_{j}": f"e{i}_{j}" for i in range(size) for j in range(i + 1)})
        both = join_keys(found.select(*map(col, keys), *map(col, own)), meat, keys, "inner")

        def robust(row: dict) -> list:
            if row["n"] < least:
                return [None] * len(errors)
            inverse = np.linalg.pinv(_matrix(row, k + 1)[:k, :k])
            if cons:
                # In centred regressors the constant is the mean of y; the model's own is less the means' share.
                inverse = np.block([[np.full((1, 1), 1 / row["n"]), np.zeros((1, k))], [np.zeros((k, 1)), inverse]])
            wide = inverse @ _matrix(row, size, "e") @ inverse * row["n"] / (row["n"] - size)
            if cons:
                back = np.eye(size)
                back[0, 1:] = [-row[f"mean{i}"] for i in range(k)]
                wide = back @ wide @ back.T
            return list(np.sqrt(np.maximum(np.diag(wide), 0)))

        result = _by_row(both, T.StructType([*schema.fields, *map(double, errors)]), robust)
    if not merge:
        return result
    return join_keys(df, result, keys)
