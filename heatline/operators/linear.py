"""Linear regressions of many targets from one Gram matrix of their shared inputs (M3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.schema import MODULES, TARGETS

#: Directions of the standardised inputs with less than this share of the largest variance
#: repeat others; they get no weight of their own.
LEAST_SHARE = 1e-12
_ROWS = 4096


def centred_products(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means, and sums of products about the means, of complete rows.

    Two scans: the means, then the products about them, so that nothing cancels. A task
    sends columns squared numbers, summed by row of the matrix; the driver gets one matrix.
    """
    names = [f"c{j}" for j in range(len(columns))]
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)]).dropna()
    n, *means = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in names]).head()
    size = len(columns)
    products = np.zeros((size, size))
    if not n:
        return 0, np.zeros(size), products
    mean = np.array(means)
    schema = T.StructType(
        [T.StructField("i", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                off = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]) - mean
                total += off.T @ off
        out = [pa.array(np.arange(size, dtype=np.int32)), *[pa.array(c) for c in np.ascontiguousarray(total)]]
        yield pa.RecordBatch.from_arrays(out, names=schema.names)

    summed = rows.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    for row in summed.collect():
        products[row[0]] = row[1:]
    return n, mean, products


def coefficients(
    df: DataFrame, features: list[str], targets: list[str]
) -> tuple[np.ndarray, np.ndarray]:
    """Least squares weights (inputs x targets) and intercepts, all targets at once.

    Inputs are standardised; where some repeat others exactly, the smallest weights of
    equal fit are taken. A table without complete rows gives zeros.
    """
    inputs = len(features)
    n, mean, products = centred_products(df, [*features, *targets])
    scale = np.sqrt(np.diag(products)[:inputs])
    scale[scale == 0] = 1.0
    gram = products[:inputs, :inputs] / np.outer(scale, scale)
    right = products[:inputs, inputs:] / scale[:, None]
    weights = np.linalg.pinv(gram, rcond=LEAST_SHARE, hermitian=True) @ right / scale[:, None]
    return weights, mean[inputs:] - mean[:inputs] @ weights


def fit_linear(
    df: DataFrame, features: list[str], targets: list[str] = TARGETS, modules: list[str] = MODULES
) -> PipelineModel:
    """M3: one model adding ``Predicted_<module>`` for every target, from one pass for all.

    The forecasts are plain column arithmetic in a stage that saves and loads like any.
    """
    weights, intercepts = coefficients(df, features, targets)
    columns = []
    for module, weight, intercept in zip(modules, weights.T, intercepts):
        terms = [f"{w!r}D * `{f}`" for f, w in zip(features, weight.tolist())]
        columns.append(f"{' + '.join([f'{float(intercept)!r}D', *terms])} AS `Predicted_{module}`")
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")])
