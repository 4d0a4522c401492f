"""Logistic regression by Newton steps.

The objective is MLlib's: mean weighted log loss plus half the regularisation times the squares of the weights of standardised
features, without the intercept. It has one optimum. Each pass over the rows sums loss, slopes and curves of blocks of rows;
tens of passes reach the optimum to rounding, where MLlib's quasi-Newton steps take hundreds and stop by a tolerance. Rows that
one task can hold are passed over in that task, others by one job a pass.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers receive these functions themselves; the package need not be installed beside the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values of a block, and features whose curves (one number per pair) a task and the driver hold.
BLOCK_VALUES, MOST_FEATURES = 500_000, 1_000
#: Bytes of values that one task keeps.
TASK_BYTES = 500_000_000
#: A step that promises less than this share of the loss ends the search; rise of the loss that is rounding; shortest step tried.
ENOUGH, ROUNDING, SHORTEST = 1e-9, 1e-12, 1e-6


def blocks(rows: DataFrame, n_features: int) -> DataFrame:
    """``x, y, w``: rows of ``features array<double>, label, weight`` in blocks of bytes."""
    most = max(1, BLOCK_VALUES // max(1, n_features))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                columns = [part.column(0).flatten(), part.column(1), part.column(2)]
                yield pa.RecordBatch.from_pydict(
                    {name: [c.to_numpy(zero_copy_only=False).tobytes()] for name, c in zip("xyw", columns, strict=True)})

    return rows.select("features", "label", "weight").mapInArrow(cut, "x binary, y binary, w binary")


Sums = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Join = Callable[[np.ndarray, np.ndarray], np.ndarray]


def held(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks as arrays."""
    for batch in batches:
        for x, y, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield np.frombuffer(x).reshape(-1, n_features), np.frombuffer(y), np.frombuffer(w)


def joined_sums(parts: Iterator[np.ndarray], join: Join) -> np.ndarray | None:
    whole = None
    for part in parts:
        whole = part if whole is None else join(whole, part)
    return whole


def over_blocks(of: DataFrame, n_features: int, sums: Sums, join: Join = np.add) -> np.ndarray | None:
    """``sums`` of all blocks joined, first by task, then on the driver."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = joined_sums((sums(*block) for block in held(batches, n_features)), join)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"sums": [found.tobytes()]})

    rows = of.mapInArrow(own, "sums binary").collect()  # one row of fixed size per task
    return joined_sums((np.frombuffer(row["sums"]) for row in rows), join)


def fit_in_one_task(of: DataFrame, n_features: int, reg: float, max_iter: int) -> tuple[np.ndarray, float] | None:
    """:func:`fit_newton` where the rows are."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(held(batches, n_features))
        found = fit_newton(lambda sums, join=np.add: joined_sums((sums(*block) for block in kept), join), n_features, reg, max_iter)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"weights": [found[0].tobytes()], "intercept": [found[1]]})

    row = of.repartition(1).mapInArrow(fitted, "weights binary, intercept double").first()
    return None if row is None else (np.frombuffer(row["weights"]), row["intercept"])


def slopes(mean: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> Sums:
    """Sums of loss, first and second derivatives at ``beta`` (intercept last) over a block."""

    def of(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.append((x - mean) * scale, np.ones((len(x), 1)), axis=1)
        margin = z @ beta
        p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
        loss = float(w @ (np.logaddexp(0, margin) - y * margin))
        return np.concatenate([[loss], z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

    return of


def fit_newton(over: Callable[..., np.ndarray | None], n_features: int, reg: float, max_iter: int) -> tuple[np.ndarray, float] | None:
    """Coefficients and intercept at the optimum; None where only one label is there. ``over`` joins sums of all blocks."""

    def first(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.concatenate([[w.sum(), w @ w, w @ y], w @ x, -x.min(axis=0), x.max(axis=0)])

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([a[: 3 + n_features] + b[: 3 + n_features], np.maximum(a[3 + n_features :], b[3 + n_features :])])

    found = over(first, joined)
    if found is None:
        return None
    (total, squares, positive), mean = found[:3], found[3 : 3 + n_features] / found[0]
    moves = -found[3 + n_features : 3 + 2 * n_features] < found[3 + 2 * n_features :]
    if not 0 < positive < total:
        return None
    spread = over(lambda x, y, w: w @ (x - mean) ** 2)
    rest = total - squares / total
    deviation = np.sqrt(spread / rest) if rest > 0 else np.zeros(n_features)
    moves &= deviation > 0
    scale = np.divide(1.0, deviation, out=np.zeros(n_features), where=moves)

    ridge = np.append(np.where(moves, reg, 0.0), 0.0)
    free = np.flatnonzero(np.append(moves, True))
    beta = np.zeros(n_features + 1)
    beta[-1] = np.log(positive / (total - positive))
    best, step, length = None, np.zeros(n_features + 1), 1.0
    for _ in range(max_iter):
        sums = over(slopes(mean, scale, beta)) / total
        loss = sums[0] + (ridge * beta * beta).sum() / 2
        if best is not None and not loss <= best[0] * (1 + ROUNDING):
            length /= 2
            if length < SHORTEST:
                beta = best[1]
                break
            beta = best[1] + length * step
            continue
        best, length = (loss, beta), 1.0
        slope = (sums[1 : n_features + 2] + ridge * beta)[free]
        curve = sums[n_features + 2 :].reshape(n_features + 1, -1)[np.ix_(free, free)] + np.diag(ridge[free])
        step = np.zeros(n_features + 1)
        step[free] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
        if -(slope @ step[free]) / 2 <= ENOUGH * max(loss, 1e-9):
            break
        beta = beta + step
    beta = best[1]
    weights = beta[:-1] * scale
    return weights, float(beta[-1] - weights @ mean)


class NewtonLogisticRegression(LogisticRegression):
    """Binary logistic regression with a ridge, at the optimum of MLlib's objective."""

    def _fit(self, dataset: DataFrame):
        n = dataset.select(F.size(vector_to_array(self.getFeaturesCol())).alias("n")).first()
        plain = self.getElasticNetParam() == 0 and self.getFitIntercept() and self.getStandardization() and self.getFamily() != "multinomial"
        if n is None or n["n"] > MOST_FEATURES or not plain or any(self.isSet(p) for p in self.params if "Bounds" in p.name):
            return super()._fit(dataset)
        label = F.col(self.getLabelCol()).cast("double")
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("features"), label.alias("label"),
            F.col(self.getWeightCol()).cast("double").alias("weight") if self.isSet("weightCol") else F.lit(1.0).alias("weight"))
        kept = blocks(rows, n["n"]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            size = kept.agg(F.sum(F.octet_length("x"))).first()[0]
            if size and size <= TASK_BYTES:
                found = fit_in_one_task(kept, n["n"], self.getRegParam(), self.getMaxIter())
            else:
                found = fit_newton(partial(over_blocks, kept, n["n"]), n["n"], self.getRegParam(), self.getMaxIter())
        finally:
            kept.unpersist()
        if found is None:
            return super()._fit(dataset)
        context = dataset.sparkSession.sparkContext
        made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            self.uid, _py2java(context, Vectors.dense(found[0])), found[1])
        return self._copyValues(self._create_model(made))
