"""Distances as JVM expressions.

All arithmetic is in double precision and adds components from the first to the
last, so results are equal bit for bit to any engine that does the same.

A query that is fixed when the plan is built gives an unrolled sum, which stays
in whole-stage code generation; two columns, or vectors too wide for one
generated method, use higher-order functions with the same order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.model import Metric

#: Widest vector whose distance is unrolled.
UNROLL = 128


def _term(metric: Metric, a: Column, b: Column) -> Column:
    if metric is Metric.COSINE:
        return a * b
    return F.abs(a - b) if metric is Metric.MANHATTAN else (a - b) * (a - b)


def _finish(metric: Metric, total: Column) -> Column:
    return F.greatest(F.lit(1.0) - total, F.lit(0.0)) if metric is Metric.COSINE else total


def between(metric: Metric, a: Column, b: Column) -> Column:
    """Distance of two vector columns (cosine: of stored unit vectors)."""
    terms = F.zip_with(a, b, lambda x, y: _term(metric, x.cast("double"), y.cast("double")))
    return _finish(metric, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def literal(query: Sequence[float] | np.ndarray) -> Column:
    """A fixed vector of doubles, as one expression."""
    return F.expr("array(" + ", ".join(f"({float(x)!r}D)" for x in query) + ")")


def to_query(metric: Metric, vector: str, query: Sequence[float] | np.ndarray) -> Column:
    """Distance of the vector column of this name to a fixed query.

    The sum is written as one SQL expression: building it from hundreds of
    column objects would take longer than many searches.
    """
    q = np.asarray(query, dtype=np.float32).astype(np.float64).tolist()
    if len(q) > UNROLL:
        return between(metric, F.col(vector), literal(q))
    term = {Metric.SQUARED_EUCLIDEAN: "({a} - {b}) * ({a} - {b})", Metric.MANHATTAN: "abs({a} - {b})", Metric.COSINE: "{a} * {b}"}[metric]
    terms = [term.format(a=f"CAST(get(`{vector}`, {i}) AS DOUBLE)", b=f"({x!r}D)") for i, x in enumerate(q)]
    return _finish(metric, F.expr(" + ".join(["0.0D", *terms])))


def routing_metric(metric: Metric) -> Metric:
    """Centers are ranked by squared Euclidean distance for cosine, by the metric itself otherwise."""
    return Metric.SQUARED_EUCLIDEAN if metric is Metric.COSINE else metric


def to_many(metric: Metric, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances (rows by queries) with numpy, adding one dimension at a time: the same doubles as the expressions."""
    v, q = vectors.astype(np.float64), queries.astype(np.float64)
    total = np.zeros((len(v), len(q)))
    for d in range(v.shape[1]):
        a, b = v[:, d, None], q[None, :, d]
        total += a * b if metric is Metric.COSINE else np.abs(a - b) if metric is Metric.MANHATTAN else (a - b) ** 2
    return np.maximum(1.0 - total, 0.0) if metric is Metric.COSINE else total


def of_pairs(metric: Metric, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distance of each row of ``vectors`` to the same row of ``queries``: the same doubles as ``to_many``."""
    total = np.zeros(len(vectors))
    for a, b in zip(vectors.astype(np.float64).T, queries.astype(np.float64).T):
        total += a * b if metric is Metric.COSINE else np.abs(a - b) if metric is Metric.MANHATTAN else (a - b) ** 2
    return np.maximum(1.0 - total, 0.0) if metric is Metric.COSINE else total


def lower_bounds(metric: Metric, queries: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function of vectors: numbers (queries by rows) that no distance of ``to_many`` is below.

    One matrix product adds in any order.  Its rounding, that of the squares and
    that of the distance itself come to less than (5 n + 8) / 2^53 times the sum
    of both squared lengths (and of 1 for cosine) in n dimensions; 8 n + 64 are
    taken off.  Manhattan has no product, its bounds are the distances.
    """
    if metric is Metric.MANHATTAN:
        return lambda vectors: to_many(metric, vectors, queries).T
    slack = (8 * queries.shape[1] + 64) * 2.0**-53
    squares = lambda x: np.einsum("ij,ij->i", x, x)
    q = queries.astype(np.float64)
    if metric is Metric.COSINE:
        asked = np.column_stack([-q, np.ones(len(q)), 1.0 - slack - slack * squares(q)])
        return lambda vectors: asked @ np.column_stack([vectors, -slack * squares(vectors), np.ones(len(vectors))]).T
    asked = np.column_stack([-2.0 * q, np.ones(len(q)), (1.0 - slack) * squares(q)])
    return lambda vectors: asked @ np.column_stack([vectors, (1.0 - slack) * squares(vectors), np.ones(len(vectors))]).T
