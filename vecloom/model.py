"""Points, collections and the rules that a vector must satisfy.

A point is ``(id long, vector array<float>, metadata map<string,string>)``; a log
row adds ``(seq long, ord int, op string)`` and leaves vector and metadata null
for deletes.  ``seq`` numbers commits, ``ord`` the operations within one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import StrEnum

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Metric(StrEnum):
    SQUARED_EUCLIDEAN = "squared_euclidean"
    MANHATTAN = "manhattan"
    COSINE = "cosine"


_METADATA = T.MapType(T.StringType(), T.StringType(), False)
_VECTOR = T.ArrayType(T.FloatType(), False)
POINT = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("vector", _VECTOR, False), T.StructField("metadata", _METADATA, False)])
LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("id", T.LongType(), False),
        T.StructField("vector", _VECTOR, True),
        T.StructField("metadata", _METADATA, True),
    ]
)

#: Bounds that are part of the semantics.
MAX_K, DEFAULT_K = 1000, 10
MAX_SCAN, DEFAULT_SCAN = 10_000, 1000
MAX_BATCH_GET = 1000
MAX_WRITE_OPERATIONS = 100
MAX_ROUTED_KEYS = 4
BLOCK_BYTES, BLOCK_OVERHEAD = 122_880, 13
MAX_POINT_BYTES = BLOCK_BYTES - BLOCK_OVERHEAD
COLLECTION_NAME = re.compile(r"[a-z0-9][a-z0-9-]{0,62}")


@dataclass(frozen=True)
class Config:
    """A collection: fixed dimensions and metric, and what is declared for filtered access."""

    dimensions: int
    metric: Metric = Metric.SQUARED_EUCLIDEAN
    name: str = "default"
    resident_filter: tuple[str, str] | None = None
    routed_keys: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.dimensions <= 0:
            raise ValueError("dimensions must be positive")
        if not COLLECTION_NAME.fullmatch(self.name):
            raise ValueError(f"invalid collection name {self.name!r}")
        if len(set(self.routed_keys)) != len(self.routed_keys) or len(self.routed_keys) > MAX_ROUTED_KEYS:
            raise ValueError(f"at most {MAX_ROUTED_KEYS} distinct routed keys are allowed")
        object.__setattr__(self, "metric", Metric(self.metric))
        object.__setattr__(self, "routed_keys", tuple(sorted(self.routed_keys)))

    def query(self, vector: Sequence[float]) -> np.ndarray:
        """A checked query vector in single precision; unit length for cosine."""
        q = np.asarray(vector, dtype=np.float32)
        if q.shape != (self.dimensions,) or not np.isfinite(q).all():
            raise ValueError(f"a query needs {self.dimensions} finite components")
        if self.metric is Metric.COSINE:
            norm = math.sqrt(_ordered_sum(q.astype(np.float64) ** 2))
            if norm == 0:
                raise ValueError("cosine needs a vector that is not zero")
            q = (q.astype(np.float64) / norm).astype(np.float32)
        return q


def _ordered_sum(values: np.ndarray) -> float:
    total = 0.0
    for v in values.tolist():
        total += v
    return total


def is_valid(vector: Column, config: Config) -> Column:
    """True for vectors that the collection accepts; never null."""
    fine = (F.size(vector) == config.dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if config.metric is Metric.COSINE:
        fine = fine & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine & vector.isNotNull(), F.lit(False))


def stored(vector: Column, config: Config) -> Column:
    """The vector as it is kept: unit length in single precision for cosine."""
    if config.metric is not Metric.COSINE:
        return vector
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    norm = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: (x.cast("double") / n).cast("float"))), 1)


def row_bytes(vector: Column, metadata: Column) -> Column:
    """Raw size of a stored point: header, components, and UTF-8 metadata with length prefixes."""
    pairs = F.aggregate(F.map_entries(metadata), F.lit(0), lambda n, e: n + 8 + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return (F.lit(21) + 4 * F.size(vector) + pairs).cast("long")


def fits(vector: Column, metadata: Column) -> Column:
    return row_bytes(vector, metadata) <= MAX_POINT_BYTES


def checked(points: DataFrame, config: Config) -> DataFrame:
    """``points`` as stored; a row that the collection must refuse raises when it is read."""
    refused = ~is_valid(F.col("vector"), config) | ~fits(F.col("vector"), F.col("metadata")) | F.col("id").isNull() | (F.col("id") < 0)
    vector = F.when(refused, F.raise_error(F.concat(F.lit("point refused: "), F.col("id").cast("string"))).cast("array<float>")).otherwise(stored(F.col("vector"), config))
    return points.withColumn("vector", vector)
