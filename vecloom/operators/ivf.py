"""Sampling, k-means and inverted files.

Training works on a bounded, deterministic sample (or, for the resident index,
on rows the driver may hold), in single precision with sums in a fixed order, so
centers are reproducible bit for bit.  Assignment and search are distributed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import distance
from vecloom.functions.hashing import sample_priority
from vecloom.model import Config, Metric
from vecloom.operators import filters, search

#: The production profile of training and probing.
SAMPLE_ROWS, ITERATIONS, MAX_CENTERS, SEED = 16_384, 2, 4096, 42
LIBRARY_PROBES, SERVER_PROBES = 16, 32


def training_sample(points: DataFrame, capacity: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """The ``capacity`` rows of least (priority, id): bounded, and independent of row order."""
    return points.select("id", "vector", sample_priority(F.col("id"), seed).alias("priority")).orderBy("priority", "id").limit(capacity)


def _nearest(metric: Metric, vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    scores = distance.to_many(distance.routing_metric(metric), vectors, centers)
    return scores.argmin(axis=1)  # the first of equal scores: the lowest index


def lloyd(metric: Metric, points: np.ndarray, centers: np.ndarray, iterations: int) -> np.ndarray:
    """Moves each center that has members to their mean, or upper median for Manhattan; others stay."""
    out = centers.astype(np.float32).copy()
    for _ in range(iterations):
        owner = _nearest(metric, points, out)
        for c in np.unique(owner):
            own = points[owner == c]
            if metric is Metric.MANHATTAN:
                out[c] = np.sort(own, axis=0)[len(own) // 2]
            else:
                # cumulative sums add from the first row to the last
                out[c] = (np.cumsum(own.astype(np.float64), axis=0)[-1] / len(own)).astype(np.float32)
    return out


def train_bounded(metric: Metric, sample: np.ndarray, count: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Centers from a sample in (priority, id) order; its first rows are the start."""
    return lloyd(metric, sample, sample[:count], iterations)


def farthest_first(metric: Metric, points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Indexes of a seeded first point, then again and again the point farthest from all chosen ones, ties to the lower index."""
    n = len(points)
    count = min(count, n)
    if count == 0:
        return np.zeros(0, dtype=np.int64)
    routing = distance.routing_metric(metric)
    chosen = [seed % n]
    gap = np.full(n, np.inf)
    for _ in range(count - 1):
        gap = np.minimum(gap, distance.to_many(routing, points, points[chosen[-1] : chosen[-1] + 1])[:, 0])
        open_gap = gap.copy()
        open_gap[chosen] = -np.inf
        chosen.append(int(open_gap.argmax()))
    return np.array(chosen, dtype=np.int64)


def farthest_rows(points: DataFrame, metric: Metric, count: int, seed: int, folder: str) -> list[int]:
    """As ``farthest_first`` over a table of any size: places in id order of the chosen rows; ids are unique.

    Every step is one pass that lowers each row's gap and takes the greatest.
    The gaps are written below ``folder``, which the executors share, so a step
    does not repeat the ones before it.
    """
    spark, routing, n = points.sparkSession, distance.routing_metric(metric), points.count()
    count = min(count, n)
    if count < 1:
        return []
    rows = points.select("id", "vector", F.lit(float("inf")).alias("gap"))
    chosen = [rows.orderBy("id").limit(seed % n + 1).orderBy(F.desc("id")).first()]
    for step in range(1, count):
        rows = rows.select("id", "vector", F.least("gap", distance.to_query(routing, "vector", chosen[-1]["vector"])).alias("gap"))
        if step < count - 1:
            schema = rows.schema
            rows.write.parquet(f"{folder}/gaps-{step}")
            rows = spark.read.schema(schema).parquet(f"{folder}/gaps-{step}")
        left = rows.where(~F.col("id").isin([c["id"] for c in chosen]))
        chosen.append(left.agg(F.max_by(F.struct("id", "vector"), F.struct("gap", -F.col("id"))).alias("row")).first()["row"])
    return list(points.agg(*[F.count(F.when(F.col("id") < c["id"], 1)).alias(f"place_{i}") for i, c in enumerate(chosen)]).first())


def renormalized(centers: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Unit centers for cosine conversion; a degenerate one is replaced by its own sample row."""
    norms = np.sqrt((centers.astype(np.float64) ** 2).cumsum(axis=1)[:, -1])
    out = sample[: len(centers)].astype(np.float32).copy()
    sound = norms > 1e-6
    out[sound] = (centers[sound].astype(np.float64) / norms[sound, None]).astype(np.float32)
    return out


def assign(points: DataFrame, centers: np.ndarray, metric: Metric) -> DataFrame:
    """``points`` with ``cid``, the nearest center; the centers' number is bounded, which bounds the broadcast."""
    if not 1 <= len(centers) <= MAX_CENTERS:
        raise ValueError(f"there must be 1 to {MAX_CENTERS} centers")
    shipped = points.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            parts = [_nearest(metric, np.stack(vectors.iloc[at : at + 1024].to_numpy()), shipped.value) for at in range(0, len(vectors), 1024)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0), dtype="int32")

    # a column that is never null: else a join on it gets a test for null, and that assigns every row a second time
    return points.withColumn("cid", F.coalesce(nearest("vector"), F.lit(-1)))


@dataclass(frozen=True)
class Index:
    """Centers and the points with their partition; ``identity`` changes with data and options."""

    config: Config
    centers: np.ndarray
    assigned: DataFrame
    identity: str = ""


def identity(config: Config, sequence: int, **options: Any) -> str:
    text = repr((config.dimensions, str(config.metric), sequence, sorted(options.items())))
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def build(points: DataFrame, config: Config, partitions: int, iterations: int, seed: int = SEED, sequence: int = 0, max_rows: int = 100_000) -> Index:
    """The resident index: farthest-first start and Lloyd over all rows, which the driver holds up to ``max_rows``."""
    if partitions < 1 or iterations < 1:
        raise ValueError("partitions and iterations must be positive")
    rows = points.select("id", "vector").limit(max_rows + 1).toPandas().sort_values("id")
    if len(rows) > max_rows:
        raise ValueError("too many rows for the resident index; use build_bounded")
    name = identity(config, sequence, partitions=partitions, iterations=iterations, seed=seed)
    if not len(rows):
        return Index(config, np.zeros((0, config.dimensions), np.float32), points.withColumn("cid", F.lit(0)), name)
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float32)
    start = vectors[farthest_first(config.metric, vectors, partitions, seed)]
    centers = lloyd(config.metric, vectors, start, iterations)
    return Index(config, centers, assign(points, centers, config.metric), name)


def build_bounded(points: DataFrame, config: Config, count: int, iterations: int = ITERATIONS, seed: int = SEED, capacity: int = SAMPLE_ROWS) -> Index:
    """The scalable index: centers from a bounded sample, every row assigned by the executors."""
    sample = training_sample(points, capacity, seed).toPandas()
    if not len(sample):
        raise ValueError("no rows to train on")
    vectors = np.stack(sample["vector"].to_numpy()).astype(np.float32)
    centers = train_bounded(config.metric, vectors, min(count, MAX_CENTERS), iterations)
    if config.metric is Metric.COSINE:
        centers = renormalized(centers, vectors)
    return Index(config, centers, assign(points, centers, config.metric), identity(config, -1, count=count, iterations=iterations, seed=seed, capacity=capacity))


def save(index: Index, path: str) -> None:
    """Centers, and the points partitioned by ``cid`` so that a probe reads only its partitions."""
    spark = index.assigned.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centers)]
    index.assigned.repartition("cid").sortWithinPartitions("cid", "id").write.partitionBy("cid").parquet(f"{path}/points")
    # the centers are written last: without them there is no index
    spark.createDataFrame(rows, "cid int, center array<float>").withColumn("identity", F.lit(index.identity)).coalesce(1).write.parquet(f"{path}/centers")


def load(spark, path: str, config: Config, expected: str | None = None) -> Index:
    """A saved index; refuses one whose identity differs from what is expected."""
    rows = sorted(spark.read.parquet(f"{path}/centers").collect(), key=lambda r: r["cid"])
    found = rows[0]["identity"] if rows else ""
    if expected is not None and found != expected:
        raise ValueError("the stored index belongs to other data or options")
    centers = np.array([r["center"] for r in rows], dtype=np.float32).reshape(len(rows), config.dimensions)
    return Index(config, centers, spark.read.parquet(f"{path}/points"), found)


def load_or_build(points: DataFrame, path: str, config: Config, partitions: int, iterations: int, seed: int = SEED, sequence: int = 0) -> Index:
    """The stored index of exactly this sequence, configuration and options, built and stored if there is none."""
    spark, name = points.sparkSession, identity(config, sequence, partitions=partitions, iterations=iterations, seed=seed)
    where = f"{path}/{name}"
    try:
        return load(spark, where, config, name)
    except Exception as error:  # a missing path; anything else is raised again by building
        if "PATH_NOT_FOUND" not in str(error):
            raise
    index = build(points, config, partitions, iterations, seed, sequence)
    save(index, where)
    return load(spark, where, config, name)


def nearest_centers(metric: Metric, query: np.ndarray, centers: np.ndarray, n: int) -> list[tuple[int, float]]:
    """(index, score) of the n nearest centers by (score, index)."""
    scores = distance.to_many(distance.routing_metric(metric), centers, query[None, :])[:, 0]
    order = np.lexsort((np.arange(len(scores)), scores))[:n]
    return [(int(i), float(scores[i])) for i in order]


def probe(index: Index, query: Sequence[float], k: int, probes: int, filter: Mapping[str, Any] | filters.Filter | None = None) -> DataFrame:
    """Exact search over the ``probes`` nearest partitions; the literal list of partitions prunes the scan."""
    if probes < 1:
        raise ValueError("probes must be positive")
    q = index.config.query(query)
    chosen = [c for c, _ in nearest_centers(index.config.metric, q, index.centers, probes)]
    return search.exact(index.assigned.where(F.col("cid").isin(chosen)), index.config, query, k, filter)


def center_ranks(index: Index, queries: DataFrame | Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
    """(qid, cid, center_rank) of queries (qid, vector): the order, from 1, in which each probes the partitions."""
    if not isinstance(queries, DataFrame):
        queries = index.assigned.sparkSession.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "qid long, vector array<float>")
    shipped = queries.sparkSession.sparkContext.broadcast((index.config, index.centers))

    @F.pandas_udf("array<int>")
    def order(vectors: pd.Series) -> pd.Series:
        config, centers = shipped.value
        return vectors.map(lambda v: [c for c, _ in nearest_centers(config.metric, config.query(v), centers, len(centers))])

    return queries.select("qid", F.posexplode(order("vector")).alias("place", "cid")).select("qid", "cid", (F.col("place") + 1).alias("center_rank"))


def adaptive(index: Index, query: Sequence[float], k: int, min_probes: int, filter: Mapping[str, Any] | filters.Filter | None = None) -> DataFrame:
    """Probes at least ``min_probes`` partitions and more, in center order, until k rows match or all are read.

    One pass: matches are counted by partition, a running sum over the bounded
    list of ranked centers tells which partitions the loop would have read.
    """
    if min_probes < 1:
        raise ValueError("probes must be positive")
    q = index.config.query(query)
    ranked = nearest_centers(index.config.metric, q, index.centers, len(index.centers))
    spark = index.assigned.sparkSession
    order = spark.createDataFrame([(c, r) for r, (c, _) in enumerate(ranked, 1)], "cid int, center_rank int")
    rows = index.assigned if filter is None else index.assigned.where(filters.on_metadata(filter))
    counts = order.join(rows.groupBy("cid").agg(F.count(F.lit(1)).alias("n")), "cid", "left")
    before = Window.orderBy("center_rank").rowsBetween(Window.unboundedPreceding, -1)
    read = counts.withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0))).where((F.col("center_rank") <= min_probes) | (F.col("before") < k))
    return search.exact(rows.join(F.broadcast(read.select("cid")), "cid", "left_semi"), index.config, query, k)


def work(index: Index, query: Sequence[float], probes: int, filter: Mapping[str, Any] | filters.Filter | None = None) -> tuple[int, int]:
    """Distances computed: to centers, and to matching rows of the probed partitions."""
    q = index.config.query(query)
    chosen = [c for c, _ in nearest_centers(index.config.metric, q, index.centers, probes)]
    rows = index.assigned.where(F.col("cid").isin(chosen))
    return len(index.centers), (rows if filter is None else rows.where(filters.on_metadata(filter))).count()
