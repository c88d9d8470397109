"""Nearest neighbours: exact search, the façade over all access paths, and batches of queries.

Results are ordered by (distance, id), so they don't depend on partitioning.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import distance
from vecloom.model import MAX_K, Config, Metric, stored
from vecloom.operators import filters

#: Queries of one batch that are broadcast; a larger one is held against the points block by block.
QUERY_BLOCK = 512
#: Queries and points of one block there: a group is some seconds of work and 6 MB, and a row travels once for 16,384 of the others or 8,192.
QUERIES_AT_ONCE, POINTS_AT_ONCE = 8192, 16_384
#: Queries and points whose bounds are held at once, and pairs whose distances are.
QUERY_TILE, TILE, PAIRS_AT_ONCE = 256, 1024, 16_384


def exact(points: DataFrame, config: Config, query: Sequence[float], k: int, filter: Mapping[str, Any] | filters.Filter | None = None, fields: Sequence[str] = (), promoted: Mapping[str, str] | None = None) -> DataFrame:
    """The k nearest points that match ``filter``: one scan, one distance, top-k in every task and then of all.

    More than ``MAX_K`` that are all there is are sorted by ranges, not in one task.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    q = config.query(query)
    rows = points if filter is None else points.where(filters.condition(filter, promoted))
    found = rows.select("id", distance.to_query(config.metric, "vector", q).alias("distance"), *[f for f in fields if f != "distance"])
    ordered = found.orderBy("distance", "id")
    return ordered if k > MAX_K and rows.select("id").count() <= k else ordered.limit(k)


def late_fields(hits: DataFrame, points: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields fetched for the final hits only; there are k of them at most, which bounds the broadcast."""
    return points.select("id", *fields).join(F.broadcast(hits.limit(MAX_K)), "id")


def resident(points: DataFrame, config: Config, query: Sequence[float], k: int, filter: Mapping[str, Any]) -> DataFrame:
    """Exact search over the rows kept for the collection's declared equality; other filters are refused."""
    if config.resident_filter is None or not filters.only_equality(filters.parse(filter), *config.resident_filter):
        raise ValueError("the filter is not the collection's resident equality")
    return exact(resident_rows(points, config), config, query, k)


def resident_rows(points: DataFrame, config: Config, max_rows: int | None = None) -> DataFrame:
    """The posting of the declared equality; counts it only if a bound is given."""
    if config.resident_filter is None:
        raise ValueError("the collection declares no resident filter")
    key, value = config.resident_filter
    rows = points.where(filters.on_metadata({key: value}))
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"the posting exceeds {max_rows} rows")
    return rows


def knn(points: DataFrame, config: Config, query: Sequence[float], k: int = 10, filter: Mapping[str, Any] | None = None, approximate: Any = None, include: Sequence[str] = ()) -> tuple[DataFrame, dict[str, Any]]:
    """Service form: k from 1 to 1000, the path named in the second result.

    ``approximate`` is a routed or probed search ``(config, query, k, filter) ->
    DataFrame``; without it the search is exact.  The resident path serves its
    own equality exactly.  Nothing is chosen by cost.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    began = time.monotonic()
    tree = filters.parse(filter)
    if approximate is None:
        found, mode = exact(points, config, query, k, tree), "exact_scan"
    elif config.resident_filter and filters.only_equality(tree, *config.resident_filter):
        found, mode = resident(points, config, query, k, filter or {}), "resident_exact"
    else:
        found, mode = approximate(config, query, k, tree), "approximate"
    if include:
        found = late_fields(found, points, include).orderBy("distance", "id")
    return found, {"mode": mode, "plan_ms": (time.monotonic() - began) * 1000}


def by_text(points: DataFrame, config: Config, text: str, k: int = 10, filter: Mapping[str, Any] | None = None, embedder=None, include: Sequence[str] = ()) -> tuple[DataFrame, dict[str, Any]]:
    """``knn`` for a text; ``embedder`` maps a list of texts to vectors, the hashing embedder by default."""
    from vecloom.functions.embed import embed_batch

    vector = embedder([text])[0] if embedder else embed_batch([text], config.dimensions, "query")[0]
    if len(vector) != config.dimensions:
        raise ValueError(f"the embedder gives {len(vector)} dimensions, the collection has {config.dimensions}")
    return knn(points, config, vector, k, filter, include=include)


def batch(points: DataFrame, queries: DataFrame, config: Config, k: int, filter: Mapping[str, Any] | filters.Filter | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, distance, rank) of every query in (qid, vector).

    The queries are a stated set compared with all rows.  Up to ``query_block``
    of them are broadcast, and each task keeps k rows a query before anything is
    shuffled (the window's group limit).  More of them meet the points in blocks:
    no query set reaches the driver or every task.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    q = queries.select("qid", stored(F.col("vector"), config).alias("q"))
    rows = points if filter is None else points.where(filters.condition(filter))
    best = Window.partitionBy("qid").orderBy("distance", "id")
    if q.limit(query_block + 1).count() > query_block:
        scored = _by_blocks(rows.select("id", "vector"), q, config, k)
    else:
        scored = rows.select("id", "vector").join(F.broadcast(q), how="cross").select("qid", "id", distance.between(config.metric, F.col("vector"), F.col("q")).alias("distance"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _by_blocks(points: DataFrame, queries: DataFrame, config: Config, k: int) -> DataFrame:
    """(qid, id, distance): the k nearest of each query in each block of points.

    Points and queries are dealt into blocks by hash; every block of points meets
    every block of queries in one group of bounded size, and there are as many
    tasks as groups, whatever few bytes a group has.
    """
    over = max(1, -(-points.count() // POINTS_AT_ONCE)), max(1, -(-queries.count() // QUERIES_AT_ONCE))
    metric, groups = config.metric, over[0] * over[1]
    kind = queries.schema["qid"].dataType.simpleString()
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = points.withColumn("p", block("id", over[0])).withColumn("b", every(over[1])).repartition(groups, "p", "b")
    right = queries.withColumn("b", block("qid", over[1])).withColumn("p", every(over[0])).repartition(groups, "p", "b")

    def nearest(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, qids = own["id"].combine_chunks(), asked["qid"].combine_chunks()
        if not len(ids) or not len(qids) or not k:
            at, place, found = np.zeros((3, 0), dtype=np.int64)
        else:
            at, place, found = k_nearest(metric, _matrix(own["vector"]), ids.to_numpy(), _matrix(asked["q"]), k)
        return pa.table({"qid": qids.take(pa.array(at)), "id": ids.take(pa.array(place)), "distance": pa.array(found, pa.float64())})

    return left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(nearest, f"qid {kind}, id long, distance double")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows."""
    rows = column.combine_chunks()
    width = np.unique(pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False))
    if len(width) != 1 or width[0] < 0:
        raise ValueError("vectors must not be null and must have one width")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(width[0]))


def k_nearest(metric: Metric, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, point's place, distance) of the k nearest points of every query, ties to the lower id.

    A tile of lower bounds is one matrix product; only points whose bound does
    not exceed the k-th distance known so far get the distance itself, with the
    order of additions that all paths share.  Of equal vectors only the k of
    lowest id can be among the nearest.
    """
    order = np.argsort(ids, kind="stable")
    order = order[_first_copies(vectors[order], k)]
    v, q, ids = vectors[order].astype(np.float64), queries.astype(np.float64), ids[order]
    out = []
    for first in range(0, len(q), QUERY_TILE):
        asked = q[first : first + QUERY_TILE]
        bound = distance.lower_bounds(metric, asked)
        at, place, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = np.full(len(asked), np.inf)
        for start in range(0, len(v), TILE):
            lower = bound(v[start : start + TILE])
            if start == 0 and lower.shape[1] > k:
                # the greatest distance of any k points is a limit
                seeds = np.argpartition(lower, k - 1, axis=1)[:, :k].ravel()
                limit = _of_pairs(metric, v, asked, seeds, np.repeat(np.arange(len(asked)), k)).reshape(-1, k).max(axis=1)
            # not greater, so that what is not a number stays
            new_at, new_place = np.divmod(np.flatnonzero(~(lower > limit[:, None])), lower.shape[1])
            at, place, found = np.append(at, new_at), np.append(place, new_place + start), np.append(found, _of_pairs(metric, v, asked, new_place + start, new_at))
            # places are in id order
            best = np.lexsort((place, found, at))
            at, place, found = at[best], place[best], found[best]
            begins = np.searchsorted(at, np.arange(len(asked)))
            keep = np.arange(len(at)) - begins[at] < k
            at, place, found = at[keep], place[keep], found[keep]
            full = np.bincount(at, minlength=len(asked)) == k
            limit[full] = found[np.cumsum(np.bincount(at, minlength=len(asked)))[full] - 1]
        out.append((at + first, order[place], found))
    return tuple(np.concatenate(x) for x in zip(*out))


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of rows that fewer than k rows before them equal, ascending."""
    rows = np.ascontiguousarray(vectors)
    same = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    by_copy = np.argsort(same, kind="stable")
    count = np.bincount(same)
    return np.sort(by_copy[np.arange(len(same)) - (np.cumsum(count) - count)[same[by_copy]] < k])


def _of_pairs(metric: Metric, vectors: np.ndarray, queries: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    parts = [distance.of_pairs(metric, vectors[place[i : i + PAIRS_AT_ONCE]], queries[at[i : i + PAIRS_AT_ONCE]]) for i in range(0, len(at), PAIRS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def batch_vectors(points: DataFrame, vectors: Sequence[tuple[int, Sequence[float]]], config: Config, k: int, filter: Mapping[str, Any] | filters.Filter | None = None) -> DataFrame:
    """As ``batch`` for queries held by the driver, any number of them, in Arrow batches.

    Every task reduces its rows to k a query with numpy before the final ranking.
    """
    rows = points if filter is None else points.where(filters.condition(filter))
    ids = np.array([i for i, _ in vectors], dtype=np.int64)
    q = np.stack([config.query(v) for _, v in vectors])
    shipped = points.sparkSession.sparkContext.broadcast((ids, q))
    metric = config.metric

    def nearest(batches):
        qid, matrix = shipped.value
        for pdf in batches:
            if not len(pdf) or not k:
                continue
            own = pdf["id"].to_numpy()
            at, place, found = k_nearest(metric, np.stack(pdf["vector"].to_numpy()), own, matrix, k)
            yield pd.DataFrame({"qid": qid[at], "id": own[place], "distance": found})

    found = rows.select("id", "vector").mapInPandas(nearest, "qid long, id long, distance double")
    best = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
