"""Scans, counts and point reads over live points."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.model import DEFAULT_SCAN, MAX_BATCH_GET, MAX_SCAN
from vecloom.operators.filters import on_metadata


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    #: One row: ``matched`` (all matches, before cursor and limit) and ``next`` (null on the last page).
    summary: DataFrame


def scan(points: DataFrame, filter: Mapping[str, Any] | None = None, after: int | None = None, limit: int = DEFAULT_SCAN, include_metadata: bool = False) -> Page:
    """One page in ascending id order; ``next`` is the page's last id if more rows follow it."""
    if not 1 <= limit <= MAX_SCAN:
        raise ValueError(f"limit must be from 1 to {MAX_SCAN}")
    matches = points.where(on_metadata(filter))
    rest = matches if after is None else matches.where(F.col("id") > after)
    columns = ["id", "metadata"] if include_metadata else ["id"]
    ahead = rest.select("id").orderBy("id").limit(limit + 1)  # at most limit + 1 ids
    seen = ahead.agg(F.sort_array(F.collect_list("id")).alias("ids"))
    following = F.when(F.size("ids") > limit, F.element_at("ids", limit)).alias("next")
    total = matches.agg(F.count(F.lit(1)).alias("matched"))
    return Page(rest.select(*columns).orderBy("id").limit(limit), total.join(seen.select(following), how="cross"))


def count(points: DataFrame, filter: Mapping[str, Any] | None = None) -> DataFrame:
    return points.where(on_metadata(filter)).agg(F.count(F.lit(1)).alias("matched"))


def pages(points: DataFrame, filter: Mapping[str, Any] | None = None, limit: int = DEFAULT_SCAN) -> Iterator[DataFrame]:
    """Every page in turn by its cursor."""
    after = None
    while True:
        page = scan(points, filter, after, limit)
        yield page.rows
        after = page.summary.first()["next"]
        if after is None:
            return


def exhaustive(points: DataFrame, filter: Mapping[str, Any] | None = None) -> DataFrame:
    """All matching ids: what following every cursor gives, in one distributed scan."""
    return points.where(on_metadata(filter)).select("id")


def get(points: DataFrame, id: int) -> DataFrame:
    return points.where(F.col("id") == id)


def get_metadata(points: DataFrame, id: int) -> DataFrame:
    return get(points, id).select("metadata")


def _requested(points: DataFrame, ids: Sequence[int]) -> DataFrame:
    spark = points.sparkSession
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(int(i)).cast("long") for i in ids])).alias("pos", "id"))


def batch_get(points: DataFrame, ids: Sequence[int], service: bool = True) -> DataFrame:
    """(pos, id, found, vector, metadata) in request order, duplicates repeated."""
    if service and not 1 <= len(ids) <= MAX_BATCH_GET:
        raise ValueError(f"a batch has 1 to {MAX_BATCH_GET} ids")
    # the request names its ids, so the scan is pruned by them before the join
    wanted = points.where(F.col("id").isin([int(i) for i in ids])).withColumn("found", F.lit(True))
    joined = _requested(points, ids).join(wanted, "id", "left")
    return joined.select("pos", "id", F.coalesce("found", F.lit(False)).alias("found"), "vector", "metadata")


def batch_missing(points: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(pos, id) of requested ids that are not live."""
    return batch_get(points, ids).where(~F.col("found")).select("pos", "id")


def get_many(points: DataFrame, ids: Sequence[int]) -> DataFrame:
    """As ``batch_get`` for any number of ids: the request becomes a table of its own."""
    request = points.sparkSession.createDataFrame([(p, int(i)) for p, i in enumerate(ids)], "pos int, id long")
    joined = request.join(points.withColumn("found", F.lit(True)), "id", "left")
    return joined.select("pos", "id", F.coalesce("found", F.lit(False)).alias("found"), "vector", "metadata")
