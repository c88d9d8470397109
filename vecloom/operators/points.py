"""The live state of a mutation log: the newest version of each id, deletes removed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.model import LOG, MAX_WRITE_OPERATIONS
from vecloom.operators.filters import on_metadata, parse


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Newest version of each id up to ``as_of``; one map-side combined aggregation."""
    rows = log if as_of is None else log.where(F.col("seq") <= as_of)
    version = F.struct("seq", "ord")
    return rows.groupBy("id").agg(F.max_by(F.struct("seq", "ord", "op", "vector", "metadata"), version).alias("v")).select("id", "v.*")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return latest(log, as_of).where(F.col("op") == "put").select("id", "vector", "metadata")


def live_over(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """A snapshot with a newer log on top: snapshot rows that the log doesn't touch, and what the log leaves."""
    touched = latest(tail)
    kept = snapshot.join(touched.select("id"), "id", "left_anti")
    return kept.select("id", "vector", "metadata").unionByName(touched.where(F.col("op") == "put").select("id", "vector", "metadata"))


def batch(spark: SparkSession, seq: int, mutations: Sequence[tuple]) -> DataFrame:
    """Log rows of one ordered batch: (``put``, id, vector, metadata) or (``delete``, id)."""
    if not mutations:
        raise ValueError("a batch must not be empty")
    rows = []
    for i, m in enumerate(mutations):
        if m[0] == "put":
            rows.append((seq, i, "put", m[1], [float(x) for x in m[2]], dict(m[3] if len(m) > 3 else {})))
        elif m[0] == "delete":
            rows.append((seq, i, "delete", m[1], None, None))
        else:
            raise ValueError(f"unknown mutation {m[0]!r}")
    return spark.createDataFrame(rows, LOG)


def write_batch(spark: SparkSession, seq: int, upserts: Sequence[tuple] = (), deletes: Iterable[int] = ()) -> DataFrame:
    """One bounded write: all upserts, then all deletes."""
    mutations = [("put", *u) for u in upserts] + [("delete", d) for d in deletes]
    if not 1 <= len(mutations) <= MAX_WRITE_OPERATIONS:
        raise ValueError(f"a write has 1 to {MAX_WRITE_OPERATIONS} operations")
    return batch(spark, seq, mutations)


def bulk_upsert(points: DataFrame, first_seq: int, per_commit: int = MAX_WRITE_OPERATIONS) -> DataFrame:
    """Log rows that upsert a whole table in commits of ``per_commit`` operations, dealt by id.

    Commits are numbered by blocks of the id space, without a global sort:
    ``seq`` only has to order versions of one id.
    """
    return points.select((F.lit(first_seq) + F.floor(F.col("id") / per_commit)).cast("long").alias("seq"), F.pmod("id", F.lit(per_commit)).cast("int").alias("ord"), F.lit("put").alias("op"), "id", "vector", "metadata")


def delete_by_filter(points: DataFrame, filter, seq: int) -> DataFrame:
    """Tombstones for every match; refuses a filter that accepts everything by being empty."""
    if not filter or not getattr(parse(filter), "children", ()):
        raise ValueError("refusing to delete without a filter")
    none = F.lit(None)
    return points.where(on_metadata(filter)).select(F.lit(seq).cast("long").alias("seq"), F.lit(0).alias("ord"), F.lit("delete").alias("op"), "id", none.cast("array<float>").alias("vector"), none.cast("map<string,string>").alias("metadata"))


def gaps(log: DataFrame) -> DataFrame:
    """One row: whether the log's commits are contiguous, and its bounds."""
    seen = log.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("commits"))
    return seen.withColumn("contiguous", F.coalesce(F.col("commits") == F.col("last") - F.col("first") + 1, F.lit(True)))
