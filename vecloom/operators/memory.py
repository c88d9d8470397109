"""Agent memory over points: texts remembered in scopes, recalled by similarity, with deterministic ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.embed import embed, embed_text
from vecloom.functions.hashing import memory_id, memory_id_of
from vecloom.model import POINT, Config
from vecloom.operators import points as log_ops
from vecloom.operators import read, search

RESERVED = ("text", "scope")


def check_tags(tags: Mapping[str, str] | None) -> dict[str, str]:
    out = dict(tags or {})
    if any(not isinstance(k, str) or not k or k in RESERVED or not isinstance(v, str) for k, v in out.items()):
        raise ValueError("tags map non-empty, unreserved names to strings")
    return out


def check_scope(scope: str) -> str:
    if not isinstance(scope, str) or not scope:
        raise ValueError("a scope is a non-empty string")
    return scope


def remember(texts: DataFrame, dimensions: int, tags: Sequence[str] = ()) -> DataFrame:
    """Points from (scope, text, tag columns); the same text in the same scope is one point."""
    entries = [x for t in tags for x in (F.lit(t), F.col(t).cast("string"))]
    whole = F.map_concat(F.create_map(F.lit("text"), F.col("text"), F.lit("scope"), F.col("scope")), F.create_map(*entries) if entries else F.create_map().cast("map<string,string>"))
    named = texts.select(memory_id(F.col("scope"), F.col("text")).alias("id"), "text", F.map_filter(whole, lambda k, v: v.isNotNull()).alias("metadata"))
    once = named.groupBy("id").agg(F.min("text").alias("text"), F.min_by("metadata", F.to_json("metadata")).alias("metadata"))
    return once.select("id", embed(F.col("text"), dimensions).alias("vector"), "metadata")


def remember_one(spark: SparkSession, scope: str, text: str, dimensions: int, tags: Mapping[str, str] | None = None) -> DataFrame:
    metadata = check_tags(tags) | {"text": text, "scope": check_scope(scope)}
    return spark.createDataFrame([(memory_id_of(scope, text), embed_text(text, dimensions).tolist(), metadata)], POINT)


def recall(points: DataFrame, config: Config, query: str, scope: str, k: int = 5, tags: Mapping[str, str] | None = None) -> DataFrame:
    """(id, text, score, tags) of the k most similar memories of a scope, by exact search."""
    wanted = check_tags(tags) | {"scope": check_scope(scope)}
    hits = search.exact(points, config, embed_text(query, config.dimensions), k, wanted, fields=["metadata"])
    own = F.map_filter("metadata", lambda key, v: ~key.isin(*RESERVED))
    return hits.select("id", F.col("metadata")["text"].alias("text"), (F.lit(1.0) - F.col("distance")).alias("score"), own.alias("tags"))


def forget(points: DataFrame, seq: int, id: int | None = None, scope: str | None = None, tags: Mapping[str, str] | None = None) -> DataFrame:
    """Tombstones for one memory, or for all of a scope and tags; at least one must be given."""
    wanted = check_tags(tags) | ({"scope": check_scope(scope)} if scope is not None else {})
    if id is None and not wanted:
        raise ValueError("refusing to forget everything")
    rows = points if id is None else points.where(F.col("id") == id)
    return log_ops.delete_by_filter(rows, wanted or {"scope": {"$exists": True}}, seq)


def count(points: DataFrame, scope: str) -> DataFrame:
    return read.count(points, {"scope": check_scope(scope)})
