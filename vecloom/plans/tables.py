"""How the driver's tables stand in for points, logs and requests: in Spark, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.model import Config, Metric

DIM = 64
L2, L1, COSINE = (Config(DIM, m) for m in (Metric.SQUARED_EUCLIDEAN, Metric.MANHATTAN, Metric.COSINE))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metadata() -> Column:
    """Keys that are present, absent or malformed, by rules on the id."""
    i = F.col("vec_id")
    values = {
        "label": F.col("label").cast("string"),
        "parity": F.when(i % 2 == 0, "even").otherwise("odd"),
        "score": F.when(i % 7 == 0, None).when(i % 11 == 0, "NaN").when(i % 13 == 0, "1.5f").otherwise((i % 100).cast("string")),
        "cohort": F.when(i % 10 == 0, "yes"),
    }
    whole = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.map_filter(whole, lambda k, v: v.isNotNull())


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), metadata().alias("metadata"))


def vector_of(spark: SparkSession, sf_dir: str, id: int) -> list[float]:
    """One vector, as a client sends it with a query."""
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == id).select("embedding").first()[0]


#: The points as a SQL relation; a missing key is null.
PTS = """pts AS (SELECT vec_id AS id, embedding AS v, CAST(label AS VARCHAR) AS label,
  CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
  CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN 'NaN' WHEN vec_id % 13 = 0 THEN '1.5f' ELSE CAST(vec_id % 100 AS VARCHAR) END AS score,
  CASE WHEN vec_id % 10 = 0 THEN 'yes' END AS cohort FROM embeddings)"""
KEYS = {"label", "parity", "score", "cohort"}


def key_sql(key: str) -> str:
    return key if key in KEYS else "CAST(NULL AS VARCHAR)"


def unit_sql(v: str) -> str:
    """A vector as cosine stores it."""
    norm = f"sqrt(list_reduce(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b))"
    return f"list_transform({v}, lambda x: CAST(CAST(x AS DOUBLE) / {norm} AS FLOAT))"


def distance_sql(metric: Metric, a: str, b: str) -> str:
    """Distance of two list expressions of stored vectors."""
    x, y = "CAST(p[1] AS DOUBLE)", "CAST(p[2] AS DOUBLE)"
    term = {Metric.SQUARED_EUCLIDEAN: f"({x} - {y}) * ({x} - {y})", Metric.MANHATTAN: f"abs({x} - {y})", Metric.COSINE: f"{x} * {y}"}[metric]
    total = f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: {term}), lambda s, t: s + t)"
    return f"greatest(1.0 - {total}, 0.0)" if metric is Metric.COSINE else total


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as commits of ten ordered operations on users; errors delete."""
    e = read(spark, sf_dir, "events")
    deleted = F.col("event_type") == "error"
    vector = F.array(F.col("value").cast("float"), (F.col("event_id") % 7).cast("float"), (F.col("user_id") % 5).cast("float"))
    return e.select(
        F.floor(F.col("event_id") / 10).cast("long").alias("seq"),
        (F.col("event_id") % 10).cast("int").alias("ord"),
        F.when(deleted, "delete").otherwise("put").alias("op"),
        F.col("user_id").alias("id"),
        F.when(~deleted, vector).alias("vector"),
        F.when(~deleted, F.create_map(F.lit("type"), F.col("event_type"))).alias("metadata"),
    )


LOG = """log AS (SELECT CAST(floor(event_id / 10) AS BIGINT) AS seq, CAST(event_id % 10 AS INTEGER) AS ord,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, user_id AS id,
  CAST(value AS FLOAT) AS x, CAST(event_id % 7 AS FLOAT) AS y, CAST(user_id % 5 AS FLOAT) AS z, event_type AS type FROM events)"""


def flat(live: DataFrame) -> DataFrame:
    """Live points of the event log with comparable columns."""
    return live.select("id", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"), F.get("vector", F.lit(2)).alias("z"), F.col("metadata")["type"].alias("type"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request arrivals made from the events: an id that repeats, contents that sometimes differ."""
    e = read(spark, sf_dir, "events")
    last = F.col("event_id")
    return e.select(
        F.greatest(F.floor(last / 40) * 40 - (F.col("user_id") % 3) * 90, F.lit(0)).cast("long").alias("boundary"),
        F.md5((F.col("user_id") % 50).cast("string").cast("binary")).alias("nonce"),
        F.sha2(F.col("event_type").cast("binary"), 256).alias("digest"),
        last.alias("seq"),
    )


REQUESTS = """req AS (SELECT CAST(greatest(floor(event_id / 40) * 40 - (user_id % 3) * 90, 0) AS BIGINT) AS boundary,
  md5(CAST(user_id % 50 AS VARCHAR)) AS nonce, sha256(event_type) AS digest, event_id AS seq FROM events)"""


def last_event(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
