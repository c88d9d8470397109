"""Recall, percentiles and work counts of approximate searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, k, hits, recall) from two tables of (qid, id); queries without an answer count zero."""
    wanted = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("k"))
    hits = found.join(truth.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    joined = wanted.join(hits, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.withColumn("recall", F.col("hits") / F.col("k"))


def recall_within(truth: DataFrame, read: DataFrame) -> DataFrame:
    """As ``recall`` for a search that is exact within the rows of ``read`` (id), without searching them.

    A true neighbour that is read is among the k nearest of what is read, since
    no more rows come before it there than among all; one that is not read is not
    found.  So the hits are the true neighbours that are read, and (qid, id) of
    the truth are used once.
    """
    at = truth.select("qid", "id").join(read.select("id", F.lit(1).alias("read")).distinct(), "id", "left")
    counted = at.groupBy("qid").agg(F.count(F.lit(1)).alias("k"), F.count("read").alias("hits"))
    return counted.withColumn("recall", F.col("hits") / F.col("k"))


def probe_recall(truth: DataFrame, placed: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """(probes, qid, k, hits, recall) for 1 to ``most`` probes of every query's own nearest partitions.

    ``truth`` has (qid, id), ``placed`` (id, cid) and ``ranks`` (qid, cid,
    center_rank).  A probe is exact within what it reads, so it finds just those
    true neighbours whose partition it reads.
    """
    at = truth.select("qid", "id").join(placed.select("id", "cid"), "id").join(ranks, ["qid", "cid"])
    counts = [F.struct(F.lit(p).alias("probes"), F.count(F.when(F.col("center_rank") <= p, 1)).alias("hits")) for p in range(1, most + 1)]
    found = at.groupBy("qid").agg(F.count(F.lit(1)).alias("k"), F.array(*counts).alias("by_probes")).select("qid", "k", F.explode("by_probes").alias("p"))
    return found.select("p.probes", "qid", "k", "p.hits", (F.col("p.hits") / F.col("k")).alias("recall"))


def percentile(column: str, p: float):
    """Nearest-rank percentile."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def summary(recalls: DataFrame, wanted: int) -> DataFrame:
    """One row: mean and fifth percentile of recall, and the share of queries with fewer than ``wanted`` truths."""
    return recalls.agg(F.avg("recall").alias("mean"), percentile("recall", 0.05).alias("p5"), F.avg((F.col("k") < wanted).cast("double")).alias("short"))


def latency(samples: DataFrame, column: str = "value") -> DataFrame:
    return samples.agg(*[percentile(column, p / 100).alias(f"p{p}") for p in (50, 95, 99)])
