"""Structured Streaming over the commit log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.model import LOG
from vecloom.sources.store import Store


def log_stream(spark: SparkSession, log: str, files_per_batch: int = 64) -> DataFrame:
    """New commits as they appear below ``log``."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(log)


def latest_stream(stream: DataFrame) -> DataFrame:
    """Newest version of each id, kept as streaming state (complete mode): every id stays in state."""
    version = F.struct("seq", "ord")
    return stream.groupBy("id").agg(F.max_by(F.struct("seq", "ord", "op", "vector", "metadata"), version).alias("v")).select("id", "v.*")


def ingest(stream: DataFrame, store: Store, checkpoint: str):
    """Appends each micro-batch to the store as one commit; the newest version by the stream's own (seq, ord) wins.

    A finished batch leaves its number in the store and is not applied again; one
    that failed between its commit and that mark is repeated at once, before any
    later batch, which writes the same newest versions and changes nothing.
    Versions of one id inside the batch are reduced to the newest.

    Versions may come late: what each batch applied is listed (id, seq, ord), and
    a batch that reaches back behind an earlier one drops the rows of which a
    newer version has been applied.  Other batches read no list.
    """
    spark = store.spark

    def append(batch: DataFrame, number: int) -> None:
        name = f"ingested/{number:020d}.json"
        if store.files.exists(name):
            return
        done = [n for n in store.files.names("ingested") if n.endswith(".json")]
        high = json.loads(store.files.read(f"ingested/{done[-1]}"))["high"] if done else None
        version = F.struct("seq", "ord")
        newest = batch.groupBy("id").agg(F.max_by(F.struct("seq", "ord", "op", "vector", "metadata"), version).alias("v")).select("id", "v.*")
        low, top = batch.agg(F.min("seq"), F.max("seq")).first()
        if low is not None:
            if high is not None and low <= high:
                listed = [f"{store.path}/applied/{n}" for n in store.files.names("applied") if int(n) < number]
                applied = spark.read.schema("id long, seq long, ord int").parquet(*listed).select(F.col("id").alias("known"), version.alias("last"))
                newest = newest.join(applied, (F.col("id") == F.col("known")) & (F.col("last") > version), "left_anti")
            newest.select("id", "seq", "ord").write.mode("overwrite").parquet(f"{store.path}/applied/{number:020d}")
            rows = newest.select(F.lit(0).alias("ord"), "op", "id", "vector", "metadata")
            if not rows.isEmpty():
                store.commit(rows)
        store.files.create(name, json.dumps({"high": max(x for x in (high, top, -1) if x is not None)}))
        while store.maintain() == "seal":
            pass

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
