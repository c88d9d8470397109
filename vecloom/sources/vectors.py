"""Vector files and synthetic vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.hashing import uniform_vectors
from vecloom.model import POINT

CENTER_SALT, QUERY_SALT = 0xA0761D6478BD642F, 0xD1B54A32D192ED03


def read_fvecs(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(id, vector) of an ``fvecs`` file (dimension as a 32-bit integer before each vector), read in splits.

    Records have one length, so Hadoop's fixed-length reader splits the file at
    record borders; ids are places in the file.
    """
    width = 4 + 4 * dimensions

    def decode(rows):
        for raw, place in rows:
            if int.from_bytes(raw[:4], "little") != dimensions:
                raise ValueError(f"record {place} has another dimension")
            yield place, np.frombuffer(raw, "<f4", offset=4).tolist()

    return spark.sparkContext.binaryRecords(path, width).zipWithIndex().mapPartitions(decode).toDF("id long, vector array<float>")


def write_fvecs(points: DataFrame, path: str) -> int:
    """Writes a small set of vectors by ascending id to one local file; for fixtures."""
    rows = points.select("id", "vector").orderBy("id").toLocalIterator()
    n = 0
    with open(path, "wb") as f:
        for r in rows:
            v = np.asarray(r["vector"], dtype="<f4")
            f.write(len(v).to_bytes(4, "little") + v.tobytes())
            n += 1
    return n


def generate(spark: SparkSession, rows: int, dimensions: int, seed: int = 42, clustered: bool = False, centers: int = 16) -> DataFrame:
    """Points 0 to ``rows`` - 1 of the benchmark stream; any range of it is made on its own by a task."""

    @F.pandas_udf("array<float>")
    def vector(ids: pd.Series) -> pd.Series:
        middle = uniform_vectors(seed ^ CENTER_SALT, centers, dimensions) if clustered else None

        def one(i: int) -> np.ndarray:
            v = uniform_vectors(seed, 1, dimensions, first=int(i))[0]
            return v if middle is None else middle[int(i) % centers] + v * np.float32(0.1)

        return ids.map(one)

    made = spark.range(rows).select("id", vector("id").alias("vector"), F.create_map().cast("map<string,string>").alias("metadata"))
    return made.select(*POINT.fieldNames())
