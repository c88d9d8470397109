"""Deterministic ids, priorities and fingerprints."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The constants of the SplitMix64 generator.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def splitmix(z: np.ndarray) -> np.ndarray:
    """SplitMix64 output for each state, modulo 2^64."""
    with np.errstate(over="ignore"):
        z = z.astype(np.uint64) + np.uint64(GOLDEN)
        for shift, factor in ((30, FIRST), (27, SECOND)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return z ^ (z >> np.uint64(31))


def priorities(ids: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned sampling priority of each id."""
    return splitmix(np.uint64(seed & _MASK) ^ splitmix(ids.astype(np.int64).view(np.uint64)))


def sample_priority(id_column: Column, seed: int) -> Column:
    """Priority moved into the signed range: it sorts as the unsigned number does."""

    @F.pandas_udf("long")
    def priority(ids: pd.Series) -> pd.Series:
        return pd.Series((priorities(ids.to_numpy(), seed) ^ np.uint64(1 << 63)).view(np.int64))

    return priority(id_column)


def uniform_vectors(seed: int, count: int, dimensions: int, first: int = 0) -> np.ndarray:
    """Rows ``first`` to ``first + count`` of a SplitMix64 stream, high 24 bits mapped to [-1, 1)."""
    with np.errstate(over="ignore"):
        steps = np.arange(first * dimensions, (first + count) * dimensions, dtype=np.uint64)
        bits = splitmix(np.uint64(seed & _MASK) + steps * np.uint64(GOLDEN)) >> np.uint64(40)
    return (bits.astype(np.float32) * np.float32(1 / 8_388_608) - np.float32(1)).reshape(count, dimensions)


def memory_id(scope: Column, text: Column) -> Column:
    """First 63 bits after the sign of SHA-256 over scope, a zero character and text."""
    digest = F.sha2(F.concat(scope, F.lit("\0"), text).cast("binary"), 256)
    # the top bit is cleared in the first hexadecimal digit, so the number fits a signed long
    top = F.substring(F.lit("0123456701234567"), 1, 16)
    first = F.substr(top, F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.conv(F.concat(first, F.substring(digest, 2, 15)), 16, 10).cast("long")


def memory_id_of(scope: str, text: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{scope}\0{text}".encode()).digest()[:8], "big") & (2**63 - 1)


def center_fingerprint(metric: str, center: np.ndarray) -> str:
    """Identity of a center under a metric."""
    return hashlib.sha256(metric.encode() + b"\0" + np.asarray(center, dtype="<f4").tobytes()).hexdigest()


def automatic_centroids(rows: int, rows_per_center: int = 4000, most: int = 4096) -> int:
    """The power of two nearest to rows / rows_per_center on a logarithmic scale, halves upward."""
    if rows <= 0:
        return 1
    return int(min(max(2 ** math.floor(math.log2(rows / rows_per_center) + 0.5), 1), most))


def automatic_centroids_of(rows: Column, rows_per_center: int = 4000, most: int = 4096) -> Column:
    """``automatic_centroids`` as a column."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(rows / F.lit(float(rows_per_center))) + F.lit(0.5)))
    return F.when(rows <= 0, F.lit(1)).otherwise(F.greatest(F.least(power, F.lit(float(most))), F.lit(1.0))).cast("int")
