"""Sharding by a permutation-filled lookup table (Eisenbud et al. 2016).

Every shard has its own preference order over the slots of a table of prime
size: an offset and a step from two hashes of its name.  Shards take turns, and
at its turn a shard claims its first preferred slot that is free, so shares
differ by one slot at most, and adding or removing a shard moves few slots of
the others.  Placing a row is one hash and one lookup.

Scale: the table has ``table_size`` rows whatever the data; that bound is what
is broadcast.  Rows are placed by the hash of their key without a shuffle, so a
source with a third of all rows spreads like any other.

Defined results: null keys are a value of their own; empty inputs give no rows;
repeated rows get the same shard; clashing columns named ``slot`` or ``shard``
are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preferences(name: str, table_size: int) -> tuple[int, int]:
    """(offset, step) of a shard's permutation of the slots."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % table_size, int.from_bytes(digest[8:16], "big") % (table_size - 1) + 1


def build_table(shards: list[str], table_size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """Index of the shard that owns each slot; a shard with weight w takes w turns a round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(table_size) or table_size < len(shards):
        raise ValueError("the table size must be a prime that is not below the number of shards")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("weights must be one non-negative number a shard, not all zero")
    table = [-1] * table_size
    orders = [preferences(s, table_size) for s in shards]
    place = [offset for offset, _ in orders]
    filled = 0
    while True:
        for i, (_, step) in enumerate(orders):
            for _ in range(turns[i]):
                while table[place[i]] >= 0:
                    place[i] = (place[i] + step) % table_size
                table[place[i]] = i
                filled += 1
                if filled == table_size:
                    return table


def slot_of(keys: list[Column], table_size: int = TABLE_SIZE) -> Column:
    """Slot of a row by the hash of its keys; a null and an empty key differ."""
    text = F.concat_ws("", *[F.coalesce(F.concat(F.length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-")) for k in keys])
    return F.pmod(F.xxhash64(text), F.lit(table_size)).cast("int")


def assign(df: DataFrame, keys: list[str], shards: list[str], table_size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``."""
    table = build_table(shards, table_size, weights)
    spark = df.sparkSession
    slots = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "slot int, shard string")
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")], slot_of([F.col(f"`{k}`") for k in keys], table_size).alias("slot"))
    return rows.join(F.broadcast(slots), "slot", "left").select(*[f"`{c}`" for c in rows.columns], "shard")  # the table's size is a parameter


def moved(before: list[int], after: list[int], shards_before: list[str], shards_after: list[str]) -> float:
    """Share of slots whose owner changes between two tables of the same size."""
    return sum(shards_before[a] != shards_after[b] for a, b in zip(before, after, strict=True)) / len(before)


def write(df: DataFrame, keys: list[str], shards: list[str], path: str, rows_per_file: int = 1_000_000, **options) -> None:
    """One folder a shard, without a shuffle; a task writes at most one open file a shard at a time."""
    assign(df, keys, shards, **options).drop("slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
