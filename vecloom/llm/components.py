"""Connected components of a link table, distributed and skew-aware.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
only takes minima per node (map-side combined) and joins them back, so no node
gathers its neighbours in one place and a hub is an ordinary skewed join that
adaptive execution may split.  The number of rounds is logarithmic in the
component size.  Every round is a Parquet table in the shared folder; the one
before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.scratch import materialize


def _with_minimum(directed: DataFrame) -> DataFrame:
    """(u, v) pairs with m = the least of u and all its v."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    joined = directed.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k"), "inner")
    return joined.select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _with_minimum(edges)
    moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(linked.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1] or 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; a component is named by its least node.

    Self links and null ends are ignored; repeated and reversed links count once.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "links")
    before = _state(edges)
    for _ in range(max_rounds if before[0] else 0):
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "star", instead_of=edges)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
