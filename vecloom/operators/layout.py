"""Clustered layout: blocks and packs of each cluster, what covers what, and what is due for merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.hashing import automatic_centroids
from vecloom.operators.sketch import BLOCK_ROWS, PACK_BLOCKS

#: When postings are merged, and when a view is built or rebuilt.
SMALL_EXTENT_ROWS, SMALL_EXTENTS, DEAD_EXTENTS = 510, 3, 16
AUTO_ROWS, RECLUSTER_FACTOR, ROWS_PER_CENTER = 250_000, 4, 4000


def cluster_layout(assigned: DataFrame) -> DataFrame:
    """(cid, block, rows, first_id, last_id): id-ordered runs of at most 170 rows in each cluster."""
    n = F.row_number().over(Window.partitionBy("cid").orderBy("id")) - 1
    rows = assigned.select("cid", "id", F.floor(n / BLOCK_ROWS).cast("int").alias("block"))
    return rows.groupBy("cid", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def packs(layout: DataFrame) -> DataFrame:
    """``layout`` with ``pack``: clusters in order, a cluster that doesn't fit the open pack starts a new one.

    There is one row a cluster (4096 at most), so the running choice is made by one fold.
    """
    sizes = layout.groupBy("cid").agg(F.count(F.lit(1)).alias("blocks"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("cid", "blocks"))).alias("all"))

    def step(acc, c):
        fits = acc["used"] + c["blocks"] <= PACK_BLOCKS
        fresh = ~fits & (acc["used"] > 0)
        pack = F.when(fresh, acc["pack"] + 1).otherwise(acc["pack"])
        before = F.when(fresh, F.lit(0)).otherwise(acc["used"]).cast("long")
        after = before + c["blocks"]
        last = pack + F.floor((after - 1) / PACK_BLOCKS)
        row = F.struct(c["cid"].alias("cid"), pack.alias("first_pack"), before.alias("before"))
        return F.struct(last.alias("pack"), (after - (last - pack) * PACK_BLOCKS).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    kind = layout.schema["cid"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<cid:{kind},first_pack:bigint,before:bigint>>").alias("out"))
    placed = listed.select(F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("p")).select("p.*")
    joined = layout.join(F.broadcast(placed), "cid")
    return joined.withColumn("pack", F.col("first_pack") + F.floor((F.col("before") + F.col("block")) / PACK_BLOCKS)).drop("first_pack", "before")


def merge_due(extents: DataFrame) -> DataFrame:
    """(cid, extents, small, dead, due) from (cid, extent, rows, current)."""
    small = (F.col("current") > 0) & (F.col("current") < SMALL_EXTENT_ROWS)
    found = extents.groupBy("cid").agg(F.count(F.lit(1)).alias("extents"), F.count(F.when(small, 1)).alias("small"), F.count(F.when(F.col("current") == 0, 1)).alias("dead"))
    return found.withColumn("due", (F.col("small") > SMALL_EXTENTS) | (F.col("dead") >= DEAD_EXTENTS))


def liveness(placed: DataFrame, current: DataFrame) -> DataFrame:
    """(pack, block, rows, live): how many rows of each block are the newest version of their id."""
    marked = placed.join(current.select("id", "seq", F.lit(1).alias("live")), ["id", "seq"], "left")
    return marked.groupBy("pack", "block").agg(F.count(F.lit(1)).alias("rows"), F.count("live").alias("live"))


def garbage(placed: DataFrame, current: DataFrame) -> DataFrame:
    """(pack, bytes, garbage) from (pack, id, seq, bytes): raw bytes of each pack, and of its rows that are not the newest version."""
    marked = placed.join(current.select("id", "seq", F.lit(1).alias("live")), ["id", "seq"], "left")
    return marked.groupBy("pack").agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("live").isNull(), F.col("bytes")).otherwise(0)).alias("garbage"))


def summary(layout: DataFrame) -> DataFrame:
    """One row about a clustered layout: clusters, blocks, rows, and the rows of the largest cluster and the smallest block."""
    clusters = layout.groupBy("cid").agg(F.count(F.lit(1)).alias("blocks"), F.sum("rows").alias("rows"), F.min("rows").alias("least"))
    return clusters.agg(F.count(F.lit(1)).alias("clusters"), F.sum("blocks").alias("blocks"), F.sum("rows").alias("rows"), F.max("rows").alias("largest_cluster"), F.min("least").alias("smallest_block"))


def dead_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of ``liveness`` without a live row: they can be dropped from the file list."""
    return blocks.where(F.col("live") == 0).select("pack", "block", "rows")


def reclaim_due(blocks: DataFrame) -> DataFrame:
    """(pack, rows, live) of packs of which at most half is live, the emptiest first: they are worth rewriting."""
    packs = blocks.groupBy("pack").agg(F.sum("rows").alias("rows"), F.sum("live").alias("live"))
    return packs.where(F.col("live") * 2 <= F.col("rows"))


def reclaimed(placed: DataFrame, current: DataFrame, due: DataFrame) -> DataFrame:
    """The rows that remain of the packs in ``due``: what a rewrite writes."""
    kept = placed.join(due.select("pack"), "pack", "left_semi")
    return kept.join(current.select("id", "seq"), ["id", "seq"], "left_semi")


def merged_postings(rows: DataFrame, due: DataFrame) -> DataFrame:
    """``rows`` (cid, extent, id, current) after merging the clusters that are due.

    Small extents of such a cluster become one, numbered after all others; rows
    that are not current go, and so do extents without current rows.
    """
    sizes = rows.groupBy("cid", "extent").agg(F.count(F.when(F.col("current"), 1)).alias("alive"))
    last = rows.groupBy("cid").agg(F.max("extent").alias("last"))
    small = sizes.where(F.col("alive") < SMALL_EXTENT_ROWS).select("cid", "extent", F.lit(True).alias("small"))
    marked = rows.join(due.where("due").select("cid", F.lit(True).alias("due")), "cid", "left").join(small, ["cid", "extent"], "left").join(last, "cid")
    touched = F.coalesce(F.col("due"), F.lit(False)) & F.coalesce(F.col("small"), F.lit(False))
    return marked.where(~touched | F.col("current")).select("cid", F.when(touched, F.col("last") + 1).otherwise(F.col("extent")).alias("extent"), "id", "current")


def uncovered(current: DataFrame, postings: DataFrame) -> DataFrame:
    """Live versions without a copy in the clustered view: they keep their own routing."""
    return current.join(postings.select("id", "seq"), ["id", "seq"], "left_anti")


def covered(current: DataFrame, postings: DataFrame) -> DataFrame:
    return current.join(postings.select("id", "seq"), ["id", "seq"], "left_semi")


def conversion_due(rows: int, centroids: int | None) -> bool:
    """Whether a collection should be clustered (``centroids`` None) or clustered anew."""
    if centroids is None:
        return rows >= AUTO_ROWS
    return rows > centroids * ROWS_PER_CENTER * RECLUSTER_FACTOR and automatic_centroids(rows) > centroids


def convert(index, path: str) -> None:
    """Writes an index's points as the clustered table: one folder a cluster, sorted by id, ready for pruned probes."""
    from vecloom.operators import ivf

    ivf.save(index, path)


def split_local(ids: np.ndarray, vectors: np.ndarray, leaf: int = BLOCK_ROWS) -> np.ndarray:
    """Leaf number of each row: balanced halving along the direction that separates the halves best.

    A group starts from its axis of largest variance; three rounds then project
    on the difference of the halves' means and divide again.  Rows are ordered
    by (projection, id), so the result does not depend on their order.
    """
    x = vectors.astype(np.float64)
    out = np.zeros(len(ids), dtype=np.int64)
    todo, number = [np.arange(len(ids))], 0
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out[rows] = number
            number += 1
            continue
        leaves = max(-(-len(rows) // leaf), 2)
        cut = len(rows) * (leaves // 2) // leaves
        values = x[rows]
        spread = (values**2).sum(axis=0) - values.sum(axis=0) ** 2 / len(rows)
        key = values[:, int(spread.argmax())]
        for _ in range(4):
            rows = rows[np.lexsort((ids[rows], key))]
            values = x[rows]
            key = values @ (values[cut:].mean(axis=0) - values[:cut].mean(axis=0))
        todo += [rows[cut:], rows[:cut]]
    return out


def vector_local(points: DataFrame, by: str = "seal") -> DataFrame:
    """``points`` with ``leaf`` within each sealed group; a seal is bounded, so a group fits a task."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = split_local(pdf["id"].to_numpy(), np.stack(pdf["vector"].to_numpy()))
        return pd.DataFrame({by: pdf[by], "id": pdf["id"], "leaf": leaf})

    kind = points.schema[by].dataType.simpleString()
    return points.select(by, "id", "vector").groupBy(by).applyInPandas(plan, f"{by} {kind}, id long, leaf long")
