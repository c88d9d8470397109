"""Quantized sketches: 5-bit codes for each axis of a pack, used to rank blocks before exact scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import distance
from vecloom.model import Config, Metric
from vecloom.operators import filters, search

#: Code levels, and values of a routed key that a pack's dictionary holds.
LEVELS, DICTIONARY = 31, 254
ABSENT, OVERFLOW = 254, 255
BLOCK_ROWS, PACK_BLOCKS = 170, 12


def ranked(points: DataFrame, rows_per_range: int = 1_000_000) -> DataFrame:
    """``points`` with ``rank``, the place of their id from 0 on, without sorting everything in one task.

    Ids are cut into ranges at quantiles; ranks are counted within each range
    and moved by the number of rows in the ranges before it.
    """
    parts = -(-points.count() // rows_per_range)
    cuts = [int(c) for c in points.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts)] if parts > 1 else []
    span = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    rows = points.withColumn("span", span)
    counts = rows.groupBy("span").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    ahead = counts.select("span", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = rows.join(F.broadcast(ahead), "span")
    within = F.row_number().over(Window.partitionBy("span").orderBy("id")) - 1
    return placed.withColumn("rank", F.col("ahead") + within).drop("span", "ahead")


def blocks(points: DataFrame, rows: int = BLOCK_ROWS, per_pack: int = PACK_BLOCKS) -> DataFrame:
    """``points`` with (pack, block): runs of ``rows`` ids, ``per_pack`` runs to a pack."""
    number = F.floor(F.col("rank") / rows).cast("int")
    out = ranked(points).withColumn("pack", F.floor(number / per_pack).cast("int"))
    return out.withColumn("block", number % per_pack).drop("rank")


def stats(packed: DataFrame) -> DataFrame:
    """(pack, minima, scales): per axis the least value and the width of a level, both in single precision."""
    axes = packed.select("pack", F.posexplode("vector").alias("axis", "value"))
    bounds = axes.groupBy("pack", "axis").agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
    span = (F.col("high") - F.col("low")) / F.lit(float(LEVELS))
    each = bounds.select("pack", "axis", F.col("low").cast("float").alias("minimum"), F.when(span > 0, span).otherwise(F.lit(1.0)).cast("float").alias("scale"))
    ordered = F.array_sort(F.collect_list(F.struct("axis", "minimum", "scale")))
    rows = each.groupBy("pack").agg(ordered.alias("s"))  # one row an axis
    return rows.select("pack", F.transform("s", lambda x: x["minimum"]).alias("minima"), F.transform("s", lambda x: x["scale"]).alias("scales"))


def codes(vector: Column, minima: Column, scales: Column) -> Column:
    """Levels 0 to 31 of each axis, rounded half to even."""
    places = F.zip_with(F.zip_with(vector, minima, lambda v, m: v.cast("double") - m.cast("double")), scales, lambda d, s: d / s.cast("double"))
    return F.transform(places, lambda p: F.least(F.greatest(F.rint(p), F.lit(0.0)), F.lit(float(LEVELS))).cast("tinyint"))


def sketched(packed: DataFrame) -> DataFrame:
    """``packed`` with ``minima``, ``scales`` and ``codes``; packs are few and joined on their number."""
    return packed.join(stats(packed), "pack").withColumn("codes", codes(F.col("vector"), F.col("minima"), F.col("scales")))


def level_value(minimum: Column, scale: Column, code: Column) -> Column:
    return minimum.cast("double") + scale.cast("double") * code.cast("double")


def approximate(config: Config, query: Sequence[float]) -> Column:
    """Distance of a sketched row's levels to a query; squared Euclidean stands in for cosine."""
    q = distance.literal(config.query(query))
    values = F.zip_with(F.arrays_zip("minima", "scales"), F.col("codes"), lambda p, c: level_value(p["minima"], p["scales"], c))
    term = (lambda v, x: F.abs(v - x)) if config.metric is Metric.MANHATTAN else (lambda v, x: (v - x) * (v - x))
    return F.aggregate(F.zip_with(values, q, term), F.lit(0.0), lambda s, x: s + x)


def lower_bound(config: Config, query: Sequence[float]) -> Column:
    """Least distance that any code of a pack can have: per axis, to the nearest end of its range."""
    q = distance.literal(config.query(query))
    ends = F.arrays_zip("minima", "scales")

    def gap(e: Column, x: Column) -> Column:
        low, high = e["minima"].cast("double"), level_value(e["minima"], e["scales"], F.lit(LEVELS))
        d = F.greatest(low - x, x - high, F.lit(0.0))
        return d if config.metric is Metric.MANHATTAN else d * d

    return F.aggregate(F.zip_with(ends, q, gap), F.lit(0.0), lambda s, x: s + x)


def route(sketch: DataFrame, config: Config, query: Sequence[float], max_blocks: int, filter: filters.Filter | dict | None = None) -> DataFrame:
    """(pack, block, score) of the blocks whose best eligible row looks nearest, by (score, pack, block)."""
    rows = sketch if filter is None else sketch.where(filters.on_metadata(filter))
    best = rows.groupBy("pack", "block").agg(F.min(approximate(config, query)).alias("score"))
    return best.orderBy("score", "pack", "block").limit(max_blocks)


def choose_spans(candidates: Sequence[tuple[str, int, int]], requests: int = 8, byte_budget: int = 1 << 20) -> list[tuple[str, int, int]]:
    """Byte ranges (object, start, length) to read for blocks given in rank order.

    A block of an object that is already read widens its range, if the bytes in
    between fit the budget; another object takes a further request, if one is
    left.  A block that doesn't fit is passed over, and later ones may still fit.
    """
    ranges: dict[str, list[int]] = {}
    spent = 0
    for name, start, length in candidates:
        end = start + length
        if name in ranges:
            low, high = ranges[name]
            grown = [min(low, start), max(high, end)]
            extra = (grown[1] - grown[0]) - (high - low)
        elif len(ranges) < requests:
            grown, extra = [start, end], length
        else:
            continue
        if spent + extra <= byte_budget:
            ranges[name] = grown
            spent += extra
    return [(name, low, high - low) for name, (low, high) in ranges.items()]


def selective(sketch: DataFrame, config: Config, query: Sequence[float], k: int, max_blocks: int = 12, filter: filters.Filter | dict | None = None, tail: DataFrame | None = None) -> DataFrame:
    """Exact scoring of the rows in the best blocks, and of the unsealed tail; with all blocks it is the exact search."""
    chosen = route(sketch, config, query, max_blocks, filter)
    rows = sketch.join(F.broadcast(chosen.select("pack", "block")), ["pack", "block"], "left_semi").select("id", "vector", "metadata")
    if tail is not None:
        rows = rows.unionByName(tail.select("id", "vector", "metadata"))
    return search.exact(rows, config, query, k, filter)


def routed_dictionary(packed: DataFrame, key: str) -> DataFrame:
    """(pack, values): the first values of a key in byte order, as many as a dictionary holds.

    Values are counted per pack first, and only the first ``DICTIONARY`` of them
    are gathered.
    """
    values = packed.select("pack", F.col("metadata")[key].alias("value")).where("value is not null").distinct()
    first = values.withColumn("n", F.row_number().over(Window.partitionBy("pack").orderBy("value"))).where(F.col("n") <= DICTIONARY)
    return first.groupBy("pack").agg(F.array_sort(F.collect_list("value")).alias("values"))


def routed_code(value: Column, dictionary: Column) -> Column:
    """Place of a value in the dictionary; 254 if the key is absent, 255 if the value overflowed."""
    at = F.array_position(dictionary, value)
    return F.when(value.isNull(), ABSENT).when(F.coalesce(at, F.lit(0)) == 0, OVERFLOW).otherwise(at - 1).cast("int")


def eligible(code: Column, wanted: Column) -> Column:
    """A row may match if its code is the wanted one or unknown."""
    return (code == wanted) | (code == OVERFLOW)
