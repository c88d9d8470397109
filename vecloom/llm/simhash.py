"""SimHash near-duplicates found by a generalised pigeonhole search.

Fingerprints have 64 bits; two documents are linked if theirs differ in at most
``distance`` bits.  All work is done on distinct fingerprints, so any number of
copies is one row.

* The bits are grouped into ``m`` partitions with correlated bits together
  (their co-occurrence is counted over all fingerprints).
* Partition i gets a threshold t_i >= -1 with sum(t_i) = distance - m + 1; by
  the generalised pigeonhole principle (Qin et al. 2018) any linked pair is
  within t_i in some partition, -1 meaning that a partition needn't be searched.
  Dynamic programming picks the thresholds, and the best ``m``, that cost least
  by the candidate counts estimated from all fingerprints.
* Probing: each fingerprint looks up its partition keys within t_i; verifying:
  the join keeps a candidate only if the whole fingerprints are close enough.

A key shared by more than ``BUCKET`` fingerprints is never expanded into pairs.
Its members are linked exactly in another way: two fingerprints differ in at
most two bits if and only if some value is within one bit of both, so each
member lists itself and its 64 one-bit neighbours, and members that meet at a
value are chained to the least of them.  At most 65 distinct fingerprints can
meet, so that step is linear and even.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; a null doc_id never names a component and is never dropped by
``keep_one``; rows that share a doc_id stay or go together; repeated rows are all
returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.components import connected_components
from vecloom.llm.scratch import materialize

BITS = 64
#: Fingerprints of one key that are paired directly.
BUCKET = 24
#: Numbers of partitions that are considered.
CHOICES = (2, 3)
SEED = 42


# ------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*[words[k:] for k in range(shingle)])))
    hashes = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): ``fp`` holds the 64 bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, fp long")


# ---------------------------------------------------------------- the search
@dataclass(frozen=True)
class Plan:
    """Bits and threshold of each partition that is searched."""

    partitions: tuple[tuple[tuple[int, ...], int], ...]


def co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both: over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pd.DataFrame({"n": [n], "both": [total.ravel()]})

    sums = fps.select("fp").mapInPandas(count, "n long, both array<double>")
    rows = sums.select("n", F.posexplode("both").alias("place", "both")).groupBy("place").agg(F.sum("n").alias("n"), F.sum("both").alias("both")).collect()  # 4096 rows
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["place"]] = r["both"]
    return (rows[0]["n"] if rows else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """``m`` partitions of nearly equal width, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    left, groups = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        order = sorted(left)
        group = [max(order, key=lambda b: (correlation[b, order].sum(), -b))]
        left.discard(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(tuple(sorted(group)))
    return groups


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def key_of(fp: Column, bits: tuple[int, ...]) -> Column:
    return fp.bitwiseAND(F.lit(_signed(_mask(bits))).cast("long"))


def estimate(fps: DataFrame, groupings: dict[int, list[tuple[int, ...]]]) -> dict[tuple[int, int], float]:
    """For each partition, the candidate rows of an exact search: pairs of small keys, listed neighbours of large ones."""
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), key_of(F.col("fp"), bits).alias("key")) for m, groups in groupings.items() for i, bits in enumerate(groups)]
    sizes = fps.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.m", "k.i", "k.key").agg(F.count(F.lit(1)).alias("n"))
    cost = F.when(F.col("n") <= BUCKET, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * (BITS + 1))
    return {(r["m"], r["i"]): float(r["cost"]) for r in sizes.groupBy("m", "i").agg(F.sum(cost).alias("cost")).collect()}


def allocate(n: int, costs: dict[tuple[int, int], float], groupings: dict[int, list[tuple[int, ...]]], distance: int) -> Plan:
    """Thresholds of least estimated cost over all partitionings, by dynamic programming."""
    best: tuple[float, Plan] | None = None
    for m, groups in groupings.items():
        # states: thresholds given so far, plus one for each partition, to the cheapest choice
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for i, bits in enumerate(groups):
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, min(distance - used, 1) + 1):
                    keys = 0 if t < 0 else 1 if t == 0 else 1 + len(bits)
                    more = cost + keys * (n + costs.get((m, i), 0.0))
                    if used + t + 1 <= distance + 1 and (used + t + 1 not in new or more < new[used + t + 1][0]):
                        new[used + t + 1] = (more, (*chosen, t))
            table = new
        # sum(t) = distance - m + 1, that is sum(t + 1) = distance + 1
        if distance + 1 in table:
            cost, chosen = table[distance + 1]
            plan = Plan(tuple((bits, t) for bits, t in zip(groups, chosen) if t >= 0))
            if best is None or cost < best[0]:
                best = cost, plan
    assert best is not None
    return best[1]


def links(classes: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): linked representatives of ``classes`` (fp, rep); enough of them for all components.

    Pairs of small keys are all there; members of large keys are chained.
    """
    if distance > 2:
        raise ValueError("large keys are linked exactly only up to distance 2")
    n, both = co_occurrence(classes)
    groupings = {m: group_bits(n, both, m) for m in CHOICES}
    plan = allocate(n, estimate(classes, groupings), groupings, distance)
    own, probes = [], []
    for i, (bits, t) in enumerate(plan.partitions):
        key = key_of(F.col("fp"), bits)
        near = [key] + ([key.bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in bits] if t == 1 else [])
        own.append(F.struct(F.lit(i).alias("i"), key.alias("key")))
        probes += [F.struct(F.lit(i).alias("i"), k.alias("key")) for k in near]
    base = classes.select("fp", "rep")
    index = base.select("fp", "rep", F.explode(F.array(*own)).alias("k")).select("fp", "rep", "k.i", "k.key")
    probe = base.select(F.col("fp").alias("fp2"), F.col("rep").alias("rep2"), F.explode(F.array(*probes)).alias("k")).select("fp2", "rep2", F.col("k.i").alias("i2"), F.col("k.key").alias("key2"))
    large = materialize(probe.groupBy("i2", "key2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("i2", "key2"), "large-keys")

    small = index.join(large, (F.col("i") == F.col("i2")) & (F.col("key") == F.col("key2")), "left_anti")
    close = (F.col("i") == F.col("i2")) & (F.col("key") == F.col("key2")) & (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    pairs = small.join(probe, close).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))

    members = probe.join(large, ["i2", "key2"], "left_semi").select("fp2", "rep2").distinct()
    around = F.array(F.col("fp2"), *([F.col("fp2").bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in range(BITS)] if distance else []))
    met = members.select("rep2", F.explode(around).alias("z")).groupBy("z").agg(F.collect_list("rep2").alias("reps")).where(F.size("reps") > 1)
    chained = met.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    return pairs.unionByName(chained)


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row; a component is named by its least doc_id."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(links(classes.where("rep is not null"), distance))
    named = materialize(classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")), "components")
    return fps.join(named, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The documents that name their component, and those without an id."""
    kept = near_duplicates(docs.select("doc_id", "text"), distance).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
