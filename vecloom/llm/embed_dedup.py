"""Near-duplicate embeddings by randomised-rotation binary codes (RaBitQ, Gao and Long 2024).

Each unit vector o is rotated by a fixed random orthogonal matrix and kept as
the signs of its coordinates, the code x = sign(Ro)/sqrt(D), with the stored
correction factor c = <x, Ro>.  For another unit vector q

    <x, Rq> / c  estimates  <o, q>  without bias, and its error is at most
    eps * sqrt((1 - c^2) / c^2 / (D - 1))  with a confidence that eps sets.

The angle between o and q is at least that between q and x less that between
o and x.  A pair can therefore reach the threshold only if

    <x, Rq> >= cos(acos(c) + acos(threshold)),

a bound that holds for every pair, not with a confidence.  Pairs that pass it
are recomputed exactly, in double precision from the stored vectors, and only
those recomputed values decide a link.  All pairs of a label are held against
the bound, so no link is lost, whatever the size of the table; the work grows
with the square of the largest label.

Scale and skew: equal vectors with equal labels are one class.  A label larger
than ``block`` is dealt into blocks, and each pair of blocks is a task group of
bounded size.  Blocks grow with the label, up to ``SPREAD`` times ``block``, so
that a row is sent to ``SPREAD`` groups or few more until then.  A group works
in tiles of bounded size and returns one row a member (its number of links and
the least member of its own cluster), never its pairs.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and those with a null label, link with nothing and are returned as
their own component; a vector without an id links with nothing and has no component; vectors of different lengths never link; repeated rows
count as separate vectors; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.components import connected_components
from vecloom.llm.scratch import materialize

THRESHOLD = 0.93


#: Blocks of a label before its blocks grow, and how many times ``block`` they may reach.
SPREAD = 16
#: Allowance for single precision in the bound.
ROUNDING = 1e-5


@dataclass(frozen=True)
class EmbedConfig:
    threshold: float = THRESHOLD
    #: Classes of one block of a small label.
    block: int = 512
    #: Classes of a block that are held against the other block at once.
    bucket: int = 256
    seed: int = 42


def rotation(dim: int, seed: int) -> np.ndarray:
    """Random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs (n by D, True for positive) and correction factors of unit vectors."""
    turned = vectors @ rotation(vectors.shape[1], seed).T
    signs = turned > 0
    return signs, np.abs(turned).sum(axis=1) / math.sqrt(vectors.shape[1])


def error_bound(correction: np.ndarray, dim: int, eps: float) -> np.ndarray:
    c2 = np.clip(correction * correction, 1e-9, 1.0)
    return eps * np.sqrt((1 - c2) / c2 / max(dim - 1, 1))


def least_product(correction: np.ndarray, threshold: float) -> np.ndarray:
    """Least product of a code with a rotated unit vector whose cosine with the code's own vector reaches ``threshold``."""
    angle = np.arccos(np.clip(correction, -1.0, 1.0)) + math.acos(threshold)
    return np.cos(np.minimum(angle, math.pi)) - ROUNDING


def valid(vector: str = "embedding", label: str = "label") -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _encoded(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """One row a class with its code and the stored correction factor."""
    for pdf in batches:
        for dim, part in pdf.groupby(pdf["v"].map(len)):
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            signs, correction = encode(x / np.linalg.norm(x, axis=1, keepdims=True), seed)
            yield part.assign(code=[c.tobytes() for c in np.packbits(signs, axis=1)], correction=correction, dim=np.int32(dim))


def compare(left: pd.DataFrame, right: pd.DataFrame | None, config: EmbedConfig) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Tile by tile: linked pairs (i in left, j in right) and the number of recomputed pairs.  ``right`` None: within ``left``.

    The bound takes the stored code and correction factor of the left vector
    and the rotated right one.
    """

    def prepared(pdf: pd.DataFrame):
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return x, np.linalg.norm(x, axis=1)

    x, x_norm = prepared(left)
    y, y_norm = (x, x_norm) if right is None else prepared(right)
    dim = x.shape[1]
    codes = np.frombuffer(b"".join(left["code"]), dtype=np.uint8).reshape(len(x), -1)
    turned = ((y / y_norm[:, None]) @ rotation(dim, config.seed).T).astype(np.float32).T
    least = least_product(left["correction"].to_numpy(), config.threshold)[:, None]
    for start in range(0, len(x), config.bucket):
        rows = slice(start, start + config.bucket)
        signs = np.where(np.unpackbits(codes[rows], axis=1)[:, :dim], np.float32(1), np.float32(-1))
        # within a block, a row is compared with later ones only
        first = start + 1 if right is None else 0
        i, j = np.nonzero(signs @ turned[:, first:] / math.sqrt(dim) >= least[rows])
        i, j = i + start, j + first
        if right is None:
            later = j > i
            i, j = i[later], j[later]
        exact = np.empty(len(i))
        for at in range(0, len(i), 65536):
            s = slice(at, at + 65536)
            exact[s] = np.einsum("nd,nd->n", x[i[s]], y[j[s]]) / (x_norm[i[s]] * y_norm[j[s]])
        linked = exact >= config.threshold
        yield i[linked], j[linked], len(i)


def _clusters(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each node's cluster under the links i-j."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def links(classes: DataFrame, config: EmbedConfig = EmbedConfig()) -> DataFrame:
    """(rep, low, n): links of each class within one comparison, and the least class it is connected to there.

    ``classes`` has rep (id), copies, label, v (the vector); the rows of one rep
    add up over comparisons, since no pair is compared twice.
    """
    block = config.block
    typed = classes.schema["label"].dataType.simpleString()
    element = classes.schema["v"].dataType.simpleString()
    rows = classes.select("rep", "copies", "label", "v").mapInPandas(lambda it: _encoded(it, config.seed), f"rep long, copies long, label {typed}, v {element}, code binary, correction double, dim int")
    rows = materialize(rows, "encoded")
    bucket = ["label", "dim"]
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    size = F.least(F.greatest(F.ceil(F.col("n") / SPREAD), F.lit(block)), F.lit(SPREAD * block))
    counts = materialize(counts.withColumn("blocks", F.ceil(F.col("n") / size).cast("int")), "label-sizes")
    sized = rows.join(counts, bucket)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    # a block meets itself and every other block of its label once
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    dealt = sized.withColumn("own", own).select(*bucket, "rep", "copies", "v", "code", "correction", "own", F.explode(meetings).alias("meet"))
    # dealt by label and blocks: dealt by label alone, as the join leaves them, all blocks of a large label would share a task
    dealt = dealt.select("*", F.col("meet.x").alias("x"), F.col("meet.y").alias("y")).drop("meet").repartition(*bucket, "x", "y")

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = key[2], key[3]
        pdf = pdf.sort_values("rep", kind="stable")
        left = pdf[pdf["own"] == x]
        right = None if x == y else pdf[pdf["own"] == y]
        if not len(left) or (right is not None and not len(right)):
            return pd.DataFrame({"rep": [], "low": [], "n": []}).astype("int64")
        reps, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        own = pdf["own"].to_numpy()
        place_left, place_right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        n, least = np.zeros(len(pdf)), np.arange(len(pdf))
        for i, j, _ in compare(left, right, config):
            if not len(i):
                continue
            i, j = place_left[i], place_right[j]
            n += np.bincount(i, weights=copies[j], minlength=len(pdf)) + np.bincount(j, weights=copies[i], minlength=len(pdf))
            joined = np.unique(least[i] * len(pdf) + least[j])
            least = _clusters(len(pdf), joined // len(pdf), joined % len(pdf))[least]
        used = np.flatnonzero(n)
        return pd.DataFrame({"rep": reps[used], "low": reps[least[used]], "n": n[used].astype(np.int64)})

    return dealt.groupBy(*bucket, "x", "y").applyInPandas(group, "rep long, low long, n long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", config: EmbedConfig = EmbedConfig()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    sound = valid("v", "label")
    classes = materialize(rows.where(sound & F.col("vec_id").isNotNull()).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    found = materialize(links(classes, config), "links")
    named = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    totals = found.groupBy("rep").agg(F.sum("n").alias("n"))
    members = materialize(
        classes.join(totals, "rep", "left").join(named, F.col("rep") == F.col("node"), "left").select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "members",
    )
    joined = rows.join(members, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id")
    links_of = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0))
    component = F.when(F.col("vec_id").isNotNull(), component)
    return joined.select("vec_id", links_of.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
