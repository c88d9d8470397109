"""A deterministic hashing embedder that stands in for a model: word features, signed, hashed to a fixed width.

It needs no weights, is the same everywhere, and keeps the service's contract: 1
to 64 texts that are not blank, of bounded size, with a prefix for queries and
documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of one request.
MAX_TEXTS, MAX_TEXT_BYTES, MAX_TOTAL_BYTES = 64, 32_768, 262_144
PREFIX = {"query": "query: ", "document": "passage: "}
_WORD = re.compile(r"\w+")


def embed_text(text: str, dimensions: int) -> np.ndarray:
    out = np.zeros(dimensions, dtype=np.float64)
    for word in _WORD.findall(text.lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        out[(h >> 1) % dimensions] += 1.0 if h & 1 else -1.0
    norm = math.sqrt(float((out * out).sum()))
    if norm == 0:
        out[0] = norm = 1.0
    return (out / norm).astype(np.float32)


def embed_batch(texts: Sequence[str], dimensions: int, kind: str = "document", prefix: bool = False) -> list[np.ndarray]:
    """Embeds one checked request."""
    if kind not in PREFIX:
        raise ValueError(f"unknown kind {kind!r}")
    if not 1 <= len(texts) <= MAX_TEXTS:
        raise ValueError(f"a request has 1 to {MAX_TEXTS} texts")
    sizes = [len(t.encode()) for t in texts]
    if any(not t.strip() for t in texts) or max(sizes) > MAX_TEXT_BYTES or sum(sizes) > MAX_TOTAL_BYTES:
        raise ValueError("a text is blank or too large")
    return [embed_text((PREFIX[kind] if prefix else "") + t, dimensions) for t in texts]


def embed(text: Column, dimensions: int) -> Column:
    """Embeds a column in Arrow batches; null stays null."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else embed_text(t, dimensions))

    return vectors(text)
