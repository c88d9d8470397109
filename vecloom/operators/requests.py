"""Idempotent and conditional writes, decided in commit order over a bounded window of history."""

from __future__ import annotations

import hashlib
import json
import secrets
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The window in commits, and the bounds of a request.
RETENTION, MAX_CHANGED, MAX_OPERATIONS, MAX_BYTES = 128, 12_800, 100, 1 << 20


class Lookup(StrEnum):
    AHEAD = "ahead"
    RETAINED = "retained"
    EXPIRED = "expired"
    UNKNOWN = "unknown"


class RequestError(ValueError):
    pass


@dataclass(frozen=True)
class Request:
    boundary: int
    nonce: str
    mutations: tuple[tuple, ...]
    conditions: tuple[tuple[int, int], ...] = ()

    def __post_init__(self) -> None:
        if not self.mutations or len(self.mutations) > MAX_OPERATIONS or len(self.conditions) > MAX_OPERATIONS:
            raise RequestError("a request has 1 to 100 mutations and at most 100 conditions")
        ids = [i for i, _ in self.conditions]
        if any(a >= b for a, b in zip(ids, ids[1:])) or any(b > self.boundary for _, b in self.conditions):
            raise RequestError("conditions come by ascending id and don't lie ahead of the request")
        if len(self.encoded()) > MAX_BYTES:
            raise RequestError("the request is too large")

    def encoded(self) -> bytes:
        return json.dumps([self.boundary, self.nonce, self.conditions, self.mutations], sort_keys=True, default=list).encode()

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.encoded()).hexdigest()


@dataclass(frozen=True)
class Outcome:
    seq: int
    conflict: str | None = None


@dataclass
class Window:
    """What the decider remembers: receipts and changed ids of the last commits."""

    seq: int = 0
    floor: int = 0
    receipts: dict[tuple[int, str], tuple[str, Outcome]] = field(default_factory=dict)
    changed: dict[int, int] = field(default_factory=dict)

    def lookup(self, boundary: int, nonce: str) -> tuple[Lookup, Outcome | None]:
        if boundary > self.seq:
            return Lookup.AHEAD, None
        kept = self.receipts.get((boundary, nonce))
        if kept:
            return Lookup.RETAINED, kept[1]
        return (Lookup.EXPIRED if self.seq - boundary >= RETENTION else Lookup.UNKNOWN), None

    def apply(self, request: Request) -> tuple[Outcome, bool]:
        """The outcome, and whether the mutations take effect now."""
        state, known = self.lookup(request.boundary, request.nonce)
        if state is Lookup.RETAINED:
            if self.receipts[request.boundary, request.nonce][0] != request.digest:
                raise RequestError("the request id was used for another request")
            return known, False
        if state is not Lookup.UNKNOWN:
            raise RequestError(f"the request is {state}")
        conflict = next((c for i, b in request.conditions if (c := self._conflict(i, b))), None)
        self._advance(() if conflict else [m[1] for m in request.mutations])
        outcome = Outcome(self.seq, conflict)
        self.receipts[request.boundary, request.nonce] = (request.digest, outcome)
        return outcome, conflict is None

    def commit(self, ids: Sequence[int]) -> int:
        """A plain commit outside the request protocol."""
        self._advance(ids)
        return self.seq

    def apply_group(self, requests: Sequence[Request]) -> list[tuple[Outcome | RequestError, bool]]:
        """Several requests in order, as one arrival: each sees what those before it did; a refused one doesn't stop the rest."""
        found: list[tuple[Outcome | RequestError, bool]] = []
        for request in requests:
            try:
                found.append(self.apply(request))
            except RequestError as refused:
                found.append((refused, False))
        return found

    def revision(self, id: int) -> int:
        """Boundary to name in a condition on this id."""
        return self.seq

    def observe(self, id: int) -> tuple[int, tuple[int, str]]:
        """The revision of an id, and a request id (boundary, nonce) that nobody has used."""
        return self.revision(id), (self.seq, secrets.token_hex(16))

    def _conflict(self, id: int, boundary: int) -> str | None:
        if boundary < self.floor:
            return "expired_revision"
        return "stale_revision" if self.changed.get(id, 0) > boundary else None

    def _advance(self, ids: Sequence[int]) -> None:
        self.seq += 1
        self.floor = max(self.floor, self.seq - RETENTION)
        self.changed = {i: s for i, s in self.changed.items() if s > self.floor} | dict.fromkeys(ids, self.seq)
        if len(self.changed) > MAX_CHANGED:
            self.floor, self.changed = self.seq, {}
        self.receipts = {k: v for k, v in self.receipts.items() if self.seq - k[0] <= RETENTION}


def lookup_state(boundary: Column, retained: Column, seq: Column) -> Column:
    """The state of a request id, as a column."""
    return F.when(boundary > seq, Lookup.AHEAD.value).when(retained, Lookup.RETAINED.value).when(seq - boundary >= RETENTION, Lookup.EXPIRED.value).otherwise(Lookup.UNKNOWN.value)


def lookup_all(requests: DataFrame, receipts: DataFrame, seq: int) -> DataFrame:
    """(boundary, nonce, state, outcome_seq) of many request ids; receipts older than the window are gone."""
    kept = receipts.where(F.lit(seq) - F.col("boundary") <= RETENTION).select("boundary", "nonce", F.col("seq").alias("outcome_seq"))
    joined = requests.select("boundary", "nonce").join(kept, ["boundary", "nonce"], "left")
    state = lookup_state(F.col("boundary"), F.col("outcome_seq").isNotNull(), F.lit(seq))
    return joined.select("boundary", "nonce", state.alias("state"), "outcome_seq")


def dedupe(requests: DataFrame) -> DataFrame:
    """The first arrival of each request id, and whether a later one differs in content."""
    first = requests.groupBy("boundary", "nonce").agg(F.min_by(F.struct("seq", "digest"), "seq").alias("f"), F.count(F.lit(1)).alias("arrivals"), F.count_distinct("digest").alias("digests"))
    return first.select("boundary", "nonce", F.col("f.seq").alias("seq"), F.col("f.digest").alias("digest"), "arrivals", (F.col("digests") > 1).alias("conflict"))


def last_changed(log: DataFrame, as_of: int) -> DataFrame:
    return log.where(F.col("seq") <= as_of).groupBy("id").agg(F.max("seq").alias("changed"))


def floor_of(seq: int) -> int:
    return max(0, seq - RETENTION)


def decide_conditions(conditions: DataFrame, log: DataFrame, seq: int) -> DataFrame:
    """(boundary, nonce, conflict): the first failing condition (by place) of each request, all against one state."""
    joined = conditions.join(last_changed(log, seq), "id", "left")
    verdict = F.when(F.col("revision") < floor_of(seq), "expired_revision").when(F.coalesce("changed", F.lit(0)) > F.col("revision"), "stale_revision")
    marked = joined.withColumn("conflict", verdict)
    return marked.groupBy("boundary", "nonce").agg(F.min_by("conflict", F.when(F.col("conflict").isNotNull(), F.col("place"))).alias("conflict"))
