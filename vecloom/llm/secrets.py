"""Secret scan with DataFrame functions only.

Three base patterns (assignments to telling names, access key ids, long
hexadecimal strings) are joined by an entropy scan: candidate strings are runs
of one character class, a window slides over each, and the counts of its
characters change by one character in and one out per step, which updates the
sum of n*log2(n) and so the Shannon entropy.  A candidate is reported if its
most random window reaches the threshold of its class and no allow-list rule
suppresses it.  The allow list never removes base spans.

Entropy is held as integers (n*log2(n) times a million, rounded), so every
engine and partitioning gives the same result.

Defined results: a null text counts as empty and has no spans; rows are never
dropped; extra columns are kept by ``scan`` and clashing ones replaced; texts
and candidates may be of any length, since no pattern recurses over them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.native_text import EMPTY_SPANS, bind, count_kind, notation, redact, spans

# The kinds of the base scan in their order, and their patterns.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # maximal runs; those of fewer than 16 characters fail anyway
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

SCALE = 1_000_000


@dataclass(frozen=True)
class CharacterClass:
    name: str
    alphabet: str
    #: Least bits of entropy of the most random window.
    bits: float


#: Characters in ascending code order; the first class that a candidate fits decides.
CLASSES = (
    CharacterClass("hexadecimal", "0123456789abcdef", 2.8),
    CharacterClass("upper hexadecimal", "0123456789ABCDEF", 2.8),
    CharacterClass("base64", "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", 3.4),
)
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % WINDOW


def _allow(hold: str) -> tuple[str, ...]:
    """Candidates that match one of these are not reported: no digit or no letter, a UUID, a path of words, a placeholder, one repeated character.

    ``hold`` follows the repetitions of groups.  None of them could give back a
    round with success, so possessive ones ("+") find the same; Java needs them,
    since it runs through other repeated groups by recursion, one frame a round.
    """
    # a part of a path that looks like a word, a camel-case name or a number; random keys mix cases and digits otherwise
    word = rf"(?:(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*{hold}|[A-Z]+)[0-9]*|[0-9]+)"
    segment = rf"{word}(?:[_-]{word})*{hold}"
    return (
        r"^[^0-9]*$",
        r"^[^A-Za-z]*$",
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        rf"^/?(?:{segment}/){{2,}}{hold}(?:{segment})?$",
        r"(?i)example|placeholder|dummy|xxxx",
        r"^(.)\1*$",
    )


#: The rules for engines that match in linear time, and for Spark.
ALLOW, ALLOW_IN_JAVA = _allow(""), _allow("+")


def n_log_n(n: int) -> int:
    return round(SCALE * n * math.log2(n)) if n > 1 else 0


def most_spread(bits: float, window: int = WINDOW) -> int:
    """Largest sum of n*log2(n) whose window still has ``bits`` of entropy."""
    return math.floor(SCALE * window * (math.log2(window) - bits))


def least_sum(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Least sum of n*log2(n) over all windows of ``value``: that of the most random one."""
    table = F.array(*[F.lit(n_log_n(n)) for n in range(window + 2)])
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))

    def slide(code: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("n"), F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("least"), F.lit(0).alias("i"))

        def step(acc: Column, c: Column) -> Column:
            full = acc["i"] >= window
            gone = F.when(full, F.get(code, acc["i"] - window)).otherwise(F.lit(-1))

            def counted(out: Column) -> Column:
                was = F.when(out >= 0, F.get(acc["n"], out)).otherwise(F.lit(1))
                less = F.when(out >= 0, F.get(table, was) - F.get(table, was - 1)).otherwise(F.lit(0))
                now = F.get(acc["n"], c) - F.when(out == c, 1).otherwise(0)
                total = acc["sum"] - less + F.get(table, now + 1) - F.get(table, now)
                counts = F.transform(acc["n"], lambda n, k: n + F.when(k == c, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
                least = F.when(acc["i"] + 1 >= window, F.least(acc["least"], total)).otherwise(acc["least"])
                return F.struct(counts.alias("n"), total.alias("sum"), least.alias("least"), (acc["i"] + 1).alias("i"))

            return bind(gone, counted)

        return F.aggregate(code, start, step, lambda acc: acc["least"])

    return bind(codes, slide)


def _entropy_spans(text: Column) -> Column:
    def random_enough(s: Column) -> Column:
        value = s["value"]
        allowed = F.lit(False)
        for rule in ALLOW_IN_JAVA:
            allowed = allowed | value.rlike(rule)
        verdict = F.lit(False)
        for c in reversed(CLASSES):
            within = F.lit(True) if c is CLASSES[-1] else value.rlike(f"^[{c.alphabet}]*$")
            verdict = F.when(within, least_sum(value, c.alphabet) <= most_spread(c.bits)).otherwise(verdict)
        return F.when(allowed, F.lit(False)).otherwise(verdict)

    return F.when(text.rlike(CANDIDATE), F.filter(spans(text, CANDIDATE, "entropy"), random_enough)).otherwise(EMPTY_SPANS())


def found_spans(text: Column) -> Column:
    """All spans of a text, ordered by start, then by kind as listed."""

    def of(whole: Column) -> Column:
        assign = F.filter(spans(whole, ASSIGN, "assign", 1), lambda s: F.length(s["part"]) >= ASSIGN_LEAST)
        access = F.filter(spans(whole, ACCESS, "access"), lambda s: F.length(s["value"]) >= ACCESS_LEAST)
        kinds = [
            F.when(whole.contains("=") | whole.contains(":"), assign).otherwise(EMPTY_SPANS()),
            F.when(whole.contains("AKIA"), access).otherwise(EMPTY_SPANS()),
            F.when(whole.rlike(HEX), spans(whole, HEX, "hex")).otherwise(EMPTY_SPANS()),
            _entropy_spans(whole),
        ]
        rank = F.array(*[F.lit(k) for k in KINDS])
        keyed = F.transform(F.concat(*kinds), lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s.alias("span")))
        return F.transform(F.sort_array(keyed), lambda x: x["span"])

    return bind(F.coalesce(text, F.lit("")), of)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, end, kind, value, part)."""
    return docs.withColumn("secrets", found_spans(F.col(text)))


def base(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind"] != "entropy")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and the notation of all spans."""
    s = F.col("secrets")
    counts = [count_kind(s, k).alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(notation(base(s)), 256).alias("base_sha256"), notation(s).alias("spans"))


def mask(docs: DataFrame, text: str = "text", token: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``token``; texts without one, and nulls, are unchanged."""
    own = F.col(text)
    return docs.withColumn(text, bind(found_spans(own), lambda found: F.when(F.size(found) > 0, redact(own, found, token)).otherwise(own)))
