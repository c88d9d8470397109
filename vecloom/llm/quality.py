"""Quality rules with thresholds that adapt to each language and source, in DataFrame functions only.

Every document is measured on its whole text.  For each (language, source) and
measure a mergeable quantile sketch is kept: counts in logarithmic buckets of
relative width 1/32 (exact below 64).  Sketches of two parts of the data merge
by adding counts, so they are built by an ordinary map-side combined
aggregation, and a group with few documents falls back to the merged sketch of
its language, then of everything.

A cutoff is the group's median plus ``spreads`` times the distance to a
quartile, and at least ``slack`` away from the median, so a group in which a
measure hardly varies doesn't reject ordinary documents.  The cutoffs replace
fixed ones; only the two base rules are fixed.

Measures are integers (thousandths, hundredths), so results are exact and do
not depend on partitioning.

Defined results: a null text has no words; a null language or source is a
group of its own; a text without words fails the base rules; repeated rows
count each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.native_text import bind, lines_with_a_word, repeated_words, words
from vecloom.llm.scratch import materialize


@dataclass(frozen=True)
class Measure:
    name: str
    numerator: str
    denominator: str
    scale: int
    #: Least distance of a cutoff from the median.
    slack: int
    two_sided: bool = False


MEASURES = (
    Measure("word_length", "word_chars", "n_words", 100, 250, two_sided=True),
    Measure("symbols", "n_symbols", "n_words", 1000, 200),
    Measure("dup_lines", "n_dup_lines", "n_lines", 1000, 400),
    Measure("repeats", "n_repeat_words", "n_words", 1000, 400),
)
#: Quartile distances between the median and a cutoff.
SPREADS = 6
#: A group with fewer measured documents uses the next wider one.
LEAST_DOCUMENTS = 200
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
QUANTILES = {"q25": 25, "q50": 50, "q75": 75}


#: Columns that measuring adds; an input column of that name is replaced.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def features(text: Column) -> Column:
    """Base measurements of a whole text as one struct."""
    whole = F.coalesce(text, F.lit(""))
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(bind(words(text), of_words).alias("words"), bind(lines_with_a_word(text), of_lines).alias("lines"), symbols.cast("long").alias("n_symbols"))


def measured(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the MEASURED columns."""
    place = {"n_words": "words.n_words", "word_chars": "words.word_chars", "n_symbols": "n_symbols", "n_lines": "lines.n_lines", "n_dup_lines": "lines.n_dup_lines", "n_repeat_words": "words.n_repeat_words"}
    found = rows.select("*", features(text).alias("measured_text"))
    found = found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"measured_text.{p}").alias(c) for c, p in place.items()])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def value(m: Measure) -> Column:
    return F.expr(f"CASE WHEN {m.denominator} > 0 THEN {m.scale} * {m.numerator} DIV {m.denominator} ELSE 0 END")


def bucket(v: Column) -> Column:
    """Bucket of a non-negative integer: itself below 64, then 32 buckets for each doubling."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(e.cast("long") * 32 + F.call_function("shiftright", v, e))


def edge(b: Column) -> Column:
    """Least value of a bucket."""
    e = F.floor(b / 32).cast("int") - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - e.cast("long") * 32, e))


def group_key(c: str) -> Column:
    """A string that is never null: null is its own group."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def sketches(found: DataFrame) -> DataFrame:
    """(lang_key, source_key, measure, bucket, n) of all documents that pass the base rules."""
    rows = F.explode(F.array(*[F.struct(F.lit(m.name).alias("measure"), bucket(value(m)).alias("bucket")) for m in MEASURES])).alias("s")
    rows = found.where(~F.col("base_failed")).select("lang_key", "source_key", rows)
    return rows.groupBy("lang_key", "source_key", F.col("s.measure").alias("measure"), F.col("s.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Document count and quantiles of the sketches merged over ``keys``; a group has a bounded number of buckets."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    picks = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))).alias(name) for name, q in QUANTILES.items()]
    found = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("documents"), *picks)
    return found.select(*keys, "measure", "documents", *[edge(F.col(q)).alias(q) for q in QUANTILES])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang_key, source_key) with ``low`` and ``high`` of every measure."""
    own = quantiles(sketch, ["lang_key", "source_key"])
    by_lang = quantiles(sketch, ["lang_key"]).select("lang_key", "measure", *[F.col(c).alias(f"lang_{c}") for c in ("documents", *QUANTILES)])
    overall = quantiles(sketch, []).select("measure", *[F.col(c).alias(f"all_{c}") for c in QUANTILES])
    joined = own.join(by_lang, ["lang_key", "measure"]).join(overall, "measure")
    pick = {q: F.when(F.col("documents") >= LEAST_DOCUMENTS, F.col(q)).when(F.col("lang_documents") >= LEAST_DOCUMENTS, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}")) for q in QUANTILES}
    used = joined.select("lang_key", "source_key", "measure", *[c.alias(q) for q, c in pick.items()])
    columns = []
    for m in MEASURES:
        high = F.col("q50") + F.greatest(F.lit(m.slack), SPREADS * (F.col("q75") - F.col("q50")))
        low = F.col("q50") - F.greatest(F.lit(m.slack), SPREADS * (F.col("q50") - F.col("q25"))) if m.two_sided else F.lit(-1)
        columns += [F.max(F.when(F.col("measure") == m.name, high)).cast("long").alias(f"high_{m.name}"), F.max(F.when(F.col("measure") == m.name, low)).cast("long").alias(f"low_{m.name}")]
    return used.groupBy("lang_key", "source_key").agg(*columns)


def _judged(docs: DataFrame, text: str, lang: str, source: str, carry: list[str]) -> DataFrame:
    """(row, MEASURED columns, kept): ``row`` holds the carried columns, so no name of theirs can clash."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), group_key(lang).alias("lang_key"), group_key(source).alias("source_key"), F.col(f"`{text}`").alias("whole_text"))
    found = materialize(measured(keyed, F.col("whole_text")).drop("whole_text"), "measured")
    cutoffs = materialize(thresholds(sketches(found)), "thresholds")
    joined = found.join(cutoffs, ["lang_key", "source_key"], "left")
    fine = F.lit(True)
    for m in MEASURES:
        fine = fine & (value(m) <= F.col(f"high_{m.name}")) & (value(m) >= F.col(f"low_{m.name}"))
    # a group of which no document passes the base rules has no thresholds
    return joined.select("row", *MEASURED, (~F.col("base_failed") & F.coalesce(fine, F.lit(True))).alias("kept"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The documents (columns ``carry``, all by default) with their measurements and ``kept``.

    The measured table is written once to the shared folder; the sketches and
    the joined filter both read it.  The thresholds are a small table whose size
    Spark knows when it chooses the join.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in (*MEASURED, "kept")]
    return _judged(docs, text, lang, source, carried).select("row.*", *MEASURED, "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that all rules keep, with exactly their own columns."""
    return _judged(docs, "text", "lang", "source", docs.columns).where("kept").select("row.*")
