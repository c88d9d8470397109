"""Text expressions built from DataFrame functions only (no Python on the executors).

Blanks are the six ASCII ones (space and tab to carriage return); a word is a
run of anything else.  Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t-\r]"
NOT_BLANK = r"[^ \t-\r]"
#: Matches that one fold lists.
AT_ONCE = 128


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a whole text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), "")


def lines_with_a_word(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(NOT_BLANK))


def repeated_words(w: Column, size: int = 3) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more in the text.

    A text whose window hashes all differ has none, which settles most texts by
    a hash set; the others sort their windows (by hash, then by the words
    themselves, so that equal hashes of unequal windows do no harm).
    """
    n = F.size(w) - F.lit(size - 1)

    def of_windows(windows: Column) -> Column:
        parts = [str(k) for k in range(size)]
        hashed = F.transform(windows, lambda x: F.xxhash64(*[x[p] for p in parts]))
        keyed = F.transform(windows, lambda x, i: F.struct(F.xxhash64(*[x[p] for p in parts]).alias("h"), *[x[p].alias(f"w{p}") for p in parts], i.alias("i")))
        same = ["h", *(f"w{p}" for p in parts)]

        def covered(ordered: Column) -> Column:
            pairs = F.zip_with(
                F.slice(ordered, F.lit(1), F.size(ordered) - 1),
                F.slice(ordered, F.lit(2), F.size(ordered) - 1),
                lambda a, b: F.when(_all(a[f] == b[f] for f in same), F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
            )
            places = F.transform(F.array_distinct(F.flatten(pairs)), lambda p: F.sequence(p, p + F.lit(size - 1)))
            return F.size(F.array_distinct(F.flatten(places)))

        return bind(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(F.sort_array(keyed), covered)))

    shifted = F.arrays_zip(*[F.slice(w, F.lit(k + 1), n).alias(str(k)) for k in range(size)])
    return F.when(n < 2, F.lit(0)).otherwise(bind(shifted, of_windows))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def spans(text: Column, pattern: str, kind: str, group: int | None = None) -> Column:
    """Every leftmost, non-overlapping match as (start, end, kind, value, part).

    What lies between the matches gives their places: ``split`` returns those
    pieces and ``regexp_extract_all`` the matches themselves.  ``part`` is the
    given capture group, the whole match without one.
    """
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    part = found if group is None else F.regexp_extract_all(text, regex, F.lit(group))
    rows = F.arrays_zip(found.alias("value"), part.alias("part"), F.split(text, pattern).alias("gap"))
    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["gap"])
        end = begin + F.length(row["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), row["value"].alias("value"), row["part"].alias("part"))
        # the last gap has no match after it
        return F.when(row["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    # a fold copies its state at every step, so spans are listed for some matches at a time
    def over(rows: Column) -> Column:
        def block(acc: Column, first: Column) -> Column:
            fresh = F.struct(acc["at"].alias("at"), EMPTY_SPANS().alias("out"))
            return F.aggregate(F.slice(rows, first, F.lit(AT_ONCE)), fresh, step, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["blocks"], F.array(s["out"])).alias("blocks")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("blocks"))
        return F.aggregate(F.sequence(F.lit(1), F.size(rows), F.lit(AT_ONCE)), start, block, lambda acc: F.flatten(acc["blocks"]))

    return bind(rows, over)


SPAN = "struct<start:int,end:int,kind:string,value:string,part:string>"


def EMPTY_SPANS() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """True if a string of ASCII digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda c, i: bind(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(places, F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(account: Column) -> Column:
    """True if a compact account number passes the ISO 7064 mod 97-10 check after moving its first four characters to the end."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda acc, c: bind(F.ascii(c), lambda a: F.when(a >= 65, (acc * 100 + a - 55) % 97).otherwise((acc * 10 + a - 48) % 97))
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def notation(found: Column) -> Column:
    """kind:start:end of each span, comma-joined in the given order."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, found: Column, mask: str) -> Column:
    """``text`` with every span replaced by ``mask``; overlapping or touching spans give one mask.

    ``found`` must be ordered by start.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] <= acc["at"]) & (acc["at"] > 0), inside).otherwise(fresh)

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
