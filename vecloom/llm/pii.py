"""Personal data scan with DataFrame functions only.

Patterns propose spans; checks confirm them (parts of an address, the Luhn sum
of a card number, the mod-97 sum of a bank account number, digit counts); words
nearby raise or lower a span's score.  The base kinds (email, ip, card, phone)
are reported whatever their score; the method adds bank account numbers (iban),
of the length that their country has.

The patterns below find the same spans as the plain forms in the comments, in
linear time: possessive quantifiers where nothing could be given back, and a
look-behind so that a long run without a match is read once.

Defined results: a null text counts as empty; rows are never dropped; extra
columns are kept by ``scan`` and clashing ones replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.native_text import EMPTY_SPANS, bind, count_kind, digits, luhn, mod97, notation, spans

# Kinds in the order of the report, and the patterns of the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban")
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Characters of a bank account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _account() -> str:
    """Country, two digits and as many characters as the country has, single spaces allowed between them.

    The country decides how much is taken, so a capital word that follows is left out.
    """
    countries: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        countries.setdefault(n, []).append(country)
    return "|".join(f"(?:{'|'.join(names)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in sorted(countries.items()))


#: For engines with ASCII word borders, and for Spark, whose borders know other letters.
IBAN = rf"\b(?:{_account()})\b"
IBAN_IN_JAVA = rf"(?<![A-Za-z0-9_])(?:{_account()})(?![A-Za-z0-9_])"

#: Score of a confirmed span before its context, and what a context word adds.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.9}
CONTEXT_WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|address|server|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer)\b",
}
LESSENING = r"(?i)\b(?:version|release|example|sample|order|invoice|part|isbn|serial)\b"
CONTEXT_GAIN, CONTEXT_LOSS, CONTEXT_REACH = 0.2, 0.3, 40


def _confirmed(text: Column, kind: str) -> Column:
    def parts_in_range(s: Column) -> Column:
        return F.forall(F.split(s["value"], r"\."), lambda p: bind(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))

    def card(s: Column) -> Column:
        return bind(digits(s["value"]), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))

    if kind == "email":
        return F.when(text.contains("@"), spans(text, EMAIL, kind)).otherwise(EMPTY_SPANS())
    if kind == "ip":
        return F.when(text.rlike(IP), F.filter(spans(text, IP, kind), parts_in_range)).otherwise(EMPTY_SPANS())
    if kind == "card":
        return F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), F.filter(spans(text, CARD, kind), card)).otherwise(EMPTY_SPANS())
    if kind == "phone":
        return F.when(text.contains("+"), F.filter(spans(text, PHONE, kind), lambda s: F.length(digits(s["value"])).between(8, 15))).otherwise(EMPTY_SPANS())
    return F.when(text.rlike(r"[A-Z]{2}[0-9]{2}"), F.filter(spans(text, IBAN_IN_JAVA, kind), lambda s: mod97(F.replace(s["value"], F.lit(" "), F.lit(""))))).otherwise(EMPTY_SPANS())


def found_spans(text: Column) -> Column:
    """All confirmed spans by kind as listed, then start."""
    return bind(F.coalesce(text, F.lit("")), lambda whole: F.concat(*[_confirmed(whole, k) for k in KINDS]))


def scored(text: Column, found: Column) -> Column:
    """Spans with a score from 0 to 1: the kind's base score, moved by words within reach before and after."""

    def of(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT_REACH, F.lit(0))
        near = F.concat(F.substr(text, begin + 1, s["start"] - begin), F.lit(" "), F.substr(text, s["end"] + 1, F.lit(CONTEXT_REACH)))
        value = F.lit(0.0)
        for kind in KINDS:
            telling = F.lit(BASE_SCORE[kind]) + F.when(near.rlike(CONTEXT_WORDS[kind]), CONTEXT_GAIN).otherwise(0.0)
            value = F.when(s["kind"] == kind, telling).otherwise(value)
        value = value - F.when(near.rlike(LESSENING), CONTEXT_LOSS).otherwise(0.0)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), F.round(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)), 3).alias("score"))

    return F.transform(found, of)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: an array of (start, end, kind, value, score)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("pii", bind(found_spans(F.col(text)), lambda found: F.when(F.size(found) > 0, scored(whole, found)).otherwise(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), F.lit(0.0).alias("score"))))))


def report(scanned: DataFrame) -> DataFrame:
    s = F.col("pii")
    base = F.filter(s, lambda x: x["kind"] != "iban")
    counts = [count_kind(s, k).alias(f"n_{k}") for k in KINDS]
    best = F.coalesce(F.array_max(F.transform(s, lambda x: x["score"])), F.lit(0.0)).alias("max_score")
    return scanned.select("doc_id", *counts, F.sha2(notation(base), 256).alias("base_sha256"), notation(s).alias("spans"), best)
