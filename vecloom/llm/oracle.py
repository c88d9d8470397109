"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others hash with XXH64 (SimHash, sharding), train a model, or run a
tokenizer or a search of packings; the tests check them by brute force.
"""

from __future__ import annotations

from vecloom.llm import pii, quality, secrets
from vecloom.llm.embed_dedup import THRESHOLD

_BLANK, _NOT_BLANK = r"[ \x09-\x0d]+", r"[^ \x09-\x0d]"


def _quality() -> str:
    def bucket(v: str) -> str:
        e = f"(length(bin({v})) - 6)"
        return f"CASE WHEN {v} < 64 THEN {v} ELSE {e} * 32 + ({v} >> {e}) END"

    def edge(b: str) -> str:
        e = f"(({b} // 32) - 1)"
        return f"CASE WHEN {b} < 64 THEN {b} ELSE ({b} - {e} * 32) << {e} END"

    def value(m: quality.Measure) -> str:
        return f"CASE WHEN {m.denominator} > 0 THEN {m.scale} * {m.numerator} // {m.denominator} ELSE 0 END"

    def sketch(name: str, keys: str, by: str) -> str:
        picks = ", ".join(f"{edge(f'min(CASE WHEN upto * 100 >= total * {q} THEN bucket END)')} AS {n}" for n, q in quality.QUANTILES.items())
        part = f"PARTITION BY {by}measure"
        return f"""{name}_c AS (SELECT {keys}measure, bucket, count(*) AS n FROM b GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER ({part}) AS total, sum(n) OVER ({part} ORDER BY bucket) AS upto FROM {name}_c),
{name} AS (SELECT {keys}measure, max(total) AS documents, {picks} FROM {name}_r GROUP BY {keys or ''}measure)"""

    measures = " UNION ALL ".join(f"SELECT lk, sk, '{m.name}' AS measure, {value(m)} AS v FROM f WHERE NOT base_failed" for m in quality.MEASURES)
    used = ", ".join(f"CASE WHEN o.documents >= {quality.LEAST_DOCUMENTS} THEN o.{q} WHEN l.documents >= {quality.LEAST_DOCUMENTS} THEN l.{q} ELSE a.{q} END AS {q}" for q in quality.QUANTILES)
    slack = " ".join(f"WHEN '{m.name}' THEN {m.slack}" for m in quality.MEASURES)
    two = ", ".join(f"'{m.name}'" for m in quality.MEASURES if m.two_sided)
    bad = " OR ".join(f"EXISTS (SELECT 1 FROM cut WHERE cut.lk = f.lk AND cut.sk = f.sk AND cut.measure = '{m.name}' AND ({value(m)} > high OR {value(m)} < low))" for m in quality.MEASURES)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS lk, coalesce('=' || source, 'null') AS sk, coalesce(text, '') AS text,
list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS w,
list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_NOT_BLANK}')) AS l FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
p AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
f0 AS (SELECT d.r, doc_id, lk, sk, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p ON p.r = d.r),
f AS MATERIALIZED (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM f0),
m AS ({measures}), b AS MATERIALIZED (SELECT lk, sk, measure, {bucket('v')} AS bucket FROM m),
{sketch('own', 'lk, sk, ', 'lk, sk, ')}, {sketch('lng', 'lk, ', 'lk, ')}, {sketch('everything', '', '')},
u AS (SELECT o.lk, o.sk, o.measure, {used} FROM own o JOIN lng l ON l.lk = o.lk AND l.measure = o.measure JOIN everything a ON a.measure = o.measure),
cut AS MATERIALIZED (SELECT lk, sk, measure, q50 + greatest(CASE measure {slack} END, {quality.SPREADS} * (q75 - q50)) AS high, CASE WHEN measure IN ({two}) THEN q50 - greatest(CASE measure {slack} END, {quality.SPREADS} * (q50 - q25)) ELSE -1 END AS low FROM u)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT ({bad}) AS kept FROM f"""


def _matches(table: str, pattern: str, kind: str, rank: int, group: int = 0) -> str:
    """Rows (r, rank, kind, a, b, value, part) of a pattern's matches, placed by what lies between them."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, a, a + length(value) AS b, value, part FROM (SELECT r, unnest(ms) AS value, unnest(ps) AS part,
unnest(list_transform(ms, lambda x, i: coalesce(list_sum(list_transform(gaps[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda s: length(s))), 0))) AS a
FROM (SELECT r, regexp_extract_all(text, '{quoted}') AS ms, regexp_extract_all(text, '{quoted}', {group}) AS ps, string_split_regex(text, '{quoted}') AS gaps FROM {table}) WHERE len(ms) > 0)"""


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_DOCS = "d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"


def _pii() -> str:
    luhn = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER) ELSE 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) - CASE WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    account = "replace(value, ' ', '')"
    turned = f"(substr({account}, 5) || substr({account}, 1, 4))"
    numbers = f"array_to_string(list_transform(range(1, length({turned}) + 1), lambda i: CASE WHEN ascii({turned}[i]) >= 65 THEN CAST(ascii({turned}[i]) - 55 AS VARCHAR) ELSE {turned}[i] END), '')"
    mod97 = f"list_reduce(list_transform(range(1, length({numbers}) + 1), lambda i: CAST(({numbers})[i] AS INTEGER)), lambda x, y: (x * 10 + y) % 97) = 1"
    parts = "len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
        (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", parts),
        (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {luhn}"),
        (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
        (pii.IBAN, mod97),
    ]
    rows = " UNION ALL ".join(f"SELECT * FROM ({_matches('d', p, k, i)}) WHERE {test}" for i, (k, (p, test)) in enumerate(zip(pii.KINDS, kinds)))
    context = " ".join(f"WHEN '{k}' THEN {pii.BASE_SCORE[k]} + CASE WHEN regexp_matches(near, '{pii.CONTEXT_WORDS[k]}') THEN {pii.CONTEXT_GAIN} ELSE 0.0 END" for k in pii.KINDS)
    score = f"round(greatest(least(CAST(CASE kind {context} END - CASE WHEN regexp_matches(near, '{pii.LESSENING}') THEN {pii.CONTEXT_LOSS} ELSE 0.0 END AS DOUBLE), 1.0), 0.0), 3)"
    counts = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in pii.KINDS)
    note = "kind || ':' || a || ':' || b"
    return f"""WITH {_DOCS}, s0 AS MATERIALIZED ({rows}),
s AS (SELECT s0.*, substr(text, CAST(greatest(a - {pii.CONTEXT_REACH}, 0) + 1 AS BIGINT), CAST(a - greatest(a - {pii.CONTEXT_REACH}, 0) AS BIGINT)) || ' ' || substr(text, CAST(b + 1 AS BIGINT), {pii.CONTEXT_REACH}) AS near FROM s0 JOIN d USING (r)),
t AS (SELECT *, {score} AS score FROM s),
x AS (SELECT r, {counts}, string_agg({note}, ',' ORDER BY rank, a) FILTER (kind <> 'iban') AS base, string_agg({note}, ',' ORDER BY rank, a) AS spans, max(score) AS best FROM t GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(best, 0.0) AS max_score FROM d LEFT JOIN x ON x.r = d.r"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets() -> str:
    names = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
    assign = rf"(?:{names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    candidate = "[A-Za-z0-9+/_=-]{%d,}" % secrets.WINDOW
    table = "[" + ", ".join(str(secrets.n_log_n(n)) for n in range(secrets.WINDOW + 1)) + "]"
    window = f"substr(value, CAST(i AS BIGINT), {secrets.WINDOW})"
    total = f"list_sum(list_transform(list_distinct(string_split({window}, '')), lambda c: ({table})[length({window}) - length(replace({window}, c, '')) + 1]))"
    least = f"list_min(list_transform(range(1, length(value) - {secrets.WINDOW} + 2), lambda i: {total}))"
    limit = "CASE " + " ".join(f"WHEN regexp_full_match(value, '[{c.alphabet}]*') THEN {secrets.most_spread(c.bits)}" for c in secrets.CLASSES[:-1]) + f" ELSE {secrets.most_spread(secrets.CLASSES[-1].bits)} END"
    allowed = " OR ".join(["len(list_distinct(string_split(value, ''))) = 1", *(f"regexp_matches(value, '{rule}')" for rule in secrets.ALLOW if "\\1" not in rule)])
    kinds = [
        (assign, f"length(part) >= {secrets.ASSIGN_LEAST}", 1),
        (secrets.ACCESS, f"length(value) >= {secrets.ACCESS_LEAST}", 0),
        (r"[0-9a-f]{16,}", "TRUE", 0),
        (candidate, f"NOT ({allowed}) AND {least} <= {limit}", 0),
    ]
    rows = " UNION ALL ".join(f"SELECT * FROM ({_matches('d', p, k, i, g)}) WHERE {test}" for i, (k, (p, test, g)) in enumerate(zip(secrets.KINDS, kinds)))
    counts = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in secrets.KINDS)
    note = "kind || ':' || a || ':' || b"
    return f"""WITH {_DOCS}, s AS MATERIALIZED ({rows}),
x AS (SELECT r, {counts}, string_agg({note}, ',' ORDER BY a, rank) FILTER (kind <> 'entropy') AS base, string_agg({note}, ',' ORDER BY a, rank) AS spans FROM s GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x ON x.r = d.r"""


def _embeddings() -> str:
    """All pairs of equal labels; meant for small tables."""
    x, y = "CAST(p[1] AS DOUBLE)", "CAST(p[2] AS DOUBLE)"
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {x} * {y}))"
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding AS e, label, sqrt({dot('embedding', 'embedding')}) AS n FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e) WHERE {dot('a.e', 'b.e')} / (a.n * b.n) >= {THRESHOLD}),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
c AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(y) FROM reach WHERE reach.x = vec_id), vec_id)) AS component_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links FROM v)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c"""


ORACLE: dict[str, str] = {"op5_quality": _quality(), "op6_pii": _pii(), "op8_embed_dedup": _embeddings(), "op9_secrets": _secrets()}
