"""The metadata predicate language: parsed into a small tree, rendered as a Spark expression.

The logic is two-valued: a leaf about a missing key is false for positive
operators and true for ``$ne`` and ``$nin``, so negation is safe everywhere.
Numbers are strings that read as finite decimals.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the language, and what counts as a number.
MAX_DEPTH, MAX_LEAVES, MAX_LIST = 8, 64, 1024
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
COMPARISONS = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


@dataclass(frozen=True)
class Leaf:
    key: str
    op: str
    value: Any


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    children: tuple["Leaf | Node", ...]


Filter = Leaf | Node


class FilterError(ValueError):
    pass


def parse(source: Mapping[str, Any] | None) -> Filter:
    """Checks and parses a filter; None and the empty object accept everything."""
    leaves = [0]

    def leaf(key: str, op: str, value: Any) -> Leaf:
        leaves[0] += 1
        if leaves[0] > MAX_LEAVES:
            raise FilterError(f"a filter has at most {MAX_LEAVES} conditions")
        if op == "$eq" or op == "$ne":
            good = isinstance(value, str)
        elif op in ("$in", "$nin"):
            good = isinstance(value, list) and len(value) <= MAX_LIST and all(isinstance(v, str) for v in value)
            value = tuple(value) if good else value
        elif op == "$exists":
            good = isinstance(value, bool)
        elif op in COMPARISONS:
            good = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
        else:
            raise FilterError(f"unknown operator {op}")
        if not good:
            raise FilterError(f"wrong argument for {op}")
        return Leaf(key, op, value)

    def walk(value: Any, depth: int) -> Node:
        if depth > MAX_DEPTH:
            raise FilterError(f"filters nest at most {MAX_DEPTH} deep")
        if not isinstance(value, Mapping):
            raise FilterError("a filter is an object")
        parts: list[Filter] = []
        for key, arg in value.items():
            if key in ("$and", "$or"):
                if not isinstance(arg, list):
                    raise FilterError(f"{key} needs a list")
                parts.append(Node(key[1:], tuple(walk(a, depth + 1) for a in arg)))
            elif key == "$not":
                parts.append(Node("not", (walk(arg, depth + 1),)))
            elif key.startswith("$"):
                raise FilterError(f"unknown operator {key}")
            elif isinstance(arg, str):
                parts.append(leaf(key, "$eq", arg))
            elif isinstance(arg, Mapping) and arg:
                parts += [leaf(key, op, a) for op, a in arg.items()]
            else:
                raise FilterError(f"{key} needs a string or an object of operators")
        return Node("and", tuple(parts))

    return walk({} if source is None else source, 0)


def number(value: Column) -> Column:
    """The finite number that a string reads as, else null."""
    parsed = F.when(value.rlike(NUMBER), value.try_cast("double"))
    return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)


def column(tree: Filter, lookup: Callable[[str], Column]) -> Column:
    """A boolean that is never null; ``lookup`` gives a key's value, null where it is missing."""
    if isinstance(tree, Node):
        parts = [column(c, lookup) for c in tree.children]
        if tree.op == "not":
            return ~parts[0]
        return reduce(lambda a, b: a & b, parts, F.lit(True)) if tree.op == "and" else reduce(lambda a, b: a | b, parts, F.lit(False))
    value, arg = lookup(tree.key), tree.value
    if tree.op == "$exists":
        return value.isNotNull() if arg else value.isNull()
    if tree.op in ("$eq", "$ne"):
        positive = value == F.lit(arg)
    elif tree.op in ("$in", "$nin"):
        positive = value.isin(*arg) if arg else F.lit(False)
    else:
        n, bound = number(value), F.lit(float(arg))
        positive = {"$gt": n > bound, "$gte": n >= bound, "$lt": n < bound, "$lte": n <= bound}[tree.op]
    found = F.coalesce(positive, F.lit(False))
    return ~found if tree.op in ("$ne", "$nin") else found


def on_metadata(source: Mapping[str, Any] | Filter | None, metadata: Column | None = None, promoted: Mapping[str, str] | None = None) -> Column:
    """The filter over a metadata map; keys in ``promoted`` are read from columns of their own.

    A promoted key is an ordinary column, so its conditions reach the Parquet
    scan as pushed filters and prune partitions.
    """
    tree = source if isinstance(source, (Leaf, Node)) else parse(source)
    m = F.col("metadata") if metadata is None else metadata
    return column(tree, lambda k: F.col(promoted[k]) if promoted and k in promoted else m[k])


def condition(source: Mapping[str, Any] | Filter, promoted: Mapping[str, str] | None = None) -> Column:
    """The filter for a ``where``, which takes null for false: comparisons of promoted keys stay plain, so the scan takes them."""
    tree = source if isinstance(source, (Leaf, Node)) else parse(source)
    if isinstance(tree, Node) and tree.op in ("and", "or") and tree.children:
        return reduce((lambda a, b: a & b) if tree.op == "and" else (lambda a, b: a | b), [condition(c, promoted) for c in tree.children])
    if isinstance(tree, Leaf) and promoted and tree.key in promoted and (tree.op == "$eq" or (tree.op == "$in" and tree.value)):
        value = F.col(promoted[tree.key])
        return value == F.lit(tree.value) if tree.op == "$eq" else value.isin(*tree.value)
    return on_metadata(tree, promoted=promoted)


def matches(tree: Filter, metadata: Mapping[str, str]) -> bool:
    """The filter on one Python mapping: an oracle independent of Spark."""
    if isinstance(tree, Node):
        results = [matches(c, metadata) for c in tree.children]
        return not results[0] if tree.op == "not" else all(results) if tree.op == "and" else any(results)
    value, arg = metadata.get(tree.key), tree.value
    if tree.op == "$exists":
        return (value is not None) == arg
    if tree.op in ("$eq", "$ne"):
        return (value == arg) == (tree.op == "$eq")
    if tree.op in ("$in", "$nin"):
        return (value in arg) == (tree.op == "$in")
    if value is None or not re.fullmatch(NUMBER, value) or not math.isfinite(float(value)):
        return False
    n = float(value)
    return {"$gt": n > arg, "$gte": n >= arg, "$lt": n < arg, "$lte": n <= arg}[tree.op]


def sql(tree: Filter, key_sql: Callable[[str], str]) -> str:
    """The filter as DuckDB SQL over one nullable string expression for each key."""
    if isinstance(tree, Node):
        parts = [sql(c, key_sql) for c in tree.children]
        if tree.op == "not":
            return f"(NOT {parts[0]})"
        return "(" + (" AND " if tree.op == "and" else " OR ").join([*parts, "TRUE" if tree.op == "and" else "FALSE"]) + ")"
    k, quote = key_sql(tree.key), lambda s: "'" + s.replace("'", "''") + "'"
    if tree.op == "$exists":
        return f"({k} IS {'NOT ' if tree.value else ''}NULL)"
    if tree.op in ("$eq", "$ne"):
        base = f"coalesce({k} = {quote(tree.value)}, FALSE)"
    elif tree.op in ("$in", "$nin"):
        base = f"coalesce({k} IN ({', '.join(map(quote, tree.value))}), FALSE)" if tree.value else "FALSE"
    else:
        n = f"CASE WHEN regexp_matches({k}, '{NUMBER}') THEN TRY_CAST({k} AS DOUBLE) END"
        base = f"coalesce({n} {COMPARISONS[tree.op]} {float(tree.value)!r} AND isfinite({n}), FALSE)"
    return f"(NOT {base})" if tree.op in ("$ne", "$nin") else f"({base})"


def required_equalities(tree: Filter) -> list[tuple[str, str]]:
    """Equalities that every match satisfies: those of the outer conjunction, through nested ones."""
    if isinstance(tree, Leaf):
        return [(tree.key, tree.value)] if tree.op == "$eq" else []
    return [pair for c in tree.children for pair in required_equalities(c)] if tree.op == "and" else []


def equality_pairs(tree: Filter) -> list[tuple[str, str]] | None:
    """All pairs if the filter is a conjunction of equalities and nothing else."""

    def plain(t: Filter) -> bool:
        return t.op == "$eq" if isinstance(t, Leaf) else t.op == "and" and all(plain(c) for c in t.children)

    return required_equalities(tree) if plain(tree) else None


def only_equality(tree: Filter, key: str, value: str) -> bool:
    """True if the filter asks for exactly this pair, however often."""
    pairs = equality_pairs(tree)
    return bool(pairs) and set(pairs) == {(key, value)}
