"""Typed metadata predicates: a small expression tree, a dict syntax for it, and two ways to a BOOLEAN column.

A leaf is never NULL: a missing field makes it false, so that ``Not`` is a complement over all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOLEAN, FLOAT, INTEGER, STRING

_ORDERED = {"$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte"}
_FALSE = F.lit


def kind_of(value) -> int:
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return INTEGER
    if isinstance(value, float):
        return FLOAT
    if isinstance(value, str):
        return STRING
    raise TypeError("metadata values are strings, whole numbers, floats or booleans")


class Where:
    def __and__(self, other: Where) -> Where:
        return Junction("all", (self, other))

    def __or__(self, other: Where) -> Where:
        return Junction("any", (self, other))

    def __invert__(self) -> Where:
        return Not(self)


@dataclass(frozen=True)
class Leaf(Where):
    op: str
    key: str
    values: tuple

    def __post_init__(self):
        if not self.key:
            raise ValueError("a predicate needs a field")
        if not self.values:
            raise ValueError("$in and $nin need at least one value")
        kinds = {kind_of(v) for v in self.values}
        if len(kinds) > 1:
            raise TypeError("all values of a list must have one type")
        if self.op in _ORDERED.values() and not kinds <= {INTEGER, FLOAT}:
            raise TypeError("ordered predicates need a whole number or a float")


@dataclass(frozen=True)
class Junction(Where):
    op: str
    parts: tuple

    def __post_init__(self):
        if not self.parts:
            raise ValueError("$and and $or need at least one predicate")


@dataclass(frozen=True)
class Not(Where):
    part: Where


def eq(key, value):
    return Leaf("in", key, (value,))


def ne(key, value):
    return Leaf("not_in", key, (value,))


def in_(key, values):
    return Leaf("in", key, tuple(values))


def not_in(key, values):
    return Leaf("not_in", key, tuple(values))


def gt(key, value):
    return Leaf("gt", key, (value,))


def gte(key, value):
    return Leaf("gte", key, (value,))


def lt(key, value):
    return Leaf("lt", key, (value,))


def lte(key, value):
    return Leaf("lte", key, (value,))


def parse(tree: dict) -> Where:
    """``{field: value}``, ``{field: {"$gt": 3, ..}}``, ``$and``, ``$or`` and ``$not``; several entries are ANDed."""
    if isinstance(tree, Where):
        return tree
    if not isinstance(tree, dict):
        raise TypeError("where is a dict")
    if not tree:
        raise ValueError("where must not be empty")
    parts = [_entry(k, v) for k, v in tree.items()]
    return parts[0] if len(parts) == 1 else Junction("all", tuple(parts))


def _entry(key, value) -> Where:
    if not isinstance(key, str):
        raise TypeError("fields are strings")
    if key in ("$and", "$or"):
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"{key} takes a list")
        return Junction("all" if key == "$and" else "any", tuple(parse(v) for v in value))
    if key == "$not":
        return Not(parse(value))
    if key.startswith("$"):
        raise ValueError(f"unknown operator {key}")
    if not isinstance(value, dict):
        return eq(key, value)
    if not value:
        raise ValueError("a field needs an operator")
    parts = [_operator(key, op, v) for op, v in value.items()]
    return parts[0] if len(parts) == 1 else Junction("all", tuple(parts))


def _operator(key: str, op: str, value) -> Where:
    if op == "$eq":
        return eq(key, value)
    if op == "$ne":
        return ne(key, value)
    if op in _ORDERED:
        return Leaf(_ORDERED[op], key, (value,))
    if op in ("$in", "$nin", "$not_in"):
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"{op} takes a list")
        return in_(key, value) if op == "$in" else not_in(key, value)
    raise ValueError(f"unknown operator {op}")


def _build(where: Where, leaf: Callable[[Leaf], Column]) -> Column:
    if isinstance(where, Leaf):
        return F.coalesce(leaf(where), F.lit(False))
    if isinstance(where, Not):
        return ~_build(where.part, leaf)
    parts = [_build(p, leaf) for p in where.parts]
    return reduce(lambda a, b: a & b if where.op == "all" else a | b, parts)


def _compare(op: str, number: Column, value: float) -> Column:
    v = F.lit(float(value))
    made = {"gt": number > v, "gte": number >= v, "lt": number < v, "lte": number <= v}[op]
    return made & ~F.isnan(number)


def _equal_any(slot: Column, values: tuple) -> Column:
    good = [v for v in values if v == v]  # nothing equals NaN
    if not good:
        return F.lit(False)
    hit = slot.isin(*good) if len(good) > 1 else slot == F.lit(good[0])
    return hit & ~F.isnan(slot) if isinstance(good[0], float) else hit


def on_map(where: dict | Where, metadata: str = "metadata") -> Column:
    """Over a map of tagged values: the kind of each stored value counts."""
    slots = {STRING: "s", INTEGER: "i", FLOAT: "f", BOOLEAN: "b"}

    def leaf(x: Leaf) -> Column:
        at = F.try_element_at(F.col(metadata), F.lit(x.key))
        if x.op in ("in", "not_in"):
            kind = kind_of(x.values[0])
            same = F.coalesce((at["kind"] == F.lit(kind)) & _equal_any(at[slots[kind]], x.values), F.lit(False))
            return same if x.op == "in" else at.isNotNull() & ~same
        number = F.when(at["kind"] == INTEGER, at["i"].cast("double")).when(at["kind"] == FLOAT, at["f"])
        return _compare(x.op, number, x.values[0])

    return _build(parse(where), leaf)


def on_columns(where: dict | Where, types: dict[str, str]) -> Column:
    """Over typed columns (name to Spark type): kinds are known, so that filters reach the scan. NULL is a missing field;
    a field without a column is missing everywhere."""

    def kind_of_column(t: str) -> int | None:
        if t in ("tinyint", "smallint", "int", "bigint"):
            return INTEGER
        if t in ("float", "double"):
            return FLOAT
        return {"string": STRING, "boolean": BOOLEAN}.get(t)

    def leaf(x: Leaf) -> Column:
        kind = kind_of_column(types.get(x.key, ""))
        if kind is None:
            return F.lit(False)
        c = F.col(x.key)
        if x.op in ("in", "not_in"):
            same = _equal_any(c, x.values) if kind == kind_of(x.values[0]) else F.lit(False)
            return same if x.op == "in" else c.isNotNull() & ~F.coalesce(same, F.lit(False))
        if kind not in (INTEGER, FLOAT):
            return F.lit(False)
        return _compare(x.op, c.cast("double"), x.values[0])

    return _build(parse(where), leaf)
