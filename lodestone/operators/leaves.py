"""Predicates on one field: equality, analyzed match and ranges, over scalar and array columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.coercion import NO_MATCH, NUMERIC, coerce
from lodestone.plans.schema import FieldSpec


def nothing() -> Column:
    return F.lit(False)


def everything() -> Column:
    return F.lit(True)


def plain(name: str) -> str:
    """A field's name as part of a column's that needs no quotes; no two fields share one."""
    return re.sub(r"\W|_", lambda m: f"_{ord(m[0]):x}_" if m[0] != "_" else "__", name)


def tokens_column(name: str) -> str:
    """The column that holds the tokens of a text field."""
    return f"__tok_{plain(name)}"


def literal(spec: FieldSpec, value: object) -> Column:
    from lodestone.functions.coercion import SPARK

    return F.lit(value).cast(SPARK[spec.kind])


def values(spec: FieldSpec) -> Column:
    """All values of a field as an array without nulls or repeats."""
    if spec.kind == "text":
        return F.array_distinct(F.col(tokens_column(spec.name)))
    column = F.col(f"`{spec.name}`")
    return F.array_distinct(F.array_compact(column)) if spec.many else F.when(column.isNull(), F.array().cast(f"array<{spec.spark_type.simpleString()}>")).otherwise(F.array(column))


def equals(spec: FieldSpec, value: object) -> Column:
    """Whether a field holds a value exactly; a text field, whether it holds the token."""
    found = coerce(spec.kind, value)
    if found is NO_MATCH:
        return nothing()
    if spec.kind == "text":
        return F.array_contains(tokens_column(spec.name), found)
    column = F.col(f"`{spec.name}`")
    test = F.array_contains(column, literal(spec, found)) if spec.many else column == literal(spec, found)
    return F.coalesce(test, nothing()) if spec.many else test


def any_token(spec: FieldSpec, tokens: list[str]) -> Column:
    """Whether a text field holds any of the tokens."""
    distinct = list(dict.fromkeys(tokens))
    if not distinct:
        return nothing()
    held = tokens_column(spec.name)
    test = F.array_contains(held, distinct[0]) if len(distinct) == 1 else F.arrays_overlap(held, F.array(*[F.lit(t) for t in distinct]))
    if spec.many:
        return test
    # Analyzers only split, so a token lies in its text: the scan drops texts without any before they are tokenized.
    return reduce(lambda a, b: a | b, [F.contains(F.col(f"`{spec.name}`"), F.lit(t)) for t in distinct]) & test


@dataclass(frozen=True)
class Bounds:
    """Bounds of a range on a field, coerced; ``empty`` if the range can hold nothing."""

    low: object = None
    high: object = None
    with_low: bool = False
    with_high: bool = False
    empty: bool = False

    @classmethod
    def of(cls, spec: FieldSpec, low: object, high: object, with_low: bool, with_high: bool) -> Bounds:
        if spec.kind not in NUMERIC or (low is None and high is None):
            return cls(empty=True)
        ends = [None if x is None else coerce(spec.kind, x) for x in (low, high)]
        if NO_MATCH in ends:
            return cls(empty=True)
        return cls(*ends, with_low, with_high)

    def test(self, spec: FieldSpec) -> Column:
        if self.empty:
            return nothing()

        def within(x: Column) -> Column:
            parts = []
            if self.low is not None:
                parts.append(x >= literal(spec, self.low) if self.with_low else x > literal(spec, self.low))
            if self.high is not None:
                parts.append(x <= literal(spec, self.high) if self.with_high else x < literal(spec, self.high))
            return reduce(lambda a, b: a & b, parts)

        column = F.col(f"`{spec.name}`")
        return F.coalesce(F.exists(column, within), nothing()) if spec.many else within(column)
