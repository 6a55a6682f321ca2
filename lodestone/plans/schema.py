"""Declared, closed schemas: fields, their types and analyzers, and the checks on schemas and documents."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import LodestoneError, ValidationError
from lodestone.functions.analyzers import Analyzer
from lodestone.functions.coercion import FLOATS, INTEGERS, SPARK

NESTED = ("slice", "map")
NAME = re.compile("[A-z0-9]+")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str
    required: bool = False
    analyzer: str | None = None
    #: Values are arrays; scalar fields stay scalar so that their filters reach the scan.
    many: bool = False

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(SPARK[self.kind]) if self.many else SPARK[self.kind]


@dataclass(frozen=True)
class Schema:
    fields: dict[str, FieldSpec]
    analyzers: dict[str, Analyzer] = field(default_factory=dict)
    source: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, spec: Mapping) -> Schema:
        """Reads and checks ``{"analyzers": {name: {"analyzers": [...]}}, "fields": {name: {...}}}``; all problems are reported together."""
        problems: dict[str, str] = {}
        chains: dict[str, Analyzer] = {}
        for name, chain in (spec.get("analyzers") or {}).items():
            try:
                chains[name] = Analyzer.build((chain or {}).get("analyzers") or [])
            except LodestoneError as error:
                problems[f"analyzers.{name}"] = str(error)
        declared = spec.get("fields") or {}
        if not declared:
            problems["fields"] = "at least one field is needed"
        fields = {}
        for name, body in declared.items():
            where = f"fields.{name}"
            if not name or not NAME.findall(name):
                problems[where] = "the name needs a letter or digit"
                continue
            body = body or {}
            kind = body.get("type")
            if kind in NESTED:
                problems[where] = f"{kind} fields can be declared nowhere: they have no index"
            elif kind not in SPARK:
                problems[where] = f"{kind!r} is no field type"
            elif body.get("children"):
                problems[where] = f"a {kind} field has no children"
            elif kind == "text" and not body.get("analyzer"):
                problems[where] = "a text field needs an analyzer"
            elif body.get("analyzer") and body["analyzer"] not in (spec.get("analyzers") or {}):
                problems[where] = f"no analyzer is called {body['analyzer']!r}"
            else:
                fields[name] = FieldSpec(name, kind, bool(body.get("required")), body.get("analyzer"), bool(body.get("many")))
        if problems:
            raise ValidationError(problems)
        return cls(fields, chains, {"analyzers": dict(spec.get("analyzers") or {}), "fields": dict(declared)})

    def analyzer_of(self, name: str) -> Analyzer:
        return self.analyzers[self.fields[name].analyzer]

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, not f.required, {"kind": f.kind, "analyzer": f.analyzer or ""}) for f in self.fields.values()])


def _problem(spec: FieldSpec, value: object) -> str | None:
    if spec.kind == "bool":
        return None if isinstance(value, bool) else "a boolean is needed"
    if spec.kind in ("keyword", "text"):
        return None if isinstance(value, str) else "a string is needed"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return "a number is needed"
    if spec.kind in INTEGERS:
        low, high = INTEGERS[spec.kind]
        if not isinstance(value, int):
            return "a whole number is needed"
        return None if low <= value <= high else f"out of range for {spec.kind}"
    return None if abs(value) <= FLOATS[spec.kind] else f"out of range for {spec.kind}"


def validate_document(schema: Schema, document: Mapping) -> None:
    """Required fields are present and not null, values have their field's type and range, and no field is unknown."""
    problems = {k: "no such field" for k in document if k not in schema.fields}
    for name, spec in schema.fields.items():
        value = document.get(name)
        if value is None:
            if spec.required:
                problems[name] = "required"
            continue
        for one in value if spec.many and isinstance(value, list) else [value]:
            if found := _problem(spec, one):
                problems[name] = found
    if problems:
        raise ValidationError(problems)


def conform(schema: Schema, df: DataFrame, name: str = "problems") -> DataFrame:
    """All of ``df`` cast to the schema's types, with an array column of what is wrong with each row.

    Values that don't fit become null and are named; so are missing required ones. Columns
    beyond the schema are kept as they are. Bulk loads filter on the array being empty.
    """
    found: list[Column] = []
    out: dict[str, Column] = {}
    for spec in schema.fields.values():
        if spec.name not in df.columns:
            if spec.required:
                found.append(F.lit(f"{spec.name}: required"))
            out[spec.name] = F.lit(None).cast(spec.spark_type)
            continue
        raw = F.col(f"`{spec.name}`")
        kind = df.schema[spec.name].dataType
        whole = isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) and spec.kind in INTEGERS
        cast = raw.try_cast(spec.spark_type)
        if spec.kind == "unsigned_long" and not spec.many:
            cast = F.when((cast >= 0) & (cast <= F.lit("18446744073709551615").cast("decimal(20,0)")), cast)
        if whole and not spec.many:
            cast = F.when(raw == F.floor(raw), cast)
        out[spec.name] = cast
        found.append(F.when(raw.isNotNull() & cast.isNull(), F.lit(f"{spec.name}: no {spec.kind}")))
        if spec.required:
            found.append(F.when(raw.isNull(), F.lit(f"{spec.name}: required")))
    problems = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in schema.fields]
    return df.select(*rest, *[c.alias(n) for n, c in out.items()], problems.alias(name))
