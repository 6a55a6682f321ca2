"""Aggregation trees: read from JSON-like dicts, checked, and run as grouped frames.

A scope is a frame of documents with the bucket keys that lead to it as columns. All
range, filter, min and max siblings of a scope are one aggregation over it; each terms
sibling is one more, since it groups by its own values. Sub-aggregations run for all
buckets of their parent at once, grouped by the path of keys.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.errors import InvalidRequest, UnknownKind, ValidationError
from lodestone.functions.coercion import coerce
from lodestone.operators import leaves
from lodestone.plans import query as queries
from lodestone.plans.schema import FieldSpec, Schema

DEFAULT_SIZE = 10


@dataclass(frozen=True)
class Agg:
    subs: dict[str, Agg]


@dataclass(frozen=True)
class TermsAgg(Agg):
    field: str
    size: int


@dataclass(frozen=True)
class Bucket:
    key: str
    low: object
    high: object


@dataclass(frozen=True)
class RangeAgg(Agg):
    field: str
    ranges: tuple[Bucket, ...]


@dataclass(frozen=True)
class FilterAgg(Agg):
    query: queries.Query


@dataclass(frozen=True)
class ExtremeAgg(Agg):
    field: str
    least: bool


def parse(body: Mapping | None) -> dict[str, Agg]:
    if body is None:
        return {}
    if not isinstance(body, Mapping):
        raise InvalidRequest("aggregations are an object of named ones")
    return {name: _parse_one(one) for name, one in body.items()}


def _parse_one(body: object) -> Agg:
    if not isinstance(body, Mapping) or not isinstance(body.get("type"), str):
        raise InvalidRequest("an aggregation is an object with a type")
    kind, subs = body["type"], parse(body.get("aggs"))
    if kind == "terms":
        size = body.get("size", DEFAULT_SIZE)
        if not isinstance(size, int) or isinstance(size, bool) or size < 0:
            raise ValidationError({"size": "a number from 0 is needed"})
        return TermsAgg(subs, queries._field_name(body), size or DEFAULT_SIZE)
    if kind == "range":
        return RangeAgg(subs, queries._field_name(body), _parse_buckets(body.get("ranges")))
    if kind == "filter":
        if body.get("filter") is None:
            raise ValidationError({"filter": "a query is needed"})
        return FilterAgg(subs, queries.parse(body["filter"]))
    if kind in ("min", "max"):
        return ExtremeAgg(subs, queries._field_name(body), kind == "min")
    raise UnknownKind(f"no aggregation is of type {kind!r}")


def _parse_buckets(ranges: object) -> tuple[Bucket, ...]:
    if not isinstance(ranges, (list, tuple)) or not ranges:
        raise ValidationError({"ranges": "a list of ranges is needed"})
    found = []
    for i, one in enumerate(ranges):
        key, low, high = (one.get(k) for k in ("key", "from", "to"))
        if not isinstance(key, str) or not 1 <= len(key) <= 255:
            raise ValidationError({f"ranges.{i}.key": "a key of 1 to 255 characters is needed"})
        if low is None and high is None:
            raise ValidationError({f"ranges.{i}": "a bound is needed"})
        for bound in (low, high):
            if bound is not None and coerce("double", bound) is queries.NO_MATCH:
                raise ValidationError({f"ranges.{i}": "bounds are numbers"})
        found.append(Bucket(key, low, high))
    return tuple(found)


@dataclass(frozen=True)
class Scope:
    docs: DataFrame
    path: tuple[str, ...] = ()


@dataclass
class Frames:
    """The frames that one level of aggregations comes down to."""

    #: Of all range, filter, min and max siblings: path columns, then a column for each figure.
    figures: DataFrame | None = None
    #: Of each terms aggregation, by name: path columns, ``key``, ``doc_count``.
    buckets: dict[str, DataFrame] = field(default_factory=dict)
    below: dict[tuple, Frames] = field(default_factory=dict)


@dataclass
class Runner:
    schema: Schema
    docs: DataFrame
    #: Extremes are of the whole index, or of the matching documents of a scope ("query").
    extremes: str = "index"

    def frames(self, aggs: dict[str, Agg], scope: Scope) -> Frames:
        out = Frames()
        figures: dict[str, Column] = {}
        scope = self._with_extremes(aggs, scope)
        for at, (name, agg) in enumerate(aggs.items()):
            spec = None if isinstance(agg, FilterAgg) else self.schema.fields.get(agg.field)
            if isinstance(agg, TermsAgg) and spec is not None:
                self._terms(out, name, agg, spec, scope)
            elif isinstance(agg, RangeAgg) and spec is not None:
                tests = [self._bucket_test(spec, b) for b in agg.ranges]
                for i, test in enumerate(tests):
                    figures[f"f{at}_{i}"] = F.count_if(F.coalesce(test, F.lit(False)))
                if agg.subs:
                    hits = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
                    key = f"__path{len(scope.path)}"
                    below = Scope(scope.docs.withColumn(key, F.explode(hits)), (*scope.path, key))
                    out.below[name,] = self.frames(agg.subs, below)
            elif isinstance(agg, FilterAgg):
                test = queries.Compiler(self.schema).compile(agg.query).test
                figures[f"f{at}"] = F.count_if(F.coalesce(test, F.lit(False)))
                if agg.subs:
                    out.below[name,] = self.frames(agg.subs, Scope(scope.docs.where(test), scope.path))
            elif isinstance(agg, ExtremeAgg) and spec is not None:
                holds = self._holds(spec, F.col(_extreme(agg)))
                figures[f"f{at}"] = F.max(F.when(holds, F.col(_extreme(agg))))
                if agg.subs:
                    out.below[name,] = self.frames(agg.subs, Scope(scope.docs.where(holds), scope.path))
        if figures:
            out.figures = scope.docs.groupBy(*scope.path).agg(*[c.alias(n) for n, c in figures.items()])
        return out

    def _terms(self, out: Frames, name: str, agg: TermsAgg, spec: FieldSpec, scope: Scope) -> None:
        key = f"__path{len(scope.path)}"
        if spec.kind == "text" or spec.many:
            docs = scope.docs.withColumn(key, F.explode(leaves.values(spec)))
        else:
            docs = scope.docs.withColumn(key, F.col(f"`{spec.name}`")).where(F.col(key).isNotNull())
        counts = docs.groupBy(*scope.path, key).agg(F.count(F.lit(1)).alias("doc_count"))
        if scope.path:
            rank = F.row_number().over(Window.partitionBy(*scope.path).orderBy(F.desc("doc_count"), F.asc(key)))
            top = counts.withColumn("__rank", rank).where(F.col("__rank") <= agg.size).drop("__rank")
        else:
            top = counts.orderBy(F.desc("doc_count"), F.asc(key)).limit(agg.size)
        out.buckets[name] = top
        if agg.subs:
            path = (*scope.path, key)
            out.below[name,] = self.frames(agg.subs, Scope(docs.join(top.select(*path), list(path), "left_semi"), path))

    def _bucket_test(self, spec: FieldSpec, bucket: Bucket) -> Column:
        return leaves.Bounds.of(spec, bucket.low, bucket.high, True, True).test(spec)

    @staticmethod
    def _holds(spec: FieldSpec, extreme: Column) -> Column:
        if spec.kind == "text":
            return F.array_contains(leaves.tokens_column(spec.name), extreme)
        column = F.col(f"`{spec.name}`")
        return F.array_contains(column, extreme) if spec.many else column == extreme

    def _with_extremes(self, aggs: dict[str, Agg], scope: Scope) -> Scope:
        """The scope with the extremes that its min and max aggregations need, from one row."""
        found: dict[str, Column] = {}
        for agg in aggs.values():
            if isinstance(agg, ExtremeAgg) and (spec := self.schema.fields.get(agg.field)) is not None:
                name, ends = _extreme(agg), (F.array_min, F.min) if agg.least else (F.array_max, F.max)
                if name in scope.docs.columns and self.extremes == "index":
                    continue
                if spec.kind == "text":
                    found[name] = ends[1](ends[0](leaves.tokens_column(spec.name)))
                else:
                    column = F.col(f"`{spec.name}`")
                    found[name] = ends[1](ends[0](column) if spec.many else column)
        if not found:
            return scope
        docs = scope.docs.drop(*found)
        if self.extremes == "query" and scope.path:
            rows = docs.groupBy(*scope.path).agg(*[c.alias(n) for n, c in found.items()])
            return Scope(docs.join(rows, list(scope.path)), scope.path)
        rows = (docs if self.extremes == "query" else self.docs).agg(*[c.alias(n) for n, c in found.items()])
        return Scope(docs.crossJoin(F.broadcast(rows)), scope.path)  # one row

    def render(self, aggs: dict[str, Agg], frames: Frames) -> dict:
        """Nested results, from the collected frames: a row for each bucket."""
        return _Renderer(self.schema).level(aggs, _collected(frames), ())


def _extreme(agg: ExtremeAgg) -> str:
    return f"__{'min' if agg.least else 'max'}_{leaves.plain(agg.field)}"


@dataclass
class _Collected:
    figures: dict[tuple, Row]
    buckets: dict[str, dict[tuple, list[tuple]]]
    below: dict[tuple, _Collected]


def _collected(frames: Frames) -> _Collected:
    figures: dict[tuple, Row] = {}
    for row in frames.figures.collect() if frames.figures is not None else ():
        figures[tuple(row[c] for c in row.asDict() if c.startswith("__path"))] = row
    buckets: dict[str, dict[tuple, list[tuple]]] = {}
    for name, frame in frames.buckets.items():
        mine = buckets.setdefault(name, {})
        for row in frame.collect():
            *path, key, count = row
            mine.setdefault(tuple(path), []).append((key, count))
    return _Collected(figures, buckets, {k: _collected(v) for k, v in frames.below.items()})


@dataclass
class _Renderer:
    schema: Schema

    def level(self, aggs: dict[str, Agg], found: _Collected | None, path: tuple) -> dict:
        return {name: self._one(at, name, agg, found, path) for at, (name, agg) in enumerate(aggs.items())}

    def _one(self, at: int, name: str, agg: Agg, found: _Collected | None, path: tuple) -> dict:
        row = found.figures.get(path) if found else None
        below = found.below.get((name,)) if found else None
        subs = lambda key=None: {"aggs": self.level(agg.subs, below, path if key is None else (*path, key))} if agg.subs else {}
        if isinstance(agg, FilterAgg):
            return {"docCount": row[f"f{at}"] if row else 0, **subs()}
        spec = self.schema.fields.get(agg.field)
        if isinstance(agg, ExtremeAgg):
            return {"value": row[f"f{at}"] if row and spec else None, **subs()}
        if spec is None:
            return {"buckets": None}
        if isinstance(agg, TermsAgg):
            mine = (found.buckets.get(name, {}) if found else {}).get(path, [])
            mine = sorted(sorted(mine, key=lambda b: b[0]), key=lambda b: -b[1])
            return {"buckets": [{"key": key, "docCount": count, **subs(key)} for key, count in mine]}
        out = []
        for i, bucket in enumerate(agg.ranges):
            ends = leaves.Bounds.of(spec, bucket.low, bucket.high, True, True)
            out.append({"key": bucket.key, "docCount": row[f"f{at}_{i}"] if row else 0, "from": ends.low, "to": ends.high, **subs(i)})
        return {"buckets": out}


def range_rows(frame: DataFrame, agg: RangeAgg, spec: FieldSpec, at: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """A range aggregation's figures as rows: ``keys``, ``key``, ``doc_count``, one for each range."""
    cells = [F.struct(F.lit(b.key).alias("key"), F.col(f"f{at}_{i}").alias("doc_count")) for i, b in enumerate(agg.ranges)]
    return frame.select(*keys, F.inline(F.array(*cells)))

