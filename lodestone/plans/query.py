"""Query trees: read from JSON-like dicts, checked, and compiled to a predicate and a score."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import InvalidRequest, UnknownKind, ValidationError
from lodestone.functions import scoring
from lodestone.functions.coercion import NO_MATCH, coerce, scalar
from lodestone.operators import leaves
from lodestone.plans.schema import FieldSpec, Schema

ALL_FIELD = "_all"
MATCH_ALL = {"type": "bool"}


@dataclass(frozen=True)
class Term:
    field: str
    query: object


@dataclass(frozen=True)
class Terms:
    field: str
    query: tuple


@dataclass(frozen=True)
class Match:
    field: str
    query: object


@dataclass(frozen=True)
class Range:
    field: str
    low: object = None
    high: object = None
    with_low: bool = False
    with_high: bool = False


@dataclass(frozen=True)
class Bool:
    should: tuple = ()
    must: tuple = ()
    filter: tuple = ()


Query = Term | Terms | Match | Range | Bool


def _field_name(body: Mapping) -> str:
    name = body.get("field")
    if not isinstance(name, str) or not 1 <= len(name) <= 255:
        raise ValidationError({"field": "a name of 1 to 255 characters is needed"})
    return name


def _wanted(value: object) -> object:
    if value is None or not scalar(value):
        raise ValidationError({"query": "a value is needed"})
    return value


def _parse_range(body: Mapping) -> Range:
    name = _field_name(body)
    low, high = body.get("from"), body.get("to")
    if low is None and high is None:
        raise ValidationError({"from": "a bound is needed", "to": "a bound is needed"})
    for key, bound in (("from", low), ("to", high)):
        if bound is not None and coerce("double", bound) is NO_MATCH:
            raise ValidationError({key: "a number is needed"})
    return Range(name, low, high, bool(body.get("includeFrom")), bool(body.get("includeTo")))


def _parse_terms(body: Mapping) -> Terms:
    wanted = body.get("query")
    if not isinstance(wanted, (list, tuple)) or not wanted:
        raise ValidationError({"query": "a list of values is needed"})
    return Terms(_field_name(body), tuple(_wanted(v) for v in wanted))


def _parse_bool(body: Mapping) -> Bool:
    groups = []
    for group in ("should", "must", "filter"):
        clauses = body.get(group) or ()
        if not isinstance(clauses, (list, tuple)):
            raise InvalidRequest(f"{group} takes a list of queries")
        groups.append(tuple(parse(c) for c in clauses))
    return Bool(*groups)  # "parallel" may be given: Spark decides what runs side by side


PARSERS: dict[str, Callable[[Mapping], Query]] = {
    "term": lambda b: Term(_field_name(b), _wanted(b.get("query"))),
    "terms": _parse_terms,
    "match": lambda b: Match(_field_name(b), _wanted(b.get("query"))),
    "range": _parse_range,
    "bool": _parse_bool,
}


def parse(body: object) -> Query:
    if not isinstance(body, Mapping):
        raise InvalidRequest("a query is an object")
    kind = body.get("type")
    if not isinstance(kind, str) or kind not in PARSERS:
        raise UnknownKind(f"no query is of type {kind!r}")
    return PARSERS[kind](body)


@dataclass
class Statistics:
    """What scores refer to: figures of the corpus (columns of a one-row frame) and, for each document, counts that are taken once."""

    wanted: dict[str, Column] = field(default_factory=dict)
    per_document: dict[str, Column] = field(default_factory=dict)
    #: Field and token: number of its columns ``__tf_``, its count in a document, and ``__df_``, the documents that hold it.
    tokens: dict[tuple[str, str], int] = field(default_factory=dict)

    def of(self, name: str, token: str) -> dict[str, Column]:
        """The arguments of ``scoring.bm25`` for a token of a field, as references."""
        tokens, known = F.col(leaves.tokens_column(name)), leaves.plain(name)
        n_docs, average, length = f"__n_{known}", f"__len_{known}", f"__dl_{known}"
        self.wanted.setdefault(n_docs, F.count_if(F.size(tokens) > 0))
        self.wanted.setdefault(average, F.avg(F.when(F.size(tokens) > 0, F.size(tokens))))
        self.per_document.setdefault(length, F.size(tokens))
        if (name, token) not in self.tokens:
            at = self.tokens[name, token] = len(self.tokens)
            self.wanted[f"__df_{at}"] = F.count_if(F.array_contains(tokens, token))
            self.per_document[f"__tf_{at}"] = scoring.term_count(tokens, token)
        at = self.tokens[name, token]
        return {"count": F.col(f"__tf_{at}"), "length": F.col(length), "n_docs": F.col(n_docs), "n_with": F.col(f"__df_{at}"), "average": F.col(average)}


@dataclass(frozen=True)
class Compiled:
    test: Column
    score: Column


@dataclass
class Compiler:
    """Compiles a tree against a schema. Field names that don't exist match nothing.

    ``inverted``: texts are tested by the counts of their tokens, which an inverted index brings.
    """

    schema: Schema
    score_filters: bool = True
    boost: float = 1.0
    k1: float = scoring.K1
    b: float = scoring.B
    inverted: bool = False
    statistics: Statistics = field(default_factory=Statistics)

    def compile(self, query: Query) -> Compiled:
        found = self._visit(query)
        return Compiled(found.test, found.score * self.boost if self.boost != 1.0 else found.score)

    def _visit(self, query: Query) -> Compiled:
        if isinstance(query, Bool):
            return self._bool(query)
        if query.field == ALL_FIELD:
            return Compiled(leaves.nothing(), F.lit(0.0)) if isinstance(query, Range) else Compiled(leaves.everything(), F.lit(1.0))
        spec = self.schema.fields.get(query.field)
        if spec is None:
            return Compiled(leaves.nothing(), F.lit(0.0))
        if isinstance(query, Range):
            return self._flat(leaves.Bounds.of(spec, query.low, query.high, query.with_low, query.with_high).test(spec))
        if isinstance(query, Terms):
            return self._terms(spec, query.query)
        if spec.kind == "text":
            text = coerce("text", query.query)
            tokens = [text] if isinstance(query, Term) else self.schema.analyzer_of(spec.name).tokens(text)
            return Compiled(self._any_token(spec, tokens), self._relevance(spec, tokens))
        return self._flat(leaves.equals(spec, query.query))

    @staticmethod
    def _flat(test: Column) -> Compiled:
        return Compiled(test, F.lit(1.0))

    def _terms(self, spec: FieldSpec, wanted: tuple) -> Compiled:
        if spec.kind == "text":
            tokens = [coerce("text", v) for v in wanted]
            return Compiled(self._any_token(spec, tokens), self._relevance(spec, tokens))
        found = [v for v in (coerce(spec.kind, v) for v in wanted) if v is not NO_MATCH]
        if not found:
            return Compiled(leaves.nothing(), F.lit(0.0))
        tests = [leaves.equals(spec, v) for v in found]
        test = reduce(lambda a, b: a | b, tests) if spec.many else F.col(f"`{spec.name}`").isin([leaves.literal(spec, v) for v in dict.fromkeys(found)])
        return Compiled(test, reduce(lambda a, b: a + b, [F.when(t, 1.0).otherwise(0.0) for t in tests]))

    def _any_token(self, spec: FieldSpec, tokens: list[str]) -> Column:
        if not self.inverted or not tokens:
            return leaves.any_token(spec, tokens)
        return reduce(lambda a, b: a | b, [F.coalesce(self.statistics.of(spec.name, t)["count"], F.lit(0)) > 0 for t in dict.fromkeys(tokens)])

    def _relevance(self, spec: FieldSpec, tokens: list[str]) -> Column:
        """The sum of BM25 over the tokens, repeats counted."""
        parts = [scoring.bm25(**self.statistics.of(spec.name, token), k1=self.k1, b=self.b) for token in tokens]
        return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)

    def _bool(self, query: Bool) -> Compiled:
        groups = [[self._visit(c) for c in group] for group in (query.should, query.must, query.filter)]
        if not any(groups):
            return Compiled(leaves.everything(), F.lit(1.0))
        joins = (lambda a, b: a | b, lambda a, b: a & b, lambda a, b: a & b)
        test = reduce(lambda a, b: a & b, [reduce(j, [c.test for c in g]) for j, g in zip(joins, groups) if g])
        scored = [*groups[0], *groups[1], *(groups[2] if self.score_filters else [])]
        scores = [F.when(c.test, c.score).otherwise(0.0) for c in scored]
        return Compiled(test, reduce(lambda a, b: a + b, scores) if scores else F.lit(0.0))
