"""Query trees over small frames: what matches, what scores, what is refused."""

import pytest

from lodestone.errors import InvalidRequest, UnknownKind, ValidationError
from lodestone.functions.coercion import SPARK
from lodestone.index import Index
from lodestone.plans import query as q

WS = {"ws": {"analyzers": [{"type": "whitespace"}]}}


def make(spark, kinds, rows, many=()):
    spec = {"analyzers": WS, "fields": {k: {"type": v, "many": k in many, **({"analyzer": "ws"} if v == "text" else {})} for k, v in kinds.items()}}
    ddl = ", ".join(["id long", *[f"{k} {f'array<{SPARK[v].simpleString()}>' if k in many else SPARK[v].simpleString()}" for k, v in kinds.items()]])
    return Index.over("t", spec, spark.createDataFrame(rows, ddl), "id")


def ids(found):
    return sorted(r[0] for r in found.collect())


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, "value", "foo bar", True, 1), (2, "other", "bar bar baz", False, 2), (3, None, "", None, 3), (4, "value", None, True, None), (5, "x", "foo", False, 5)]
    return make(spark, {"k": "keyword", "t": "text", "b": "bool", "n": "integer"}, rows)


def term(field, query):
    return {"type": "term", "field": field, "query": query}


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        (None, [1, 2, 3, 4, 5]),
        ({"type": "bool"}, [1, 2, 3, 4, 5]),
        (term("_all", 7), [1, 2, 3, 4, 5]),
        (term("k", "value"), [1, 4]),
        (term("k", "value1"), []),
        (term("missing", "value"), []),
        ({"type": "terms", "field": "k", "query": ["value", "x"]}, [1, 4, 5]),
        ({"type": "terms", "field": "t", "query": ["baz", "foo"]}, [1, 2, 5]),
        ({"type": "match", "field": "k", "query": "value"}, [1, 4]),
        ({"type": "match", "field": "t", "query": "baz"}, [2]),
        ({"type": "match", "field": "t", "query": "bar baz"}, [1, 2]),
        ({"type": "match", "field": "t", "query": "  "}, []),
        (term("t", "foo bar"), []),
        (term("b", True), [1, 4]),
        (term("b", "false"), [2, 5]),
        (term("b", "maybe"), []),
        (term("n", "2"), [2]),
        (term("n", 2.5), []),
        ({"type": "range", "field": "n", "from": 1, "to": 3}, [2]),
        ({"type": "range", "field": "n", "from": 1, "to": 3, "includeFrom": True}, [1, 2]),
        ({"type": "range", "field": "n", "from": 1, "to": 3, "includeTo": True}, [2, 3]),
        ({"type": "range", "field": "n", "from": 0}, [1, 2, 3, 5]),
        ({"type": "range", "field": "n", "from": 1.5}, []),
        ({"type": "range", "field": "k", "from": 1}, []),
        ({"type": "range", "field": "_all", "from": 1}, []),
        ({"type": "bool", "should": [term("b", True), term("b", False)]}, [1, 2, 4, 5]),
        ({"type": "bool", "must": [term("b", True), term("b", False)]}, []),
        ({"type": "bool", "must": [term("b", True)], "should": [term("n", 1), term("n", 2)]}, [1]),
        ({"type": "bool", "filter": [term("b", True)], "parallel": True}, [1, 4]),
        ({"type": "bool", "must": [term("nope", 1), term("b", True)]}, []),
        ({"type": "bool", "must": [{"type": "bool", "should": [term("n", 1), term("n", 5)]}, term("t", "foo")]}, [1, 5]),
    ],
)
def test_matches(mixed, query, expected):
    assert ids(mixed.hits(query)) == expected


def test_scores(mixed):
    score = lambda query, **o: {r[0]: r[1] for r in mixed.hits(query, **o).collect()}
    both = score({"type": "match", "field": "t", "query": "foo bar"})
    assert set(both) == {1, 2, 5} and all(v > 0 for v in both.values())
    assert score({"type": "match", "field": "t", "query": "foo foo"})[1] == pytest.approx(2 * score(term("t", "foo"))[1])
    body = {"type": "bool", "must": [term("b", True)], "filter": [term("k", "value")]}
    assert score(body) == {1: 2.0, 4: 2.0}
    assert score(body, score_filters=False) == {1: 1.0, 4: 1.0}
    assert score(term("k", "value"), boost=3.0) == {1: 3.0, 4: 3.0}
    assert score({"type": "bool", "should": [term("n", 1), term("n", 2)]}) == {1: 1.0, 2: 1.0}
    assert score({"type": "terms", "field": "n", "query": [1, 1, 2]}) == {1: 2.0, 2: 1.0}


def test_golden_relevance(spark):
    index = make(spark, {"t": "text"}, [(1, "foo bar"), (2, "foo baz")])
    get = lambda token, **o: {r[0]: r[1] for r in index.hits(term("t", token), **o).collect()}
    assert get("foo", k1=2.0) == pytest.approx({1: 0.6, 2: 0.6})
    assert get("bar", k1=2.0) == pytest.approx({1: 1.0158883083359673})
    assert get("bar") == pytest.approx({1: 1.095565822715259})


@pytest.mark.parametrize("kind", ["byte", "short", "integer", "long", "unsigned_long", "float", "double"])
@pytest.mark.parametrize("many", [False, True])
def test_numeric_ranges(spark, kind, many):
    from decimal import Decimal

    as_kind = {"unsigned_long": Decimal, "float": float, "double": float}.get(kind, int)
    rows = [(i, [as_kind(i)] if many else as_kind(i)) for i in range(1, 7)]
    index = make(spark, {"n": kind}, rows, ("n",) if many else ())
    get = lambda **b: ids(index.hits({"type": "range", "field": "n", **b}))
    assert get(**{"from": 1}) == [2, 3, 4, 5, 6]
    assert get(**{"from": 1, "includeFrom": True}) == [1, 2, 3, 4, 5, 6]
    assert get(to=3) == [1, 2] and get(to=3, includeTo=True) == [1, 2, 3]
    assert get(**{"from": 1, "to": 4, "includeTo": True}) == [2, 3, 4]
    assert get(**{"from": 100, "to": 120}) == []


def test_many_valued_fields(spark):
    index = make(spark, {"k": "keyword", "n": "integer"}, [(1, ["a", "b"], [1, 9]), (2, ["b"], None), (3, None, [5])], ("k", "n"))
    assert ids(index.hits(term("k", "b"))) == [1, 2]
    assert ids(index.hits({"type": "range", "field": "n", "from": 4, "to": 6})) == [3]
    assert ids(index.hits({"type": "terms", "field": "n", "query": [9, 5]})) == [1, 3]


def test_big_unsigned(spark):
    from decimal import Decimal

    index = make(spark, {"n": "unsigned_long"}, [(1, Decimal(18446744073709551615)), (2, Decimal(0))])
    assert ids(index.hits(term("n", 18446744073709551615))) == [1]
    assert ids(index.hits(term("n", -1))) == []


@pytest.mark.parametrize(
    ("body", "error"),
    [
        ({}, UnknownKind),
        ({"type": "fuzzy"}, UnknownKind),
        ([], InvalidRequest),
        ({"type": "term", "field": "f"}, ValidationError),
        ({"type": "term", "field": "", "query": 1}, ValidationError),
        ({"type": "term", "field": "f" * 256, "query": 1}, ValidationError),
        ({"type": "term", "field": "f", "query": {"a": 1}}, ValidationError),
        ({"type": "terms", "field": "f", "query": []}, ValidationError),
        ({"type": "terms", "field": "f", "query": [None]}, ValidationError),
        ({"type": "match", "field": "f"}, ValidationError),
        ({"type": "range", "field": "f"}, ValidationError),
        ({"type": "range", "field": "f", "from": "a"}, ValidationError),
        ({"type": "bool", "must": [{"type": "?"}]}, UnknownKind),
        ({"type": "bool", "must": {}}, None),
    ],
)
def test_refused(body, error):
    if error is None:
        assert q.parse(body) == q.Bool()
        return
    with pytest.raises(error):
        q.parse(body)


def test_scalar_filters_reach_the_scan(spark):
    index = Index.over("e", {"fields": {"event_type": {"type": "keyword"}, "value": {"type": "double"}}}, spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_id")
    hits = index.hits({"type": "bool", "must": [term("event_type", "click"), {"type": "range", "field": "value", "from": 5}]})
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThan(value,5.0)" in plan and "Python" not in plan
