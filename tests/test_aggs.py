"""Aggregation trees over small frames."""

import pytest

from lodestone.errors import InvalidRequest, UnknownKind, ValidationError
from lodestone.index import Index
from lodestone.plans import aggs

TERMS = {"type": "terms", "field": "k"}


@pytest.fixture(scope="module")
def index(spark):
    spec = {
        "analyzers": {"ws": {"analyzers": [{"type": "whitespace"}]}},
        "fields": {"k": {"type": "keyword", "many": True}, "k2": {"type": "keyword", "many": True}, "n": {"type": "integer", "many": True}, "t": {"type": "text", "analyzer": "ws"}, "s": {"type": "long"}},
    }
    rows = [
        (1, ["foo"], ["qwerty"], [1, 2, 3], "a b a", 4),
        (2, ["foo", "bar"], ["asdfgh"], [1, 2, 4], "b", 4),
        (3, [], ["asdfgh"], [3, 4], "", None),
        (4, None, None, None, None, 9),
    ]
    return Index.over("t", spec, spark.createDataFrame(rows, "id long, k array<string>, k2 array<string>, n array<int>, t string, s long"), "id")


def run(index, body, query=None, **options):
    return index.answer({"aggs": {"a": body}, **({"query": query} if query else {})}, **options)["aggs"]["a"]


def shape(found):
    return [(b["key"], b["docCount"]) for b in found["buckets"]]


def test_terms(index):
    assert shape(run(index, TERMS)) == [("foo", 2), ("bar", 1)]
    assert shape(run(index, {**TERMS, "size": 1})) == [("foo", 2)]
    assert shape(run(index, {**TERMS, "size": 0})) == [("foo", 2), ("bar", 1)]
    assert shape(run(index, {"type": "terms", "field": "t"})) == [("b", 2), ("a", 1)]
    assert shape(run(index, {"type": "terms", "field": "n"})) == [(1, 2), (2, 2), (3, 2), (4, 2)]
    assert shape(run(index, {"type": "terms", "field": "s"})) == [(4, 2), (9, 1)]
    assert run(index, {"type": "terms", "field": "nope"}) == {"buckets": None}


def test_terms_in_terms(index):
    found = run(index, {**TERMS, "aggs": {"b": {"type": "terms", "field": "k2"}}})
    assert [(b["key"], shape(b["aggs"]["b"])) for b in found["buckets"]] == [("foo", [("asdfgh", 1), ("qwerty", 1)]), ("bar", [("asdfgh", 1)])]


RANGES = [{"key": "one", "from": 1}, {"key": "two", "from": 1, "to": 2}, {"key": "three", "from": 2, "to": 3}, {"key": "four", "to": 4}, {"key": "zero", "from": 50}]


def test_range(index):
    found = run(index, {"type": "range", "field": "n", "ranges": RANGES})["buckets"]
    assert [(b["key"], b["docCount"], b["from"], b["to"]) for b in found] == [("one", 3, 1, None), ("two", 2, 1, 2), ("three", 3, 2, 3), ("four", 3, None, 4), ("zero", 0, 50, None)]
    assert [(b["docCount"], b["from"]) for b in run(index, {"type": "range", "field": "k", "ranges": RANGES[:1]})["buckets"]] == [(0, None)]
    assert run(index, {"type": "range", "field": "nope", "ranges": RANGES}) == {"buckets": None}


def test_terms_in_overlapping_ranges(index):
    found = run(index, {"type": "range", "field": "n", "ranges": RANGES, "aggs": {"b": {"type": "terms", "field": "n"}}})["buckets"]
    assert shape(found[1]["aggs"]["b"]) == [(1, 2), (2, 2), (3, 1), (4, 1)]
    assert shape(found[4]["aggs"]["b"]) == []


def test_filter(index):
    body = {"type": "filter", "filter": {"type": "terms", "field": "k", "query": ["foo"]}, "aggs": {"b": TERMS}}
    found = run(index, body)
    assert found["docCount"] == 2 and shape(found["aggs"]["b"]) == [("foo", 2), ("bar", 1)]
    assert run(index, body, {"type": "term", "field": "k", "query": "bar"})["docCount"] == 1
    assert run(index, body, {"type": "term", "field": "k", "query": "zzz"})["docCount"] == 0


def test_extremes(index):
    at = lambda which, field, query=None, **o: run(index, {"type": which, "field": field}, query, **o)["value"]
    assert (at("min", "n"), at("max", "n"), at("min", "t"), at("max", "t"), at("min", "k")) == (1, 4, "a", "b", "bar")
    third = {"type": "term", "field": "n", "query": 3}
    assert at("max", "s", third) is None  # the index's greatest value lies outside
    assert at("max", "s", third, extremes="query") == 4
    assert at("min", "nope") is None
    found = run(index, {"type": "max", "field": "n", "aggs": {"b": {"type": "terms", "field": "k2"}}})
    assert found["value"] == 4 and shape(found["aggs"]["b"]) == [("asdfgh", 2)]


def test_deep_nesting(index):
    deep = {"type": "filter", "filter": {"type": "bool"}, "aggs": {"m": {"type": "min", "field": "n", "aggs": {"r": {"type": "range", "field": "s", "ranges": [{"key": "x", "to": 5}]}}}}}
    found = run(index, {**TERMS, "aggs": {"f": deep}})
    assert [b["aggs"]["f"]["aggs"]["m"]["aggs"]["r"]["buckets"][0]["docCount"] for b in found["buckets"]] == [2, 1]


def test_siblings_share_one_aggregation(index):
    frames = index.aggregations({"a": {"type": "range", "field": "n", "ranges": RANGES}, "b": {"type": "filter", "filter": {"type": "bool"}}, "c": {"type": "min", "field": "n"}})
    assert len(frames.figures.columns) == len(RANGES) + 2 and not frames.buckets


@pytest.mark.parametrize(
    ("body", "error"),
    [
        ([], InvalidRequest),
        ({"a": 1}, InvalidRequest),
        ({"a": {}}, InvalidRequest),
        ({"a": {"type": 1}}, InvalidRequest),
        ({"a": {"type": "avg", "field": "n"}}, UnknownKind),
        ({"a": {"type": "terms"}}, ValidationError),
        ({"a": {"type": "terms", "field": "n", "size": -1}}, ValidationError),
        ({"a": {"type": "range", "field": "n"}}, ValidationError),
        ({"a": {"type": "range", "field": "n", "ranges": [{"key": "", "from": 1}]}}, ValidationError),
        ({"a": {"type": "range", "field": "n", "ranges": [{"key": "x"}]}}, ValidationError),
        ({"a": {"type": "range", "field": "n", "ranges": [{"key": "x", "from": "y"}]}}, ValidationError),
        ({"a": {"type": "filter"}}, ValidationError),
        ({"a": {"type": "min"}}, ValidationError),
        ({"a": {"type": "terms", "field": "n", "aggs": {"b": {"type": "?"}}}}, UnknownKind),
    ],
)
def test_refused(body, error):
    with pytest.raises(error):
        aggs.parse(body)


def test_nothing_asked():
    assert aggs.parse(None) == {} and aggs.parse({}) == {}
