"""Analyzers, coercion, schemas, documents, catalog, store and streaming."""

import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.errors import DocumentNotFound, IndexAlreadyExists, IndexNotFound, LodestoneError, NotFound, UnknownKind, ValidationError
from lodestone.functions.analyzers import Analyzer, step
from lodestone.functions.coercion import NO_MATCH, coerce
from lodestone.functions.scoring import bm25_value
from lodestone.index import Index
from lodestone.operators import documents
from lodestone.plans.schema import Schema, conform, validate_document
from lodestone.sources.catalog import Engine
from lodestone.sources.store import JsonStore
from lodestone.streaming.ingest import ingest

CHAINS = [
    [{"type": "nop"}],
    [{"type": "dedup"}],
    [{"type": "whitespace"}],
    [{"type": "regexp", "settings": {"pattern": r"\s"}}],
    [{"type": "regexp", "settings": {"pattern": r"[\s,]+"}}],
    [{"type": "regexp", "settings": {"pattern": r"(,|\s)(o)?"}}],
    [{"type": "regexp", "settings": {"pattern": r"\b"}}],
    [{"type": "regexp", "settings": {"pattern": r"\W"}}],
    [{"type": "regexp", "settings": {"pattern": "o*"}}],
    [{"type": "whitespace"}, {"type": "dedup"}],
    [{"type": "dedup"}, {"type": "whitespace"}, {"type": "regexp", "settings": {"pattern": "o"}}],
]


def test_steps():
    assert step("nop").on_list(["qwerty", "asdfgh"]) == ["qwerty", "asdfgh"]
    assert step("dedup").on_list(["hello world", "hello", "hello world"]) == ["hello world", "hello"]
    for one in (step("whitespace"), step("regexp", {"pattern": r"\s"})):
        assert one.on_list(["hello world", "hello  world "]) == ["hello", "world", "hello", "world"]
    assert Analyzer.build([{"type": "whitespace"}, {"type": "dedup"}]).on_list(["hello world", "hello", "world"]) == ["hello", "world"]


@pytest.mark.parametrize("settings_", [None, {}, {"pattern": 1}, {"pattern": "("}, {"pattern": "a", "more": 1}])
def test_bad_patterns(settings_):
    with pytest.raises(ValidationError):
        step("regexp", settings_)


def test_bad_chains():
    with pytest.raises(ValidationError):
        Analyzer.build([])
    with pytest.raises(UnknownKind):
        Analyzer.build([{"type": "stemmer"}])


TEXTS = ["", " ", "hello  world ", "a b c　d", "x\x0by\x0cz\r\n", "foo,bar  foo o", "\x1c\x1d", "​ zero", "é É"]


@pytest.mark.parametrize("chain", CHAINS)
def test_lists_and_columns_agree(spark, chain):
    analyzer = Analyzer.build(chain)
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", analyzer.column(F.col("t")).alias("tok")).collect()
    assert {r.t: r.tok for r in rows} == {t: analyzer.tokens(t) for t in TEXTS}
    assert spark.createDataFrame([(None,)], "t string").select(analyzer.column(F.col("t"))).first()[0] == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab \t ,", max_size=12), max_size=5))
def test_dedup_keeps_first_occurrences(tokens):
    found = step("dedup").on_list(tokens)
    assert len(found) == len(set(found)) and sorted(found, key=tokens.index) == found


@pytest.mark.parametrize(
    ("kind", "value", "expected"),
    [
        ("keyword", True, "true"),
        ("keyword", 1.0, "1"),
        ("text", 2, "2"),
        ("bool", "true", True),
        ("bool", "yes", NO_MATCH),
        ("bool", 0, False),
        ("byte", 127, 127),
        ("byte", 128, NO_MATCH),
        ("short", -32769, NO_MATCH),
        ("integer", "12", 12),
        ("integer", 1.5, NO_MATCH),
        ("integer", "a", NO_MATCH),
        ("long", 10**19, NO_MATCH),
        ("unsigned_long", 2**64 - 1, Decimal(2**64 - 1)),
        ("unsigned_long", -1, NO_MATCH),
        ("float", 3.5e38, NO_MATCH),
        ("double", "1e3", 1000.0),
        ("double", float("nan"), NO_MATCH),
        ("double", None, NO_MATCH),
        ("keyword", [1], NO_MATCH),
    ],
)
def test_coercion(kind, value, expected):
    assert coerce(kind, value) == expected


def test_relevance_of_nothing():
    assert bm25_value(0, 2, 2, 2, 2.0) == 0.0 and bm25_value(1, 2, 2, 2, 2.0, 2.0, 0.75) == pytest.approx(0.6)


GOOD = {"analyzers": {"a": {"analyzers": [{"type": "regexp", "settings": {"pattern": r"\s"}}]}}, "fields": {"name": {"type": "bool"}, "name2": {"type": "text", "analyzer": "a"}}}


@pytest.mark.parametrize(
    "spec",
    [
        {},
        {"fields": {}},
        {"fields": {"": {"type": "bool"}}},
        {"fields": {"-": {"type": "bool"}}},
        {"fields": {"f": {}}},
        {"fields": {"f": {"type": "date"}}},
        {"fields": {"f": {"type": "slice", "children": {"x": {"type": "bool"}}}}},
        {"fields": {"f": {"type": "map"}}},
        {"fields": {"f": {"type": "bool", "children": {"x": {"type": "bool"}}}}},
        {"fields": {"f": {"type": "text"}}},
        {"fields": {"f": {"type": "text", "analyzer": "none"}}},
        {"analyzers": {"a": {"analyzers": []}}, "fields": {"f": {"type": "bool"}}},
        {"analyzers": {"a": {"analyzers": [{"type": "?"}]}}, "fields": {"f": {"type": "bool"}}},
    ],
)
def test_bad_schemas(spec):
    with pytest.raises(ValidationError):
        Schema.parse(spec)


def test_good_schema():
    assert [f.dataType.simpleString() for f in Schema.parse(GOOD).spark_schema()] == ["boolean", "string"]


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("bool", True, "true"),
        ("keyword", "x", 1),
        ("byte", -128, 1000),
        ("short", 1, 100000),
        ("integer", 1, 3000000000),
        ("long", 1, 10**19),
        ("unsigned_long", 2**64 - 1, -1),
        ("float", 1.5, 3.5e38),
        ("double", 1, "1"),
        ("integer", 1, 1.0),
    ],
)
def test_documents_are_checked(kind, good, bad):
    schema = Schema.parse({"fields": {"value": {"type": kind}}})
    validate_document(schema, {"value": good})
    validate_document(schema, {"value": None})
    for body in ({"value": bad}, {"value": good, "extra": 1}):
        with pytest.raises(ValidationError):
            validate_document(schema, body)
    needed = Schema.parse({"fields": {"value": {"type": kind, "required": True}}})
    for body in ({}, {"value": None}):
        with pytest.raises(ValidationError):
            validate_document(needed, body)


def test_bulk_checks(spark):
    schema = Schema.parse({"fields": {"b": {"type": "byte"}, "k": {"type": "keyword", "required": True}}})
    rows = conform(schema, spark.createDataFrame([(1, 5, "x"), (2, 500, "x"), (3, None, None)], "id int, b int, k string")).orderBy("id").collect()
    assert [r.problems for r in rows] == [[], ["b: no byte"], ["k: required"]] and [r.b for r in rows] == [5, None, None]


def test_document_life(spark):
    index = Index.empty(spark, "docs", {"fields": {"f1": {"type": "bool"}, "f2": {"type": "keyword"}}})
    first = index.add({"f1": True, "f2": "a"})
    index.add({"f2": "b"}, "g2")
    assert index.get(first) == {"f1": [True], "f2": ["a"]} and index.get("g2") == {"f1": [], "f2": ["b"]}
    index.add({"f2": "c"}, "g2")
    assert index.get("g2")["f2"] == ["c"] and index.answer({})["hits"]["total"]["value"] == 2
    index.delete(["g2", "unknown"])
    with pytest.raises(DocumentNotFound):
        index.get("g2")
    with pytest.raises(ValidationError):
        index.add({"f1": "1"})


def test_upsert_takes_the_latest(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, documents.upsert(base, changes, "k", "seq").collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_ids(spark):
    known = spark.createDataFrame([("b", 1), ("c", 5)], "guid string, id long")
    found = documents.assign_ids(known, spark.createDataFrame([("a",), ("c",), ("d",), ("a",)], "guid string"))
    assert sorted(map(tuple, found.collect())) == [("a", 6), ("b", 1), ("c", 5), ("d", 7)]
    fresh = documents.assign_ids(known.limit(0), spark.createDataFrame([("x",)], "guid string"))
    assert [tuple(r) for r in fresh.collect()] == [("x", 1)]


def test_answers(spark):
    index = Index.over("t", GOOD, spark.createDataFrame([(i, True, "foo " * i) for i in range(1, 6)], "id long, name boolean, name2 string"), "id")
    found = index.answer({"query": {"type": "match", "field": "name2", "query": "foo"}, "limit": 2, "offset": 1})
    assert [h["id"] for h in found["hits"]["hits"]] == [2, 3] and found["hits"]["total"] == {"value": 5, "relation": "eq"}
    assert found["took"] > 0 and found["hits"]["maxScore"] > 0 and "aggs" not in found
    best = index.answer({"query": {"type": "match", "field": "name2", "query": "foo"}, "order": "score", "limit": 1})["hits"]
    assert best["hits"][0]["score"] == best["maxScore"]
    assert index.answer({"query": {"type": "term", "field": "name", "query": False}})["hits"] == {"total": {"value": 0, "relation": "eq"}, "hits": [], "maxScore": 0.0}


def test_catalog(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    docs = spark.createDataFrame([("g1", True, "a b"), ("g2", None, None)], "guid string, name boolean, name2 string")
    engine.create_index("one", GOOD, docs)
    engine.create_index("two", GOOD)
    with pytest.raises(IndexAlreadyExists):
        engine.create_index("one", GOOD)
    with pytest.raises(ValidationError):
        engine.create_index("", GOOD)
    engine.save("one")
    engine.get_index("one").add({"name2": "c"}, "g3")
    engine.save("one")
    again = Engine(spark, str(tmp_path))
    assert sorted(r.name for r in again.list_indexes().collect()) == ["one", "two"]
    assert again.get_index("one").get("g3")["name2"] == ["c"] and again.get_index("one").created_at == engine.get_index("one").created_at
    again.drop_index("one")
    with pytest.raises(IndexNotFound):
        again.get_index("one")
    assert [n for n, _ in JsonStore(spark, f"{tmp_path}/indexes.json").all()] == ["two"]


@pytest.mark.parametrize("name", ["..", ".", "a/b", "../x", "a\\b", "indexes.json", "", "x" * 256, "a\nb", 7])
def test_names_that_lead_elsewhere_are_refused(spark, tmp_path, name):
    (tmp_path / "sibling").write_text("here")
    engine = Engine(spark, f"{tmp_path}/engine")
    with pytest.raises(ValidationError):
        engine.create_index(name, GOOD)
    engine.create_index("good name", GOOD)
    engine.save("good name")
    engine.drop_index("good name")
    assert (tmp_path / "sibling").read_text() == "here"
    assert not [p for p in (tmp_path / "engine").iterdir() if p.is_dir()]


def test_old_versions_go(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_index("one", GOOD)
    for i in range(4):
        engine.get_index("one").add({"name2": f"word{i}"}, f"g{i}")
        engine.save("one")
    (place,) = [p for p in tmp_path.iterdir() if p.is_dir()]
    assert sorted(p.name for p in place.iterdir()) == ["v3", "v4"]
    assert Engine(spark, str(tmp_path)).get_index("one").hits({"type": "match", "field": "name2", "query": "word0 word3"}).count() == 2


def test_a_cut_off_catalog_write_loses_nothing(spark, tmp_path):
    store = JsonStore(spark, f"{tmp_path}/kv.json")
    store.insert({"a": 1}, "x")
    store.insert({"a": 2}, "y")
    (tmp_path / "kv.json.3.new").write_text('{"x": {"a"')  # a writer that was cut off
    again = JsonStore(spark, f"{tmp_path}/kv.json")
    assert dict(again.all()) == {"x": {"a": 1}, "y": {"a": 2}}
    again.delete("x")
    assert dict(JsonStore(spark, f"{tmp_path}/kv.json").all()) == {"y": {"a": 2}}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["kv.json.2", "kv.json.3"]


def test_saved_texts_are_answered_from_postings(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    texts = ["a b b", "b c", None, "", "c c a", "d"]
    docs = spark.createDataFrame([(f"g{i}", True, t) for i, t in enumerate(texts)], "guid string, name boolean, name2 string")
    before = engine.create_index("one", GOOD, docs)
    queries = [{"type": "match", "field": "name2", "query": "b c zz b"}, {"type": "term", "field": "name2", "query": "a"}, {"type": "terms", "field": "name2", "query": ["d", "zz"]}]
    queries += [{"type": "bool", "should": queries[:2], "filter": [{"type": "term", "field": "name", "query": True}]}, {"type": "match", "field": "name2", "query": " "}]
    rows = lambda index: [sorted((r.guid, pytest.approx(r.score)) for r in index.hits(q).collect()) for q in queries]
    expected = [sorted((r.guid, r.score) for r in before.hits(q).collect()) for q in queries]
    engine.save("one")
    saved = Engine(spark, str(tmp_path)).get_index("one")
    assert rows(saved) == expected
    plan = saved.hits(queries[0])._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [b,c,zz])" in plan and not any("name2" in x for x in re.findall("ReadSchema: [^\\n]*", plan))
    aggs = {"t": {"type": "terms", "field": "name2"}}
    assert saved.answer({"query": queries[0], "aggs": aggs})["aggs"] == before.answer({"query": queries[0], "aggs": aggs})["aggs"]
    saved.add({"name2": "b"}, "g9")
    assert saved.hits(queries[0]).count() == 4 and saved.inverted is None


def test_fields_with_dots(spark):
    spec = {"analyzers": {"ws": {"analyzers": [{"type": "whitespace"}]}}, "fields": {"a.b": {"type": "text", "analyzer": "ws"}, "a_b": {"type": "text", "analyzer": "ws"}, "n.x": {"type": "long"}}}
    docs = spark.createDataFrame([(1, "foo bar", "x", 5), (2, "bar", "foo", 7)], ["id", "a.b", "a_b", "n.x"])
    index = Index.over("t", spec, docs, "id")
    hit = lambda q: sorted(r.id for r in index.hits(q).collect())
    assert hit({"type": "match", "field": "a.b", "query": "foo"}) == [1] and hit({"type": "match", "field": "a_b", "query": "foo"}) == [2]
    assert hit({"type": "range", "field": "n.x", "from": 6}) == [2]
    found = index.answer({"aggs": {"t": {"type": "terms", "field": "a.b"}, "m": {"type": "max", "field": "n.x"}, "l": {"type": "min", "field": "a.b"}}})["aggs"]
    assert found["t"]["buckets"][0] == {"key": "bar", "docCount": 2} and found["m"]["value"] == 7 and found["l"]["value"] == "bar"


def test_upsert_keeps_one_row_a_key(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    changes = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    one = sorted(map(tuple, documents.upsert(base, changes, "k").collect()))
    assert [k for k, _ in one] == [1, 2] and one == sorted(map(tuple, documents.upsert(base, changes.repartition(3), "k").collect()))
    with pytest.raises(Exception, match="needs a key"):
        documents.upsert(base, spark.createDataFrame([(None, "x")], "k int, v string"), "k").collect()


def test_ids_are_released_and_reused(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "guid string, id long")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "guid string")
    left, free = documents.release_ids(known, names("c", "a", "unknown"))
    assert sorted(map(tuple, left.collect())) == [("b", 2)] and sorted(r.id for r in free.collect()) == [1, 3]
    found = documents.assign_ids(left, names("x", "y", "z", "b"), free=free)
    assert sorted(map(tuple, found.collect())) == [("b", 2), ("x", 1), ("y", 3), ("z", 4)]
    assert [tuple(r) for r in documents.guids_of(found, spark.createDataFrame([(4,), (9,)], "id long")).collect()] == [(4, "z")]
    many = documents.assign_ids(known.limit(0), spark.range(5000).selectExpr("lpad(id, 5, '0') as guid"))
    assert all(int(r.guid) + 1 == r.id for r in many.collect())


def test_single_adds_are_one_step_of_the_plan(spark):
    index = Index.empty(spark, "docs", {"fields": {"f": {"type": "keyword"}}})
    for i in range(300):
        index.add({"f": str(i)}, f"g{i % 200}")
    assert index.hits().count() == 200 and index.get("g5")["f"] == ["205"]
    assert index.stored._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1


def test_store(spark, tmp_path):
    store = JsonStore(spark, f"{tmp_path}/kv.json", autosave=False)
    record = {"name": "x", "properties": {"colors": ["red"]}}
    assert store.insert(record) == "1" and store.insert(record) == "2"
    record["name"] = "changed outside"
    assert store.one("1")["name"] == "x" and set(store.multi(["1", "9"])) == {"1"}
    store.update("2", {"name": "y"})
    store.delete("9")
    with pytest.raises(NotFound):
        store.one("9")
    with pytest.raises(LodestoneError):
        store.insert({}, "1")
    assert dict(JsonStore(spark, f"{tmp_path}/kv.json").all()) == {}
    store.stop()
    assert dict(JsonStore(spark, f"{tmp_path}/kv.json").all())["2"] == {"name": "y"}


def test_streaming_ingest(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/engine")
    engine.create_index("s", {"fields": {"n": {"type": "byte"}}})
    for i, rows in enumerate([[("a", 1, 1), ("b", 2, 1)], [("a", 3, 2), ("c", 900, 2)]]):
        spark.createDataFrame(rows, "guid string, n long, seq long").write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("guid string, n long, seq long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest(stream, engine, "s", f"{tmp_path}/check", "seq").awaitTermination()
    index = Engine(spark, f"{tmp_path}/engine").get_index("s")
    assert {r.guid: r.n for r in index.stored.collect()} == {"a": 3, "b": 2}


def test_json_documents(spark, tmp_path):
    from lodestone.sources.documents import read_json, write_json

    schema = Schema.parse({"fields": {"n": {"type": "byte"}, "k": {"type": "keyword"}}})
    (tmp_path / "in.json").write_text('{"guid": "a", "source": {"n": 1, "k": "x"}}\n{"source": {"k": "y"}}\nnot json\n{"guid": " ", "source": {}}\n')
    found = read_json(spark, f"{tmp_path}/in.json", schema)
    rows = found.collect()
    assert [r.guid for r in rows if r.k == "x"] == ["a"] and len({r.guid for r in rows}) == 4 and all(r.guid.strip() for r in rows)
    assert [r._corrupt for r in rows if r._corrupt] == ["not json"]
    write_json(found.where("_corrupt is null"), f"{tmp_path}/out", schema)
    again = read_json(spark, f"{tmp_path}/out", schema)
    assert sorted((r.guid, r.n, r.k) for r in again.collect()) == sorted((r.guid, r.n, r.k) for r in rows if not r._corrupt)
