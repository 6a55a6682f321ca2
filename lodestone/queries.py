"""One query for each operator, over the driver's tables, with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ValidationError
from lodestone.functions import scoring
from lodestone.functions.analyzers import Analyzer
from lodestone.index import GUID, Index, counted, frequencies
from lodestone.operators import documents as rows
from lodestone.operators import leaves
from lodestone.plans import aggs as aggregations
from lodestone.plans.schema import Schema, conform
from lodestone.sources.catalog import Engine, work_folder
from lodestone.sources.documents import read_json, write_json

ANALYZERS = {
    "ws": {"analyzers": [{"type": "whitespace"}]},
    "uniq": {"analyzers": [{"type": "whitespace"}, {"type": "dedup"}]},
    "re": {"analyzers": [{"type": "regexp", "settings": {"pattern": r"[\s,.]"}}]},
    "nop": {"analyzers": [{"type": "nop"}]},
    "groups": {"analyzers": [{"type": "regexp", "settings": {"pattern": r"(,|\.)\s*|(\s)+"}}]},
}


def _fields(**kinds: str) -> dict:
    """``text:ws`` declares a text field with the analyzer ``ws``."""
    out = {}
    for name, kind in kinds.items():
        kind, _, analyzer = kind.partition(":")
        out[name] = {"type": kind, **({"analyzer": analyzer} if analyzer else {})}
    return {"analyzers": ANALYZERS, "fields": out}


TABLES = {
    "documents": ("doc_id", _fields(text="text:ws", lang="keyword", source="keyword", n_chars="long")),
    "events": ("event_id", _fields(event_type="keyword", user_id="long", value="double")),
    "part": ("p_partkey", _fields(p_name="text:ws", p_brand="keyword", p_type="keyword", p_size="integer", p_retailprice="double")),
    "orders": ("o_orderkey", _fields(o_orderstatus="keyword", o_orderpriority="keyword", o_totalprice="double")),
    "labels": ("doc_id", _fields(toxic="bool", quality="bool")),
}


def index(spark: SparkSession, sf_dir: str, name: str, spec: Mapping | None = None, docs: DataFrame | None = None) -> Index:
    key, declared = TABLES[name]
    return Index.over(name, spec or declared, spark.read.parquet(f"{sf_dir}/{name}.parquet") if docs is None else docs, key)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str) -> Callable:
    def keep(query: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], SQL[name] = query, sql
        return query

    return keep


def _hits(name: str, table: str, query: Mapping | None, where: str, score: str = "1.0::DOUBLE", spec: Mapping | None = None, cast: dict[str, str] | None = None) -> None:
    """Registers a query whose hits are the rows of ``table`` that satisfy ``where``."""
    key = TABLES[table][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if cast:
            docs = docs.withColumns({c: F.col(c).cast(kind) for c, kind in cast.items()})
        return index(spark, sf_dir, table, spec, docs).hits(query).withColumn("score", F.round("score", 6))

    _add(name, f"SELECT {key}, round({score}, 6) AS score FROM {table} WHERE {where}")(run)


def term(field: str, query: object) -> dict:
    return {"type": "term", "field": field, "query": query}


def between(field: str, low: object = None, high: object = None, with_low: bool = False, with_high: bool = False) -> dict:
    bounds = {k: v for k, v in (("from", low), ("to", high)) if v is not None}
    return {"type": "range", "field": field, **bounds, "includeFrom": with_low, "includeTo": with_high}


_hits("match_all", "events", None, "true")
_hits("term_all_field", "events", term("_all", "x"), "true")
_hits("term_keyword", "events", term("event_type", "click"), "event_type = 'click'")
_hits("match_keyword", "events", {"type": "match", "field": "event_type", "query": "view"}, "event_type = 'view'")
_hits("term_bool", "labels", term("toxic", True), "toxic <> 0", cast={"toxic": "boolean", "quality": "boolean"})
_hits("match_bool", "labels", {"type": "match", "field": "quality", "query": "false"}, "quality = 0", cast={"toxic": "boolean", "quality": "boolean"})
_hits("range_bool_empty", "labels", between("toxic", 0, 1), "false", cast={"toxic": "boolean", "quality": "boolean"})
_hits("term_integer", "part", term("p_size", 7), "p_size = 7")
_hits("match_integer", "part", {"type": "match", "field": "p_size", "query": "7"}, "p_size = 7")
_hits("term_long", "events", term("user_id", 3), "user_id = 3")
_hits("term_double", "part", term("p_retailprice", 901.0), "p_retailprice = 901.0")
for _kind, _type in (("short", "smallint"), ("byte", "tinyint"), ("unsigned_long", "decimal(20,0)"), ("float", "float")):
    _hits(f"term_{_kind}", "part", term("p_size", 9), "p_size = 9", spec=_fields(p_size=_kind), cast={"p_size": _type})
    _hits(f"range_{_kind}", "part", between("p_size", 5, 9, True), "p_size >= 5 AND p_size < 9", spec=_fields(p_size=_kind), cast={"p_size": _type})
_hits("term_uncoercible_empty", "part", term("p_size", "seven"), "false")
_hits("terms_keyword", "events", {"type": "terms", "field": "event_type", "query": ["click", "view"]}, "event_type IN ('click', 'view')")
_hits("terms_numeric", "part", {"type": "terms", "field": "p_size", "query": [1, "2", 3.0, "x"]}, "p_size IN (1, 2, 3)")
_hits("range_gt", "events", between("value", 50), "value > 50")
_hits("range_gte", "part", between("p_size", 40, None, True), "p_size >= 40")
_hits("range_lt", "events", between("value", None, 10), "value < 10")
_hits("range_lte", "part", between("p_size", None, 10, False, True), "p_size <= 10")
_hits("range_between_incl", "part", between("p_size", 10, 20, True, True), "p_size BETWEEN 10 AND 20")
_hits("range_mixed", "orders", between("o_totalprice", 1000, 200000, False, True), "o_totalprice > 1000 AND o_totalprice <= 200000")
_hits("range_on_keyword_empty", "part", between("p_brand", 1), "false")
_hits("range_on_text_empty", "part", between("p_name", 1), "false")
_hits("range_on_all_empty", "events", between("_all", 1), "false")
_hits("unknown_field_empty", "events", term("nothing", 1), "false")
_hits("bool_empty", "events", {"type": "bool"}, "true")
_hits("bool_should", "events", {"type": "bool", "should": [term("event_type", "click"), between("value", 90)]}, "event_type = 'click' OR value > 90", "(event_type = 'click')::INT + (value > 90)::INT::DOUBLE")
_hits("bool_must", "part", {"type": "bool", "must": [term("p_type", "PROMO"), between("p_size", 10)]}, "p_type = 'PROMO' AND p_size > 10", "2.0::DOUBLE")
_hits("bool_filter", "part", {"type": "bool", "filter": [between("p_size", 10), between("p_size", None, 30)]}, "p_size > 10 AND p_size < 30", "2.0::DOUBLE")
_hits("bool_parallel", "part", {"type": "bool", "parallel": True, "must": [term("p_size", 5), term("p_size", 5)]}, "p_size = 5", "2.0::DOUBLE")
_hits("bool_must_unknown_field", "part", {"type": "bool", "must": [term("p_size", 5), term("nothing", 5)]}, "false")
_hits(
    "bool_combined",
    "events",
    {"type": "bool", "should": [term("event_type", "click"), term("event_type", "view")], "must": [between("value", 10)], "filter": [between("user_id", None, 500)]},
    "event_type IN ('click', 'view') AND value > 10 AND user_id < 500",
    "3.0::DOUBLE",
)
_hits(
    "bool_nested",
    "part",
    {"type": "bool", "must": [{"type": "bool", "should": [term("p_size", 1), {"type": "bool", "filter": [between("p_size", 40), term("p_type", "PROMO")]}]}, between("p_retailprice", 901)]},
    "(p_size = 1 OR (p_size > 40 AND p_type = 'PROMO')) AND p_retailprice > 901",
    "1.0::DOUBLE + (p_size = 1)::INT + 2 * (p_size > 40 AND p_type = 'PROMO')::INT",
)

# Fields of several values

MANY = {"fields": {"tags": {"type": "keyword", "many": True}, "sizes": {"type": "integer", "many": True}}}


def _many(spark: SparkSession, sf_dir: str) -> Index:
    tags, sizes = F.array("p_brand", "p_type", "p_brand", F.lit(None).cast("string")), F.array(F.col("p_size"), F.col("p_size") + 25)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumns({"tags": F.when(F.col("p_size") != 1, tags), "sizes": sizes})
    return index(spark, sf_dir, "part", MANY, part)


def _many_hits(name: str, query: Mapping, where: str, score: str = "1.0::DOUBLE") -> None:
    @_add(name, f"SELECT p_partkey, {score} AS score FROM part WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _many(spark, sf_dir).hits(query)


_many_hits("many_term", term("tags", "PROMO"), "p_type = 'PROMO' AND p_size <> 1")
_many_hits("many_terms", {"type": "terms", "field": "sizes", "query": [3, 28, 40]}, "p_size IN (3, 28, 40) OR p_size + 25 IN (3, 28, 40)", "(p_size IN (3, 28, 40))::INT + (p_size + 25 IN (3, 28, 40))::INT::DOUBLE")
_many_hits("many_range", between("sizes", 10, 30, True), "(p_size >= 10 AND p_size < 30) OR (p_size + 25 >= 10 AND p_size + 25 < 30)")


@_add("many_terms_agg", "SELECT key, count(*) AS doc_count FROM (SELECT unnest(list_distinct([p_brand, p_type])) AS key FROM part WHERE p_size <> 1) GROUP BY key ORDER BY doc_count DESC, key LIMIT 15")
def many_terms_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(_many(spark, sf_dir).aggregations({"a": _terms("tags", 15)}), None)


@_add("many_min_range_agg", "SELECT count(*) FILTER (p_size BETWEEN 5 AND 20 OR p_size + 25 BETWEEN 5 AND 20) AS mid, min(p_size) AS least FROM part")
def many_min_range_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = {"r": {"type": "range", "field": "sizes", "ranges": [{"key": "mid", "from": 5, "to": 20}]}, "m": {"type": "min", "field": "sizes"}}
    return _many(spark, sf_dir).aggregations(aggs).figures.toDF("mid", "least")


# Text: tokens, statistics and relevance

WS_SQL = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


def _bm25_sql(tokens: str, wanted: list[str], where: str = "true", more: str = "0") -> str:
    distinct = list(dict.fromkeys(wanted))
    counts = ", ".join(f"len(list_filter(tok, lambda x: x = '{t}')) AS c{i}" for i, t in enumerate(distinct))
    dfs = ", ".join(f"count(*) FILTER (c{i} > 0) AS df{i}" for i in range(len(distinct)))
    at = {t: i for i, t in enumerate(distinct)}
    part = "CASE WHEN c{0} > 0 THEN (ln(n::DOUBLE / df{0}) + 1) * (c{0}::DOUBLE / dl * 2.2) / (c{0}::DOUBLE / dl + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END"
    score = " + ".join(part.format(at[t]) for t in wanted)
    some = " OR ".join(f"c{i} > 0" for i in range(len(distinct)))
    return (
        f"WITH t AS (SELECT *, {tokens} AS tok FROM documents), c AS (SELECT *, len(tok) AS dl, {counts} FROM t), "
        f"s AS (SELECT count(*) FILTER (dl > 0) AS n, avg(dl) FILTER (dl > 0) AS avgdl, {dfs} FROM c) "
        f"SELECT doc_id, round({score} + {more}, 6) AS score FROM c, s WHERE ({some}) AND {where}"
    )


def _text(name: str, query: Mapping, sql: str, analyzer: str = "ws") -> None:
    spec = _fields(text=f"text:{analyzer}", lang="keyword", source="keyword", n_chars="long")

    @_add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index(spark, sf_dir, "documents", spec).hits(query).withColumn("score", F.round("score", 6))


def match(query: object, field: str = "text") -> dict:
    return {"type": "match", "field": field, "query": query}


_text("match_text_bm25", match("the was zzz"), _bm25_sql(WS_SQL, ["the", "was", "zzz"]))
_text("match_text_repeated", match("the the and"), _bm25_sql(WS_SQL, ["the", "the", "and"]))
_text("match_text_dedup", match("the the of"), _bm25_sql(f"list_distinct({WS_SQL})", ["the", "of"]), "uniq")
_text("match_text_regexp", match("the,of"), _bm25_sql(r"list_filter(string_split_regex(text, '[\t\n\f\r ,.]'), lambda x: x <> '')", ["the", "of"]), "re")
_text("term_text_score", term("text", "the"), _bm25_sql(WS_SQL, ["the"]))
_text("terms_text_score", {"type": "terms", "field": "text", "query": ["la", "der"]}, _bm25_sql(WS_SQL, ["la", "der"]))
_text("bool_text_filter", {"type": "bool", "must": [match("the of")], "filter": [term("lang", "en"), between("n_chars", 500)]}, _bm25_sql(WS_SQL, ["the", "of"], "lang = 'en' AND n_chars > 500", "2"))


@_add("term_text_nop_token", "SELECT p_partkey FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def term_text_nop_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(spark, sf_dir, "part", _fields(p_name="text:nop"))
    least = found.aggregations({"m": {"type": "min", "field": "p_name"}}).figures.select(F.col("f0").alias("least"))
    return found.docs.join(least, F.array_contains(leaves.tokens_column("p_name"), F.col("least"))).select("p_partkey")


TOKENS_SQL = f"WITH t AS (SELECT doc_id, {WS_SQL} AS tok FROM documents), p AS (SELECT doc_id, token, count(*) AS cnt, any_value(dl) AS dl FROM (SELECT doc_id, len(tok) AS dl, unnest(tok) AS token FROM t) GROUP BY ALL)"


_text("match_text_regexp_groups", match("the, of"), _bm25_sql(r"list_filter(string_split_regex(text, '(,|\.)\s*|(\s)+'), lambda x: x <> '')", ["the", "of"]), "groups")


def _ranked(name: str, sql: str, query: Mapping, **options) -> None:
    @_add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index(spark, sf_dir, "documents").hits(query, **options).withColumn("score", F.round("score", 6))


_ranked("match_order_score", f"{_bm25_sql(WS_SQL, ['the', 'was'])} ORDER BY score DESC, doc_id LIMIT 20", match("the was"), order="score", limit=20)
_ranked(
    "bool_score_filters_off",
    _bm25_sql(WS_SQL, ["the"], "lang = 'en' AND n_chars > 500"),
    {"type": "bool", "must": [match("the")], "filter": [term("lang", "en"), between("n_chars", 500)]},
    score_filters=False,
)
_ranked("match_boost", f"SELECT doc_id, round(2.5 * score, 6) AS score FROM ({_bm25_sql(WS_SQL, ['the', 'of']).replace(', 6) AS score', ', 12) AS score')})", match("the of"), boost=2.5)


@_add("tf", f"{TOKENS_SQL} SELECT doc_id, token, round(cnt::DOUBLE / dl, 6) AS tf FROM p")
def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(spark, sf_dir, "documents")
    share = scoring.tf(F.col("tf"), F.col("dl"))
    return counted(found.docs, found.key, "text").select(F.col("key").alias("doc_id"), "token", scoring.rounded(share).alias("tf"))


@_add("idf", f"{TOKENS_SQL}, n AS (SELECT count(*) AS n FROM t WHERE len(tok) > 0) SELECT token, count(*) AS df, round(ln(any_value(n)::DOUBLE / count(*)) + 1, 6) AS idf FROM p, n GROUP BY token")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(spark, sf_dir, "documents")
    n = found.statistics({"n": F.count_if(F.size(leaves.tokens_column("text")) > 0)})
    df = frequencies(found.docs, found.key, "text")
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(scoring.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@_add("tfidf", f"{TOKENS_SQL}, n AS (SELECT count(*) AS n FROM t WHERE len(tok) > 0), d AS (SELECT token, count(*) AS df FROM p GROUP BY token) SELECT doc_id, token, round(cnt::DOUBLE / dl * (ln(n::DOUBLE / df) + 1), 6) AS tfidf FROM p JOIN d USING (token), n")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(spark, sf_dir, "documents")
    n = found.statistics({"n": F.count_if(F.size(leaves.tokens_column("text")) > 0)})
    wanted = counted(found.docs, found.key, "text").withColumnRenamed("key", "doc_id")
    df = frequencies(found.docs, found.key, "text")
    score = scoring.tfidf(F.col("tf"), F.col("dl"), F.col("n"), F.col("df"))
    # A row a token is held in a table of each partition: the postings, which are many times as many, need no sort.
    return wanted.join(df.hint("shuffle_hash"), "token").crossJoin(F.broadcast(n)).select("doc_id", "token", scoring.rounded(score).alias("tfidf"))


@_add("corpus_stats", f"WITH t AS (SELECT len({WS_SQL}) AS dl FROM documents) SELECT count(*) FILTER (dl > 0) AS n_docs, sum(dl)::BIGINT AS n_tokens, round(avg(dl) FILTER (dl > 0), 6) AS avg_len FROM t")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    dl = F.size(leaves.tokens_column("text"))
    return index(spark, sf_dir, "documents").statistics({"n_docs": F.count_if(dl > 0), "n_tokens": F.sum(dl), "avg_len": F.round(F.avg(F.when(dl > 0, dl)), 6)})


def _analyzed(name: str, chain: list[dict], sql: str) -> None:
    @_add(name, f"WITH t AS (SELECT doc_id, {sql} AS tok FROM documents) SELECT doc_id, len(tok)::INT AS n_tokens, md5(array_to_string(tok, '|')) AS digest FROM t")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", Analyzer.build(chain).column(F.col("text")).alias("tok"))
        return docs.select("doc_id", F.size("tok").alias("n_tokens"), F.md5(F.array_join("tok", "|").cast("binary")).alias("digest"))


_analyzed("analyze_nop", [{"type": "nop"}], "[text]")
_analyzed("analyze_whitespace", [{"type": "whitespace"}], WS_SQL)
_analyzed("analyze_regexp", [{"type": "regexp", "settings": {"pattern": "[aeiou]+"}}], "list_filter(string_split_regex(text, '[aeiou]+'), lambda x: x <> '')")
_analyzed("analyze_dedup", [{"type": "dedup"}], "[text]")
_analyzed("analyze_tokens", [{"type": "whitespace"}, {"type": "regexp", "settings": {"pattern": "[.,]"}}], f"list_filter(flatten(list_transform({WS_SQL}, lambda y: string_split_regex(y, '[.,]'))), lambda x: x <> '')")

# Aggregations


def _flat(name: str, table: str, aggs: Mapping, pick: Callable[[aggregations.Frames, Index], DataFrame], sql: str, query: Mapping | None = None, spec: Mapping | None = None, cast: dict[str, str] | None = None, extremes: str = "index") -> None:
    @_add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if cast:
            docs = docs.withColumns({c: F.col(c).cast(kind) for c, kind in cast.items()})
        found = index(spark, sf_dir, table, spec, docs)
        return pick(found.aggregations(aggs, query, extremes), found)


def _terms(field: str, size: int = 10, **subs: Mapping) -> dict:
    return {"type": "terms", "field": field, "size": size, **({"aggs": subs} if subs else {})}


def _buckets(frames: aggregations.Frames, _: Index) -> DataFrame:
    return frames.buckets["a"].withColumnRenamed("__path0", "key")


def _top(table: str, value: str, size: int = 10, where: str = "true") -> str:
    return f"SELECT {value} AS key, count(*) AS doc_count FROM {table} WHERE {where} GROUP BY key ORDER BY doc_count DESC, key LIMIT {size}"


_flat("agg_terms_keyword", "events", {"a": _terms("event_type", 3)}, _buckets, _top("events", "event_type", 3))
_flat("agg_terms_numeric", "part", {"a": _terms("p_size")}, _buckets, _top("part", "p_size"))
_flat("agg_terms_brand", "part", {"a": _terms("p_brand", 20)}, _buckets, _top("part", "p_brand", 20, "p_size > 10"), between("p_size", 10))
_flat("agg_terms_bool", "labels", {"a": _terms("toxic")}, _buckets, _top("labels", "toxic::BOOLEAN"), cast={"toxic": "boolean", "quality": "boolean"})
_flat("agg_terms_text", "documents", {"a": _terms("text", 20)}, _buckets, f"SELECT key, count(*) AS doc_count FROM (SELECT unnest(list_distinct({WS_SQL})) AS key FROM documents) GROUP BY key ORDER BY doc_count DESC, key LIMIT 20")

RANGES = [("low", None, 10), ("mid", 5, 20), ("high", 40, None), ("none", 1000, 2000)]
RANGE = {"type": "range", "field": "p_size", "ranges": [{"key": k, **({"from": a} if a is not None else {}), **({"to": b} if b is not None else {})} for k, a, b in RANGES]}
RANGE_SQL = [(k, " AND ".join([*([f"p_size >= {a}"] if a is not None else []), *([f"p_size <= {b}"] if b is not None else [])])) for k, a, b in RANGES]


def _range_rows(frames: aggregations.Frames, found: Index) -> DataFrame:
    return aggregations.range_rows(frames.figures, aggregations.parse({"a": RANGE})["a"], found.schema.fields["p_size"])


_flat("agg_range", "part", {"a": RANGE}, _range_rows, " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) FILTER ({w}) AS doc_count FROM part" for k, w in RANGE_SQL))
_flat("agg_filter", "events", {"a": {"type": "filter", "filter": term("event_type", "click")}}, lambda f, _: f.figures.withColumnRenamed("f0", "doc_count"), "SELECT count(*) FILTER (event_type = 'click' AND value > 10) AS doc_count FROM events", between("value", 10))


def _extreme_sql(which: str, column: str, table: str, where: str = "true") -> str:
    return f"SELECT max(CASE WHEN {column} = m THEN m END) AS value FROM {table}, (SELECT {which}({column}) AS m FROM {table}) WHERE {where}"


def _value(frames: aggregations.Frames, _: Index) -> DataFrame:
    return frames.figures.withColumnRenamed("f0", "value")


for _which in ("min", "max"):
    _flat(f"agg_{_which}", "part", {"a": {"type": _which, "field": "p_retailprice"}}, _value, _extreme_sql(_which, "p_retailprice", "part"))
    _flat(f"agg_{_which}_out_of_scope", "part", {"a": {"type": _which, "field": "p_retailprice"}}, _value, _extreme_sql(_which, "p_retailprice", "part", "p_type = 'PROMO'"), term("p_type", "PROMO"))
    _flat(f"agg_{_which}_keyword", "part", {"a": {"type": _which, "field": "p_brand"}}, _value, _extreme_sql(_which, "p_brand", "part"))
    _flat(f"agg_{_which}_in_query", "part", {"a": {"type": _which, "field": "p_retailprice"}}, _value, f"SELECT {_which}(p_retailprice) AS value FROM part WHERE p_type = 'PROMO'", term("p_type", "PROMO"), extremes="query")
_flat("agg_min_text", "documents", {"a": {"type": "min", "field": "text"}}, _value, f"SELECT min(t) AS value FROM (SELECT unnest({WS_SQL}) AS t FROM documents)")
_flat("agg_max_bool", "labels", {"a": {"type": "max", "field": "toxic"}}, _value, "SELECT max(toxic)::BOOLEAN AS value FROM labels", cast={"toxic": "boolean", "quality": "boolean"})


def _nested(frames: aggregations.Frames, names: list[str]) -> DataFrame:
    """The buckets of the terms aggregation at the end of a path of names."""
    for name in names[:-1]:
        frames = frames.below[name,]
    return frames.buckets[names[-1]]


def _renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


_flat(
    "agg_terms_terms",
    "part",
    {"a": _terms("p_brand", 5, b=_terms("p_size", 3))},
    lambda f, _: _renamed(_nested(f, ["a", "b"]), "parent", "key", "doc_count"),
    "WITH a AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT p_brand AS parent, p_size AS key, count(*) AS doc_count FROM part SEMI JOIN a USING (p_brand) GROUP BY p_brand, p_size QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) <= 3",
)
_flat(
    "agg_terms_range",
    "part",
    {"a": _terms("p_brand", 5, b=RANGE)},
    lambda f, found: _renamed(aggregations.range_rows(f.below["a",].figures, aggregations.parse({"b": RANGE})["b"], found.schema.fields["p_size"], 0, ("__path0",)), "parent", "key", "doc_count"),
    "WITH a AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) " + " UNION ALL ".join(f"SELECT p_brand AS parent, '{k}' AS key, count(*) FILTER ({w}) AS doc_count FROM part SEMI JOIN a USING (p_brand) GROUP BY p_brand" for k, w in RANGE_SQL),
)
_flat(
    "agg_range_terms",
    "part",
    {"a": {**RANGE, "aggs": {"b": _terms("p_type", 3)}}},
    lambda f, _: _renamed(_nested(f, ["a", "b"]), "parent", "key", "doc_count"),
    " UNION ALL ".join(f"(SELECT {i}::INT AS parent, p_type AS key, count(*) AS doc_count FROM part WHERE {w} GROUP BY key ORDER BY doc_count DESC, key LIMIT 3)" for i, (_, w) in enumerate(RANGE_SQL)),
)
_flat("agg_filter_terms", "events", {"a": {"type": "filter", "filter": between("value", 50), "aggs": {"b": _terms("event_type")}}}, lambda f, _: _nested(f, ["a", "b"]).withColumnRenamed("__path0", "key"), _top("events", "event_type", 10, "value > 50"))
_flat("agg_min_terms", "part", {"a": {"type": "min", "field": "p_size", "aggs": {"b": _terms("p_type")}}}, lambda f, _: _nested(f, ["a", "b"]).withColumnRenamed("__path0", "key"), _top("part", "p_type", 10, "p_size = (SELECT min(p_size) FROM part)"))
_flat("agg_max_terms", "part", {"a": {"type": "max", "field": "p_size", "aggs": {"b": _terms("p_type")}}}, lambda f, _: _nested(f, ["a", "b"]).withColumnRenamed("__path0", "key"), _top("part", "p_type", 10, "p_size = (SELECT max(p_size) FROM part)"))
_flat(
    "agg_depth3",
    "orders",
    {"a": _terms("o_orderpriority", 3, b=_terms("o_orderstatus", 2, c={"type": "filter", "filter": between("o_totalprice", 100000)}))},
    lambda f, _: _renamed(f.below["a",].below["b",].figures, "k1", "k2", "doc_count"),
    "WITH a AS (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), b AS (SELECT o_orderpriority, o_orderstatus FROM orders SEMI JOIN a USING (o_orderpriority) GROUP BY o_orderpriority, o_orderstatus QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) <= 2) "
    "SELECT o_orderpriority AS k1, o_orderstatus AS k2, count(*) FILTER (o_totalprice > 100000) AS doc_count FROM orders SEMI JOIN b USING (o_orderpriority, o_orderstatus) GROUP BY ALL",
)

# Hits, pages and documents

_BM25_THE = _bm25_sql(WS_SQL, ["the"])


@_add("hits_total_maxscore", f"SELECT count(*) AS total, max(score) AS max_score FROM ({_BM25_THE})")
def hits_total_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = index(spark, sf_dir, "documents").hits(match("the"))
    return hits.agg(F.count(F.lit(1)).alias("total"), F.round(F.max("score"), 6).alias("max_score"))


@_add("hits_page", "SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 25 OFFSET 10")
def hits_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "events").hits(term("event_type", "click"), limit=25, offset=10)


@_add("upsert_latest", "SELECT o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS o_totalprice FROM orders UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice + 2 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey > 0")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    some = orders.where("o_orderkey % 3 = 0")
    steps = some.select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq")).withColumn("o_totalprice", F.col("o_totalprice") + F.col("seq"))
    new = steps.where("o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    return rows.upsert(orders, steps.union(new), "o_orderkey", "seq")


@_add("delete_docs", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return rows.delete(orders, orders.where("o_orderstatus = 'F'"), "o_orderkey")


@_add("get_doc", "SELECT event_id, [event_type] AS event_type, [user_id] AS user_id FROM events WHERE event_id = 5")
def get_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.get(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", 5, ["event_type", "user_id"])


@_add("assign_ids", "WITH k AS (SELECT p_partkey::VARCHAR AS guid, p_partkey AS id FROM part WHERE p_partkey <= 50) SELECT * FROM k UNION ALL SELECT guid, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY guid) AS id FROM (SELECT p_partkey::VARCHAR AS guid FROM part WHERE p_partkey > 50)")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("guid"), F.col("p_partkey").alias("id"))
    return rows.assign_ids(part.where("id <= 50"), part.select("guid"))


@_add(
    "id_reuse",
    "WITH p AS (SELECT p_partkey::VARCHAR AS guid, p_partkey AS id FROM part), k AS (SELECT * FROM p WHERE id <= 50 AND id % 5 <> 0), "
    "f AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM p WHERE id <= 50 AND id % 5 = 0), "
    "w AS (SELECT guid, row_number() OVER (ORDER BY guid) AS n FROM p WHERE id > 50 OR id % 5 = 0) "
    "SELECT * FROM k UNION ALL SELECT guid, coalesce(f.id, w.n - (SELECT count(*) FROM f) + 50) AS id FROM w LEFT JOIN f USING (n)",
)
def id_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("guid"), F.col("p_partkey").alias("id"))
    known, free = rows.release_ids(part.where("id <= 50"), part.where("id % 5 = 0 AND id <= 50"))
    return rows.assign_ids(known, part.select("guid"), free=free)


@_add("id_lookup", "SELECT p_partkey AS id, p_partkey::VARCHAR AS guid FROM part WHERE p_partkey <= 50 AND p_partkey % 7 = 0")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("guid"), F.col("p_partkey").alias("id"))
    return rows.guids_of(part.where("id <= 50"), part.where("id % 7 = 0").select("id"))


# Engines on storage


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, f"{work_folder(spark)}/engine-{uuid.uuid4().hex}")


def saved_documents(spark: SparkSession, sf_dir: str) -> Index:
    """An index of the documents, saved and opened again."""
    engine = _engine(spark)
    engine.create_index("docs", TABLES["documents"][1], spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    engine.save("docs")
    return Engine(spark, engine.folder).get_index("docs")


def _saved(name: str, query: Mapping, sql: str) -> None:
    @_add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return saved_documents(spark, sf_dir).hits(query).withColumn("score", F.round("score", 6))


_saved("saved_index_hits", match("the was zzz"), _bm25_sql(WS_SQL, ["the", "was", "zzz"]))
_saved("saved_index_bool", {"type": "bool", "must": [match("the of")], "filter": [term("lang", "en"), between("n_chars", 500)]}, _bm25_sql(WS_SQL, ["the", "of"], "lang = 'en' AND n_chars > 500", "2"))


@_add("catalog_listing", "SELECT * FROM (VALUES ('../up', false), ('a b', false), ('docs', true), ('parts', true)) t(name, listed)")
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four names an engine lists that was opened anew: two created, one created and dropped, one refused."""
    engine = _engine(spark)
    for name in ("docs", "parts", "a b", "../up"):
        try:
            engine.create_index(name, TABLES["part"][1])
        except ValidationError:
            pass
    engine.drop_index("a b")
    listed = Engine(spark, engine.folder).list_indexes()
    names = spark.createDataFrame([(n,) for n in ("docs", "parts", "a b", "../up")], "name string")
    return names.join(listed.select("name", F.lit(True).alias("listed")), "name", "left").select("name", F.coalesce("listed", F.lit(False)).alias("listed"))


@_add("ingest_json", "SELECT event_id::VARCHAR AS guid, event_type, value FROM events WHERE event_type = 'click' AND value > 20")
def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema.parse(TABLES["events"][1])
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(GUID, F.col("event_id").cast("string"))
    path = f"{work_folder(spark)}/events-{uuid.uuid4().hex}"
    write_json(events, path, schema)
    found = Index.over("events", TABLES["events"][1], read_json(spark, path, schema).where("_corrupt is null"), GUID)
    return found.matching({"type": "bool", "filter": [term("event_type", "click"), between("value", 20)]}).select(GUID, "event_type", "value")


@_add("validate_docs", "SELECT o_orderkey, (CASE WHEN o_orderkey > 127 OR o_orderkey < -128 THEN 1 ELSE 0 END + CASE WHEN o_totalprice <> floor(o_totalprice) THEN 1 ELSE 0 END + 1)::INT AS n_problems FROM orders")
def validate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema.parse({"fields": {"small": {"type": "byte"}, "price": {"type": "long"}, "missing": {"type": "keyword", "required": True}}})
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("small"), F.col("o_totalprice").alias("price"))
    return conform(schema, orders).select("o_orderkey", F.size("problems").alias("n_problems"))
