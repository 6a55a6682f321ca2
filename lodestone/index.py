"""An index: a schema over a frame of documents, with what queries need derived once."""

from __future__ import annotations

import datetime
import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import DocumentNotFound, InvalidRequest
from lodestone.operators import documents, leaves
from lodestone.plans import aggs as aggregations
from lodestone.plans import query as queries
from lodestone.plans.schema import Schema, validate_document

GUID = "guid"
#: Hits of an answer that states no limit: what the driver holds doesn't grow with the documents.
PAGE = 10_000


def shares_keys(docs: DataFrame, key: str) -> bool:
    """Whether any two documents have the same key, null or not; only the keys are read."""
    return not docs.groupBy(f"`{key}`").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty()


def counted(docs: DataFrame, key: str, name: str) -> DataFrame:
    """``key, token, tf, dl``: how often a text field holds each of its tokens, and its length.

    A document is counted by itself, from the runs of its sorted tokens, so nothing is dealt out; documents that share
    a key are added up. Generators are outer ones: for others Spark infers a filter that derives the tokens once more.
    """
    size = F.size("__tokens")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.sort_array(leaves.tokens_column(name)).alias("__tokens"))
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("__tokens", i) != F.get("__tokens", i - 1)))
    rows = rows.withColumn("__starts", F.when(size > 0, starts))
    rows = rows.select("*", F.posexplode_outer("__starts").alias("__run", "__at")).where("__at is not null")
    end = F.coalesce(F.get("__starts", F.col("__run") + 1), size)
    rows = rows.select("key", F.get("__tokens", F.col("__at")).alias("token"), (end - F.col("__at")).alias("tf"), size.alias("dl"))
    if shares_keys(docs, key):
        rows = rows.groupBy("key", "token").agg(F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl"))
    return rows


def frequencies(docs: DataFrame, key: str, name: str) -> DataFrame:
    """``token, df``: how many keys have a token in a text field."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.explode_outer(F.array_distinct(leaves.tokens_column(name))).alias("token")).where("token is not null")
    if shares_keys(docs, key):
        rows = rows.distinct()
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@dataclass(frozen=True)
class Inverted:
    """A text field's inverted index: ``token, key, tf, dl`` in ranges of tokens, ``token, df``, and one row of ``n_docs, average``."""

    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, key: str, name: str) -> Inverted:
        length = F.size(leaves.tokens_column(name))
        totals = docs.agg(F.count_if(length > 0).alias("n_docs"), F.avg(F.when(length > 0, length)).alias("average"))
        return cls(counted(docs, key, name), frequencies(docs, key, name), totals)

    def write(self, path: str) -> None:
        """Tokens lie in ranges, sorted, so that a query reads the row groups of its own; a frequent one may fill several files."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("token", "key").sortWithinPartitions("token", "key").write.mode("overwrite").parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        written.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/frequencies")
        self.totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Inverted:
        return cls(*[spark.read.parquet(f"{path}/{part}") for part in ("postings", "frequencies", "totals")])


class Index:
    """Queries compile to one pass over the documents, plus one for corpus statistics if text is scored.

    An index that was saved brings an inverted index for each text field: its text queries read
    the postings of their tokens and no text.
    """

    def __init__(self, name: str, schema: Schema, docs: DataFrame, key: str = GUID, created_at: datetime.datetime | None = None, inverted: Mapping[str, Inverted] | None = None) -> None:
        self.name, self.schema, self.key = name, schema, key
        self.created_at = created_at or datetime.datetime.now(datetime.UTC)
        self._pending: dict[str, tuple] = {}
        self._load(docs, inverted)

    @classmethod
    def over(cls, name: str, spec: Mapping, docs: DataFrame, key: str) -> Index:
        """An index over columns of an existing frame; single-valued fields stay scalar, so their filters are pushed down."""
        return cls(name, Schema.parse(spec), docs, key)

    @classmethod
    def empty(cls, spark: SparkSession, name: str, spec: Mapping) -> Index:
        schema = Schema.parse(spec)
        fields = [T.StructField(GUID, T.StringType(), False), *[T.StructField(f.name, f.spark_type) for f in schema.fields.values()]]
        return cls(name, schema, spark.createDataFrame([], T.StructType(fields)))

    def _load(self, docs: DataFrame, inverted: Mapping[str, Inverted] | None = None) -> None:
        self.inverted = inverted  # of these documents; without one, texts are tested by their tokens
        self._stored = docs.select(f"`{self.key}`", *[f"`{f}`" for f in self.schema.fields if f != self.key])
        text = {leaves.tokens_column(f.name): f.name for f in self.schema.fields.values() if f.kind == "text"}
        if text and set(text) <= set(docs.columns):  # a saved index brings its tokens
            self._docs = docs.select(*[f"`{c}`" for c in self._stored.columns], *text)
        else:
            self._docs = self._stored.withColumns({column: self._tokens(name) for column, name in text.items()}) if text else self._stored

    def _flush(self) -> None:
        """Takes in the documents that were added one by one, all in one step of the plan."""
        if self._pending:
            rows, self._pending = list(self._pending.values()), {}
            self.upsert(self._stored.sparkSession.createDataFrame(rows, self._stored.schema))

    @property
    def stored(self) -> DataFrame:
        """The documents as they were given."""
        self._flush()
        return self._stored

    @property
    def docs(self) -> DataFrame:
        """The documents and the tokens of their texts."""
        self._flush()
        return self._docs

    def _tokens(self, name: str) -> Column:
        analyzer, column = self.schema.analyzer_of(name), F.col(f"`{name}`")
        if self.schema.fields[name].many:
            return F.flatten(F.transform(F.coalesce(column, F.array().cast("array<string>")), analyzer.column))
        return analyzer.column(column)

    def cache(self) -> Index:
        """Keeps the documents and their tokens, in memory where they fit."""
        self._docs = self.docs.persist()
        return self

    # Documents

    def add(self, source: Mapping, guid: str | None = None) -> str:
        """Inserts or replaces one document; returns its id."""
        validate_document(self.schema, source)
        guid = guid or documents.new_guid()
        self._pending[guid] = (guid, *[source.get(f) for f in self.schema.fields])
        return guid

    def upsert(self, changes: DataFrame, sequence: str | None = None) -> None:
        self._load(documents.upsert(self.stored, changes, self.key, sequence))

    def delete(self, guids: Iterable[object] | DataFrame) -> None:
        if not isinstance(guids, DataFrame):
            guids = self.stored.sparkSession.createDataFrame([(g,) for g in guids], T.StructType([self.stored.schema[self.key]]))
        self._load(documents.delete(self.stored, guids, self.key))

    def get(self, guid: object) -> dict:
        rows = documents.get(self.stored, self.key, guid, list(self.schema.fields)).limit(1).collect()
        if not rows:
            raise DocumentNotFound(guid)
        found = rows[0].asDict()
        return {k: v for k, v in found.items() if k != self.key or k in self.schema.fields}

    # Queries

    def statistics(self, wanted: dict[str, Column]) -> DataFrame:
        """One row of figures over all documents of the index."""
        return self.docs.agg(*[c.alias(n) for n, c in wanted.items()])

    def _compiled(self, query: Mapping | None, **options) -> tuple[DataFrame, Column]:
        """The matching documents, with what the score refers to, and the score."""
        docs = self.docs  # before what is added one by one counts, it is taken in
        compiler = queries.Compiler(self.schema, inverted=self.inverted is not None, **options)
        found = compiler.compile(queries.parse(query or queries.MATCH_ALL))
        wanted = compiler.statistics
        if self.inverted is not None and wanted.tokens:
            return self._with_postings(docs, wanted).where(found.test), found.score
        docs = docs.where(found.test)
        if wanted.wanted:
            docs = docs.withColumns(wanted.per_document)
            docs = docs.crossJoin(F.broadcast(self.statistics(wanted.wanted)))  # one row
        return docs, found.score

    def _with_postings(self, docs: DataFrame, wanted: queries.Statistics) -> DataFrame:
        """``docs`` with the counts of the tokens of a query, from their postings alone."""
        for name in dict.fromkeys(n for n, _ in wanted.tokens):
            held, known = self.inverted[name], leaves.plain(name)
            tokens = {t: at for (n, t), at in wanted.tokens.items() if n == name}
            mine = F.col("token").isin(list(tokens))
            counts = [F.max(F.when(F.col("token") == t, F.col("tf"))).alias(f"__tf_{at}") for t, at in tokens.items()]
            rows = held.postings.where(mine).groupBy(F.col("key").alias("__key")).agg(F.first("dl").alias(f"__dl_{known}"), *counts)
            rare = [F.coalesce(F.max(F.when(F.col("token") == t, F.col("df"))), F.lit(0)).alias(f"__df_{at}") for t, at in tokens.items()]
            figures = held.frequencies.where(mine).agg(*rare).crossJoin(held.totals.select(F.col("n_docs").alias(f"__n_{known}"), F.col("average").alias(f"__len_{known}")))
            docs = docs.join(rows, docs[f"`{self.key}`"] == F.col("__key"), "left").drop("__key").crossJoin(F.broadcast(figures))  # one row
            docs = docs.withColumns({f"__tf_{at}": F.coalesce(f"__tf_{at}", F.lit(0)) for at in tokens.values()})
        return docs

    def hits(self, query: Mapping | None = None, *, order: str = "id", limit: int | None = None, offset: int = 0, **options) -> DataFrame:
        """``key, score`` of the matching documents, by id or by descending score."""
        docs, score = self._compiled(query, **options)
        key = F.col(f"`{self.key}`")
        hits = docs.select(key, score.cast("double").alias("score"))
        if order == "score":
            hits = hits.orderBy(F.desc("score"), key.asc())
        elif limit is not None or offset:
            hits = hits.orderBy(key.asc())
        if offset:
            hits = hits.offset(offset)
        return hits if limit is None else hits.limit(limit)

    def matching(self, query: Mapping | None = None) -> DataFrame:
        docs, _ = self._compiled(query)
        return docs.select(*[f"`{c}`" for c in self.docs.columns])

    def aggregations(self, aggs: Mapping, query: Mapping | None = None, extremes: str = "index") -> aggregations.Frames:
        """The frames of an aggregation tree over the matching documents, nothing run yet."""
        runner = aggregations.Runner(self.schema, self.docs, extremes)
        return runner.frames(aggregations.parse(aggs), aggregations.Scope(self.matching(query)))

    def answer(self, request: Mapping, extremes: str = "index", page: int = PAGE) -> dict:
        """Answers ``{query, aggs, limit, offset, order}`` with hits, their total and best score, and nested aggregations.

        Without a limit, the first ``page`` hits come; ``hits`` returns all, as a frame.
        """
        if not isinstance(request, Mapping):
            raise InvalidRequest("a request is an object")
        began = time.perf_counter()
        query, limit, offset = request.get("query"), request.get("limit"), request.get("offset") or 0
        total, best = self.hits(query).agg(F.count(F.lit(1)), F.max("score")).first()
        rows = self.hits(query, order=request.get("order", "id"), limit=page if limit is None else limit, offset=offset).collect() if total else []
        wanted = aggregations.parse(request.get("aggs"))
        out = {
            "took": 0,
            "hits": {"total": {"value": total, "relation": "eq"}, "hits": [{"id": r[0], "score": r[1]} for r in rows], "maxScore": max(best or 0.0, 0.0)},
        }
        if wanted:
            runner = aggregations.Runner(self.schema, self.docs, extremes)
            out["aggs"] = runner.render(wanted, runner.frames(wanted, aggregations.Scope(self.matching(query))))
        out["took"] = int((time.perf_counter() - began) * 1e6)
        return out
