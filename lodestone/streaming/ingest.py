"""Documents from a stream, upserted into a saved index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.schema import conform
from lodestone.sources.catalog import Engine


def ingest(stream: DataFrame, engine: Engine, name: str, checkpoint: str, sequence: str | None = None) -> StreamingQuery:
    """Starts a query that takes all that is there and ends. Rows that break the schema are left out.

    A batch that is run again replaces the same keys by the same rows.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        index = engine.get_index(name)
        good = conform(index.schema, batch, "__problems").where("size(__problems) = 0")
        columns = [index.key, *index.schema.fields, *([sequence] if sequence and sequence not in index.schema.fields else [])]
        index.upsert(good.select(*[f"`{c}`" for c in columns]), sequence)
        engine.save(name)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
