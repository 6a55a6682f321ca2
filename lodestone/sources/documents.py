"""Documents as JSON lines: ``{"guid": ..., "source": {field: value}}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.index import GUID
from lodestone.plans.schema import Schema


def read_json(spark: SparkSession, path: str, schema: Schema, seed: int = 0) -> DataFrame:
    """One row per line: ``guid`` and the schema's fields; ``_corrupt`` holds lines that aren't such objects.

    A missing or blank id becomes a UUID. It is drawn from ``seed``, so that a task that
    is run again gives the same one.
    """
    kinds = T.StructType([T.StructField(GUID, T.StringType()), T.StructField("source", schema.spark_schema()), T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(kinds).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    given = F.when(F.trim(F.col(GUID)) != "", F.col(GUID))
    return rows.select(F.coalesce(given, F.uuid(F.lit(seed))).alias(GUID), *[F.col(f"source.`{f}`").alias(f) for f in schema.fields], "_corrupt")


def write_json(df: DataFrame, path: str, schema: Schema) -> None:
    """Writes ``guid`` and the schema's fields as ``read_json`` reads them."""
    df.select(GUID, F.struct(*[F.col(f"`{f}`") for f in schema.fields]).alias("source")).write.json(path)
