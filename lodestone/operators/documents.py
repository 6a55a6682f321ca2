"""Documents as rows: latest of each key, deletion, lookup and ids, all as joins and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """The last row of each key by ``sequence``; of ties, and without a sequence, the one whose values hash highest, so that reruns agree."""
    values = F.xxhash64(*[F.col(f"`{c}`") for c in changes.columns])
    rank = F.row_number().over(Window.partitionBy(f"`{key}`").orderBy(*([F.desc(f"`{sequence}`")] if sequence else []), F.desc(values)))
    return changes.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(base: DataFrame, changes: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """``base`` with rows replaced or added by key, one for each; with ``sequence`` the last of several changes wins. A null key stops the job."""
    new = latest(changes, key, sequence).drop(*([] if sequence is None or sequence in base.columns else [sequence]))
    held = F.col(f"`{key}`")
    new = new.withColumn(key, F.when(held.isNull(), F.raise_error(F.lit("a document needs a key")).cast(new.schema[key].dataType)).otherwise(held))
    return base.join(new.select(held), key, "left_anti").unionByName(new)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``base`` without the keys; unknown keys do nothing."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def get(base: DataFrame, key: str, value: object, fields: list[str]) -> DataFrame:
    """One document with the values of each field as an array, empty where there are none."""
    out = []
    for name in fields:
        column, kind = F.col(f"`{name}`"), base.schema[name].dataType.simpleString()
        many = kind.startswith("array")
        out.append(F.coalesce(column if many else F.when(column.isNotNull(), F.array(column)), F.array().cast(kind if many else f"array<{kind}>")).alias(name))
    return base.where(F.col(key) == F.lit(value)).select(key, *out)


def new_guid() -> str:
    return str(uuid.uuid4())


def assign_ids(known: DataFrame, guids: DataFrame, first: int = 1, free: DataFrame | None = None) -> DataFrame:
    """``guid, id``: the known ids, and ids for new guids in their order: those of ``free`` (``id``), smallest first, then the next whole numbers.

    Guids are dealt to ranges whose bounds are drawn from a bounded sample and numbered within
    them; only bounds and counts reach the driver, and a task that runs again numbers alike.
    """
    spark = known.sparkSession
    new = numbered(guids.select("guid").distinct().join(known.select("guid"), "guid", "left_anti"), "guid")
    last = known.agg(F.max("id")).first()[0]
    last = first - 1 if last is None else last
    if free is None:
        named = new.select("guid", (F.col("nth") + last).alias("id"))
    else:
        free = free.select("id").distinct()
        last = max(last, free.agg(F.max("id")).first()[0] or last)
        n = free.count()
        spare = numbered(free, "id").withColumnRenamed("nth", "at")
        named = new.join(spare, F.col("nth") == F.col("at"), "left").select("guid", F.coalesce("id", F.col("nth") - n + last).alias("id"))
    return known.select("guid", F.col("id").cast("long").alias("id")).union(named)


def numbered(rows: DataFrame, column: str, sample: int = 20_000) -> DataFrame:
    """``rows`` with ``nth``, the place of each distinct value of ``column`` from 1 in ascending order."""
    spark = rows.sparkSession
    ranges = min(200, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = rows.select(column).orderBy(F.xxhash64(column)).limit(sample)
    bounds = sorted(r[0] for r in drawn.collect())[:: max(1, sample // ranges)][1:]
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column))) if bounds else F.lit(0)
    dealt = rows.withColumn("__part", part)
    counts = sorted(tuple(r) for r in dealt.groupBy("__part").count().collect())
    before, offsets = 0, []
    for number, n in counts:
        offsets.append((number, before))
        before += n
    offsets = spark.createDataFrame(offsets, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return dealt.join(F.broadcast(offsets), "__part").withColumn("nth", F.col("__before") + place).drop("__part", "__before")  # a row a range


def release_ids(known: DataFrame, guids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``known`` (``guid, id``) without ``guids``, and the ids (``id``) that this frees; unknown guids free none."""
    gone = guids.select("guid").distinct()
    return known.join(gone, "guid", "left_anti"), known.join(gone, "guid", "left_semi").select("id")


def guids_of(known: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, guid`` of the ids that are known."""
    return known.join(ids.select("id").distinct(), "id").select("id", "guid")
