"""Helpers shared by the corpus operators: shared storage, lineage cuts, column naming."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words where a contract speaks of ``[^\x20\x09-\x0D]+``;
#: ``bytes.split()`` separates at exactly these.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, with its scheme: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local one serves a session without executors of its own (tests); a cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return qualified(spark, folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark resolves it by, so that readers outside the JVM go to the same file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") or "/")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path).toString()


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """What runs within removes its shuffle files when it ends; a stage that needs them again is run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept on shared storage, so that neither lineage nor a lost executor recomputes it."""
    shared_dir(df.sparkSession)
    with _freeing(df.sparkSession):
        return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as compressed Parquet, whose size the planner knows when it picks a join."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Frees what ``table`` wrote once nothing reads it again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/lodestone-" in f}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts of one byte a character take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_hash(text: Column) -> Column:
    """With the id, the identity of a row: two texts of one id are told apart by it. Null has a hash of its own."""
    return F.xxhash64(text)


def same_row(left: DataFrame, right: DataFrame, ident: str = "doc", hashed: str = "th") -> Column:
    """Rows equal in id (nulls are equal) and text hash."""
    return left[ident].eqNullSafe(right[ident]) & (left[hashed] == right[hashed])


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``rows`` (``doc, th, keep``) doesn't keep, all columns unchanged.

    ``rows`` holds the identity of each row of ``docs`` once for each copy. Where copies
    equal in id and text are kept, one of them stays.
    """
    fate = rows.groupBy("doc", "th").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n")).where("not keep or n > 1")
    fate = table(fate, "fate")
    doc, th, keep = (fresh(docs, c) for c in ("gone_doc", "gone_th", "gone_keep"))
    fate = fate.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("keep").alias(keep))
    ident, hashed = docs[id_col].cast("long"), text_hash(docs[text_col].cast("string"))
    found = docs.join(fate, ident.eqNullSafe(F.col(doc)) & (hashed == F.col(th)), "left").where(f"`{keep}` is null or `{keep}`")
    single = found.where(F.col(keep).isNull())
    return single.unionByName(found.where(keep).dropDuplicates([doc, th])).select(*[f"`{c}`" for c in docs.columns])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` clashes with it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row from 0 in the order of ``keys``, without a single task seeing all rows.

    Rows are range-partitioned, sorted and written; what is collected is a count for each partition.
    """
    spark = df.sparkSession
    part, offset = f"{name}_part", f"{name}_offset"
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())
    placed = table(placed, "ranked").withColumn(part, F.shiftright(name, 33))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    before, rows = 0, []
    for number, n in counts:
        rows.append((number, before))
        before += n
    offsets = spark.createDataFrame(rows, f"{part} long, {offset} long")
    placed = placed.join(F.broadcast(offsets), part)  # a row a partition
    return placed.withColumn(name, F.col(offset) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop(part, offset)
