"""Mixing sources to target weights by pivotal dependent rounding.

Sources share the size of the whole corpus by weight, none above ``CAP`` times its own
size. A document of a source is due target / size copies: the whole part for certain, the
fraction by pivotal rounding. Of two documents with open fractions, words move from one to
the other, at random which way, until one fraction is 0 or 1; neither the words due to
both nor the expectation of either changes, and the one still open goes on to the next. So
a source's words miss its target by less than the one document that is left. Documents
meet in descending size, so that one is seldom large. Blocks of ``BLOCK`` documents are rounded
apart and leave one fraction each, and blocks of these again, up a tree, until a source
has one left. All random numbers are hashes of ids, so a rerun decides alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.llm._shared import WORD_PATTERN, cut, fresh, ranked, table, text_hash

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 2000
#: Blocks whose leftover fractions meet in one block of the next level.
FAN_IN = 500
SEED = 11


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, n_docs, source_size, target`` from ``source, size`` rows.

    Sources take ``WEIGHTS`` in turn by code point, null last. The level at which shares
    are capped rises by aggregations until none is above its cap.
    """
    stats = cut(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")))
    order = ranked(stats, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    stats = cut(order.withColumn("weight", weight).drop("place"))
    whole = stats.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * float(CAP)
    while True:  # each round caps at least one source more, or ends
        free = F.col("weight") * level <= cap
        capped, weights = stats.agg(F.sum(F.when(free, 0.0).otherwise(cap)), F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        if not weights:
            break
        new = (whole - capped) / weights
        if new <= level:
            break
        level = new
    return stats.select("source", "n_docs", "source_size", F.least(F.col("weight") * level, cap).alias("target"))


def _chance(*parts) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, parts)).encode(), SEED) / 2**64


def _round_block(group: pd.DataFrame) -> pd.DataFrame:
    """Settles all rows of a block but at most one, or all if the block is its source's last."""
    order = group.sort_values(["size", "doc_id", "th"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    share, size, ids = order["share"].to_numpy(np.float64).copy(), order["size"].to_numpy(np.float64), list(zip(order["doc_id"].tolist(), order["th"].tolist()))
    held = -1
    for i in range(len(share)):
        if not 0.0 < share[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        give, take = min(share[held] * size[held], (1 - share[i]) * size[i]), min(share[i] * size[i], (1 - share[held]) * size[held])
        words = -give if _chance(*ids[held], *ids[i], i) * (give + take) < take else take
        share[held] += words / size[held]
        share[i] -= words / size[i]
        for j in (held, i):
            if min(abs(share[j]), abs(1 - share[j])) < 1e-9:
                share[j] = float(round(share[j]))
        open_ = [j for j in (held, i) if 0.0 < share[j] < 1.0]
        held = open_[0] if open_ else -1
    if held >= 0 and order["blocks"].iloc[0] <= 1:
        share[held] = float(_chance(*ids[held], "last") < share[held])
    order["share"] = share
    return order


ROW = "doc_id long, th long, source string, size long, n long, source_size long, target double, sure long, share double, block long, blocks long"


def allot(docs: DataFrame) -> DataFrame:
    """``doc_id, th, source, size, source_size, target, n, whole, more`` for the distinct rows of ``doc_id, th, source, size``.

    Each of a row's ``n`` copies in ``docs`` is taken ``whole`` times, and ``more`` of them once more.
    Equal rows are one before any block is made, as is what is due to them together;
    documents without words have none to give and are taken ``whole`` times.
    """
    aims = targets(docs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = docs.groupBy("doc_id", "th", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(aims.withColumnRenamed("source", "aim"), F.col("source").eqNullSafe(F.col("aim")))
    due = (F.col("rate") - F.floor("rate")) * F.col("n")
    rows = rows.withColumn("rate", rate).withColumn("due", F.when(F.col("size") > 0, due).otherwise(0.0))
    rows = rows.withColumn("blocks", F.greatest(F.ceil(F.col("n_docs") / BLOCK), F.lit(1)))
    rows = rows.select(
        "doc_id", "th", "source", "size", "n", "source_size", "target", (F.floor("rate") * F.col("n") + F.floor("due")).alias("sure"),
        (F.col("due") - F.floor("due")).alias("share"), F.pmod(F.xxhash64("doc_id", "size", "th"), F.col("blocks")).alias("block"), "blocks",
    )
    plain = rows.where("size = 0")
    rows, done = rows.where("size > 0"), plain
    while True:
        out = table(rows.groupBy("source", "block").applyInPandas(_round_block, ROW), "rounded")
        still = (F.col("share") > 0) & (F.col("share") < 1)
        done = done.union(out.where(~still))
        rows = out.where(still)
        if rows.isEmpty():
            break
        rows = rows.withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("blocks", F.ceil(F.col("blocks") / FAN_IN))
    all_ = F.col("sure") + F.col("share").cast("long")
    return done.select("doc_id", "th", "source", "size", "source_size", "target", "n", F.floor(all_ / F.col("n")).alias("whole"), (all_ % F.col("n")).alias("more"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("th"), F.col(source_col).cast("string").alias("source"), size_of(text).alias("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, taken, copies``.

    ``taken`` is the size times the copies, at most ``CAP``. Null and blank texts have
    size 0 and take nothing, a source without words has target 0, a null source is one
    more source, and null ids are ids. Ties of weight can't occur: places among the sources
    decide. Of rows equal in id, text and source it is open which is taken once more, but not
    how many are. An empty table gives no rows.
    """
    got = allot(table(_sizes(docs, id_col, text_col, source_col), "sizes"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    got = got.withColumn("nth", each).withColumn("copies", F.col("whole") + (F.col("nth") <= F.col("more")).cast("long"))
    return got.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, all columns unchanged.

    A further column ``copy`` (lengthened by ``_`` where a column has the name) numbers its copies from 1.
    Edge cases are those of ``mix``; documents without words come ``whole`` times, which is
    what every document of their source comes at least.
    """
    nth, doc, none, th, source, copies = (fresh(docs, c) for c in ("nth", "id_or_zero", "id_is_null", "text_hash", "mix_source", "copies"))
    at = [doc, none, th, source]

    def known(ident: Column, hashed: Column, origin: Column) -> list[Column]:
        """The identity of a row without nulls: texts are shuffled by it once, for the join and to number equal rows."""
        return [c.alias(n) for c, n in zip((F.coalesce(ident, F.lit(0)), ident.isNull(), hashed, F.coalesce(F.concat(F.lit("="), origin), F.lit(""))), at)]

    taken = allot(table(_sizes(docs, id_col, text_col, source_col), "sizes"))
    taken = table(taken.select(*known(F.col("doc_id"), F.col("th"), F.col("source")), F.col("whole").alias(copies), F.col("more").alias(f"{copies}_more")), "taken")
    own = docs.select("*", *known(F.col(id_col).cast("long"), text_hash(F.col(text_col).cast("string")), F.col(source_col).cast("string")))
    found = own.hint("merge").join(taken, at).withColumn(nth, F.row_number().over(Window.partitionBy(*at).orderBy(doc)))
    found = found.withColumn(copies, (F.col(copies) + (F.col(nth) <= F.col(f"{copies}_more")).cast("long")).cast("int")).where(F.col(copies) > 0)
    number = fresh(docs, "copy")
    return found.select(*[f"`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(number))
