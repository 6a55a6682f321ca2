"""Embedding near-duplicates by sorted projection passes.

Each pass hashes a vector to the signs of ``BITS`` random projections and orders all
vectors lexicographically by them; a vector is compared with its neighbours in a bounded window.
Passes are rows of one sorted table, so a range partition holds what must meet however many vectors
share a hash. Equal vectors are one before any pass.

The first pass carries vectors, so that dense groups are linked where they lie. The others
carry a sketch of ``SKETCH`` more signs: what is near by both and not linked yet is verified in double
precision. There are as many passes as a pair at the threshold, alone among others, needs to meet with a
probability of ``RECALL``: see ``passes``. Verified links are joined across passes into components.

Within a component links are then counted on all its vectors: one whose members all lie
within half the angle of its pivot links each with every other, which needs no pair; of the
others, members whose angles to the pivot differ by more than the threshold's can't be
linked, and what remains is verified in square blocks, counts only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._shared import cut, ranked, table
from lodestone.llm.components import connected_components

THRESHOLD = 0.9
RECALL = 0.99
BITS = 60
SKETCH = 128
#: Followers in the order of a pass that a vector is compared with: by vectors, by sketches.
NEIGHBOURS, WINDOW = 48, 256
#: Ranks in a block of neighbours; the rows of a window are lent to it.
BLOCK = 2048
#: Vectors to a side of the squares in which wide components are verified.
SQUARE = 512
#: Candidates that a block names first of those between two components; the rest follow if the components stay apart.
FIRST = 4
SEED = 5
#: Slack of angle comparisons against rounding.
SLACK = 1e-9
ANGLE = math.acos(THRESHOLD)
#: Chance that one sign of a pair at the threshold differs.
_DIFFER = ANGLE / math.pi
#: Signs, of all that a row carries, that may differ: a pair at the threshold has more once in 100,000 times.
DISTANCE = math.floor((BITS + SKETCH) * _DIFFER + 4.4 * math.sqrt((BITS + SKETCH) * _DIFFER * (1 - _DIFFER)))


def passes(n: int, recall: float = RECALL) -> int:
    """Passes after which two of ``n`` vectors at the threshold, the others lying at random, have met with a chance of ``recall``.

    They meet in a pass if they agree in the signs that tell windows apart, and one more: 10 passes for 10,000
    vectors, 16 for 50 thousand, 38 for 2 million, 55 for 10 million, 158 for a billion.
    """
    signs = math.log2(max(1.0, n / WINDOW)) + 1
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - (1 - _DIFFER) ** signs)))


def unit(vectors) -> np.ndarray:
    """Rows of length one in double precision; all must be finite, of one length and not zero."""
    found = np.array(vectors, dtype=np.float64)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of a column of arrays, by length."""
    widths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy().astype(np.float64), column.offsets.to_numpy()[:-1]
    for width in np.unique(widths).tolist():
        for at in np.array_split(np.flatnonzero(widths == width), max(1, len(widths) // 1024)):
            if len(at):
                yield at, unit(flat[starts[at][:, None] + np.arange(width)])


def projections(width: int, first: int, n: int) -> np.ndarray:
    """``width`` by ``n`` random directions, of set number ``first``; the same everywhere."""
    return np.random.default_rng([SEED, width, first]).standard_normal((width, n))


_POWERS = (1 << np.arange(63, -1, -1, dtype=np.uint64)).astype(np.uint64)


def _bits(rows: np.ndarray, width: int, number: int, n: int, held: dict) -> np.ndarray:
    """``n`` signs of each row as a long."""
    if (width, number) not in held:
        held[width, number] = projections(width, number, n)
    return ((rows @ held[width, number] > 0) * _POWERS[64 - n :]).sum(axis=1, dtype=np.uint64).view(np.int64)


def _hash_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, kind, key, vector`` of the first pass; the kind is the length."""
    held: dict = {}
    for batch in batches:
        for at, rows in _rows(batch.column(1)):
            width, of = rows.shape[1], pa.array(at)
            columns = [batch.column(0).take(of), pa.array(np.full(len(at), width, np.int64)), pa.array(_bits(rows, width, 0, BITS, held)), batch.column(1).take(of)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "kind", "key", "vector"])


def _hash_rest(n: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``node, kind, key, s1, s2, label`` of each further pass; the kind is the length and the pass."""
        held: dict = {}
        for batch in batches:
            for at, rows in _rows(batch.column(1)):
                width, of = rows.shape[1], pa.array(at)
                sketch = [pa.array(_bits(rows, width, -k % (1 << 32), 64, held)) for k in (1, 2)]
                for number in range(1, n):
                    kind = pa.array(np.full(len(at), (width << 16) | number, np.int64))
                    columns = [batch.column(0).take(of), kind, pa.array(_bits(rows, width, number, BITS, held)), *sketch, batch.column(2).take(of)]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "kind", "key", "s1", "s2", "label"])

    return hashed


def _blocks(hashed: DataFrame, window: int) -> DataFrame:
    """Rows in the order of their passes, in blocks; the first rows of each are lent to the one before."""
    placed = ranked(hashed, [F.col(c) for c in ("kind", "key", "node")], "place")
    block = F.floor(F.col("place") / BLOCK)
    lent = F.when((F.col("place") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    return placed.withColumn("own", block).withColumn("block", F.explode(lent)).withColumn("lent", F.col("block") != F.col("own")).drop("own")


def _neighbours(group: pd.DataFrame) -> pd.DataFrame:
    """What verified links between neighbours connect within a block, as links of each with one of them: chains of links are short."""
    group = group.sort_values("place")
    ids, own, kind = group["node"].to_numpy(), ~group["lent"].to_numpy(), group["kind"].to_numpy()
    vectors = group["vector"].to_numpy()
    root = np.arange(len(ids))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        rows = unit(np.stack(vectors[at]))
        for gap in range(1, min(NEIGHBOURS, len(at) - 1) + 1):
            near = np.flatnonzero((rows[:-gap] * rows[gap:]).sum(axis=1) >= THRESHOLD)
            for i in near[own[at[near]]]:
                x, y = find(at[i]), find(at[i + gap])
                if x != y:
                    root[max(x, y)] = min(x, y)
    top = np.array([find(x) for x in range(len(ids))], np.int64)
    some = top != np.arange(len(ids))
    return pd.DataFrame({"a": ids[top[some]], "b": ids[some]})


def _candidates(first: int | None):
    def candidates(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs that the signs make likely and no label joins; of each two labels the ``first`` nearest, and a row of nulls if there are more."""
        group = group.sort_values("place")
        nodes, own, kind = group["node"].to_numpy(), ~group["lent"].to_numpy(), group["kind"].to_numpy()
        label = group["label"].to_numpy()
        signs = [group[c].to_numpy().view(np.uint64) for c in ("key", "s1", "s2")]
        x, y, apart = [], [], []
        for gap in range(1, min(WINDOW, len(nodes) - 1) + 1):
            far = sum(np.bitwise_count(c[:-gap] ^ c[gap:]).astype(np.int16) for c in signs)
            at = np.flatnonzero((far <= DISTANCE) & (kind[:-gap] == kind[gap:]) & (label[:-gap] != label[gap:]) & own[:-gap])
            x.append(at)
            y.append(at + gap)
            apart.append(far[at])
        x, y, apart = (np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in (x, y, apart))
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        order = np.lexsort((apart, high, low))
        x, y, low, high = x[order], y[order], low[order], high[order]
        new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if len(x) else np.zeros(0, np.int64)
        rank = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
        kept = rank < first if first else np.ones(len(x), bool)
        a, b = np.minimum(nodes[x[kept]], nodes[y[kept]]), np.maximum(nodes[x[kept]], nodes[y[kept]])
        found = pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})
        return found if kept.all() else pd.concat([found, pd.DataFrame({"a": pd.array([None], "Int64"), "b": pd.array([None], "Int64")})])

    return candidates


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = np.zeros(batch.num_rows, bool)
        for at, left in _rows(batch.column(2)):
            of = pa.array(at)
            for some, right in _rows(batch.column(3).take(of)):
                near[at[some]] = (left[some] * right).sum(axis=1) >= THRESHOLD
        kept = batch.filter(pa.array(near))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])


def components(vectors: DataFrame, recall: float = RECALL) -> DataFrame:
    """``node, component`` of the linked rows of ``node, vector`` (distinct vectors, none zero), ``component`` being the smallest node."""
    n = vectors.count()
    kind = vectors.schema["vector"].dataType.simpleString()
    hashed = vectors.mapInArrow(_hash_first, f"node long, kind long, key long, vector {kind}")
    links = table(_blocks(hashed, NEIGHBOURS).groupBy("block").applyInPandas(_neighbours, "a long, b long"), "near")
    left, right = (vectors.select(F.col("node").alias(k), F.col("vector").alias(v)) for k, v in (("a", "va"), ("b", "vb")))

    def labelled(of: DataFrame, labels: DataFrame) -> DataFrame:
        found = table(labels.toDF("of", "component"), "labels")
        return of.drop("label").join(found, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("component", "node")).drop("of", "component")

    def verified(blocks: DataFrame, first: int | None) -> tuple[DataFrame, bool]:
        pairs = table(blocks.groupBy("block").applyInPandas(_candidates(first), "a long, b long").distinct(), "candidates")
        both = pairs.where("a is not null").join(left, "a").join(right, "b").select("a", "b", "va", "vb")
        return table(both.mapInArrow(_verify, "a long, b long"), "verified"), not pairs.where("a is null").isEmpty()

    # Labels that don't yet join all that is linked cost candidates, and lose none.
    rest = labelled(vectors, links.groupBy("b").agg(F.min("a"))).select("node", "vector", "label")
    rest = rest.mapInArrow(_hash_rest(passes(n, recall)), "node long, kind long, key long, s1 long, s2 long, label long")
    blocks = _blocks(rest, WINDOW)
    found, more = verified(blocks, FIRST)
    links = links.union(found)
    if more:
        links = links.union(verified(labelled(blocks, connected_components(links)), None)[0])
    return connected_components(links)


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        angle = np.zeros(batch.num_rows)
        for at, rows in _rows(batch.column(4)):  # of one length within a component
            of = pa.array(at)
            for some, pivots in _rows(batch.column(5).take(of)):
                angle[at[some]] = np.arccos(np.clip((rows[some] * pivots).sum(axis=1), -1, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(angle)], [*batch.schema.names[:5], "angle"])


def _square(group: pd.DataFrame) -> pd.DataFrame:
    """Links of the rows of one side with those of the other, counted for each row of the first, copies and all."""
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    if left.empty or right.empty:
        return pd.DataFrame({"node": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    near = unit(np.stack(left["vector"])) @ unit(np.stack(right["vector"])).T >= THRESHOLD
    near &= left["node"].to_numpy()[:, None] != right["node"].to_numpy()[None, :]
    return pd.DataFrame({"node": left["node"].to_numpy(), "n": near.astype(np.int64) @ right["n"].to_numpy(np.int64)})


def link_counts(vectors: DataFrame, components: DataFrame) -> DataFrame:
    """``node, others`` of all members of ``components``: rows of ``vectors`` (``node, n, least, vector``) linked to a node
    that are of other nodes, ``n`` for each, exact within each component."""
    found = components.withColumnRenamed("node", "of")
    members = table(vectors.join(found, F.col("node") == F.col("of")).select("node", "n", "least", "component", "vector"), "members")
    pivots = table(members.where("node = component").select(F.col("component").alias("of"), F.col("vector").alias("pivot")), "pivots")
    placed = members.join(pivots, F.col("component") == F.col("of")).select("node", "n", "least", "component", "vector", "pivot")
    kind = vectors.schema["vector"].dataType.simpleString()
    placed = table(placed.mapInArrow(_angles, f"node long, n long, least long, component long, vector {kind}, angle double"), "angles")
    wide = placed.groupBy("component").agg(F.sum("n").alias("rows"), (F.max("angle") * 2 <= ANGLE - SLACK).alias("tight"))
    wide = table(wide, "radii").withColumnRenamed("component", "of")
    joined = placed.join(wide, F.col("component") == F.col("of"))
    sure = joined.where("tight").select("node", (F.col("rows") - F.col("n")).alias("others"))
    rest = joined.where("not tight").withColumn("bin", F.floor(F.col("angle") / (ANGLE + SLACK)))
    rest = table(rest.select("node", "n", "component", "bin", "vector"), "wide")
    cells = rest.groupBy("component", "bin").agg(F.ceil(F.count(F.lit(1)) / SQUARE).alias("parts"))
    cells = table(cells, "cells")
    rest = rest.join(cells, ["component", "bin"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    across = rest.withColumn("bin2", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)))
    cells = cells.withColumnRenamed("bin", "bin2")
    across = across.join(cells, ["component", "bin2"]).withColumn("part2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    mine, other = F.struct("bin", "part"), F.struct(F.col("bin2").alias("bin"), F.col("part2").alias("part"))
    left = across.select("component", mine.alias("row"), other.alias("col"), F.lit(0).alias("side"), "node", "n", "vector")
    right = across.select("component", other.alias("row"), mine.alias("col"), F.lit(1).alias("side"), "node", "n", "vector")
    counted = left.union(right).groupBy("component", "row", "col").applyInPandas(_square, "node long, n long")
    return sure.union(counted.groupBy("node").agg(F.sum("n").alias("others")))


def near_duplicates(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with
    nothing; vectors of different lengths never link. ``component_id`` is the smallest id
    reachable, ``n_links`` how many other rows of the component lie within the
    threshold, ``kept`` whether the row has its component's smallest id. Rows that repeat
    an id are rows of their own. Null ids take part; they never are a ``component_id``, which is null where there
    is no other. An empty table gives no rows.
    """
    kind = frame.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    array = F.col(vector_col).cast("array<float>" if single else "array<double>")
    finite = F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = array.isNotNull() & (F.size(array) > 0) & finite & F.exists(array, lambda x: x != 0)
    key = F.when(good, F.struct(F.xxhash64(array).alias("h1"), F.xxhash64(F.lit(1), array).alias("h2")))
    rows = frame.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.when(good, array).alias("vector"))
    classes = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    classes = table(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # the numbers are those written
    found = cut(components(classes.select("node", "vector"), recall))
    counts = link_counts(classes, found).withColumnRenamed("node", "counted")
    named = classes.select("node", "key", "n", "least").join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = named.join(counts, F.col("node") == F.col("counted"), "left").withColumn("component", F.coalesce("component", "node"))
    named = table(named.select("key", "component", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    least = table(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = table(named.join(least, "component").select(F.col("key").alias("of"), "n_links", "component_id"), "classes")
    linked = rows.select("id", "key").join(named, F.col("key") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return linked.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN d ON a = vec_id
"""
