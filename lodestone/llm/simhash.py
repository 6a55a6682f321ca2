"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at Hamming distance 3 or less must meet. Half of that radius is 1.5: balls
of radius 1 on both sides only guarantee distance 2, and a ball of radius 2 has 2,081
variants a fingerprint. So one of three bit blocks (22, 21 and 21 bits) is left out in
turn. Two fingerprints that differ in 1 to 3 bits differ in at most 2 outside one of the
blocks, so their radius-1 balls over the remaining 42 or 43 bits share a variant: 131
variants a fingerprint, none lost. Rows that share a variant are verified on all 64 bits.

``keep_one`` takes a similarity of shingle sets as well: the balls then nominate pairs, the sets
decide, and what lies beyond the balls is nominated as ``similar`` says.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import similar
from lodestone.llm._shared import cut, keep_first, table, text_hash
from lodestone.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Shingles whose bits are counted at once: bounds memory for very long texts.
CHUNK = 1 << 16
#: Fingerprints under one variant that a task compares; more are dealt out in squares of so many.
GROUP = 1 << 14
#: (number of low bits kept below the block, width of the block)
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one text, unsigned; zero for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    firsts, lasts = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(firsts[at : at + CHUNK], lasts[at : at + CHUNK])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(2)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc", "th", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, th, fp`` (id, text hash, signed 64 bits) of every row; the whole text counts."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_hash(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(_fingerprints, "doc long, th long, fp long")


def _variants(fp: Column) -> Column:
    """All variants of the three balls as longs: the block's number above its remaining bits."""
    keys = []
    for number, (low, width) in enumerate(BLOCKS):
        upper = F.shiftrightunsigned(fp, low + width) if low + width < 64 else F.lit(0).cast("long")
        rest = upper if not low else F.shiftleft(upper, low).bitwiseOR(fp.bitwiseAND(F.lit((1 << low) - 1)))
        base = rest.bitwiseOR(F.lit(number << 60))
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(64 - width)])
        keys.append((base, flips))
    return F.concat(*[F.transform(flips, _flipper(base)) for base, flips in keys])


def _flipper(base: Column):
    return lambda flip: base.bitwiseXOR(flip)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed 64-bit values; unsigned, as the bits of a signed one are counted on its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what is connected among distinct ``values`` at ``radius`` bits, one fewer than members.

    Each member is compared once with those not yet reached, so a dense group costs
    little more than its size.
    """
    left, links = values, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = distances(left, x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
    return links


def _links(batches: Iterator[pa.RecordBatch], limit: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group that a batch ends in is carried to the next.

    A group beyond ``limit`` isn't gathered: its key is returned with a null partner.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    hot: int | None = None

    def resolve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        pairs = starts[sizes == 2]
        a, b = fps[pairs], fps[pairs + 1]
        near = (distances(a, b) <= RADIUS) & (a != b)
        a, b = [a[near]], [b[near]]
        large = starts[sizes > limit]
        for start, size in zip(starts[(sizes > 2) & (sizes <= limit)], sizes[(sizes > 2) & (sizes <= limit)]):
            links = spanning_links(np.unique(fps[start : start + size]))
            a.append(np.array([x for x, _ in links], np.int64))
            b.append(np.array([y for _, y in links], np.int64))
        a, b = np.concatenate([*a, keys[large]]), np.concatenate([*b, np.zeros(len(large), np.int64)])
        partner = pa.array(b, pa.int64(), mask=np.arange(len(b)) >= len(b) - len(large))
        return pa.RecordBatch.from_arrays([pa.array(a), partner], schema=schema)

    pending: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if hot is not None:
            keys, fps = keys[keys != hot], fps[keys != hot]
        if not len(keys):
            continue
        hot = None
        pending.append((keys, fps))
        if keys[-1] == pending[0][0][0]:  # one group so far
            if sum(len(k) for k, _ in pending) > limit:
                hot, pending = int(keys[-1]), []
                yield pa.RecordBatch.from_arrays([pa.array([hot], pa.int64()), pa.array([None], pa.int64())], schema=schema)
            continue
        keys, fps = (np.concatenate([p[i] for p in pending]) for i in (0, 1))
        last = int(np.searchsorted(keys, keys[-1], "left"))
        pending = [(keys[last:], fps[last:])]
        yield resolve(keys[:last], fps[:last])
    if pending:
        yield resolve(*(np.concatenate([p[i] for p in pending]) for i in (0, 1)))


def _square(group: pd.DataFrame) -> pd.DataFrame:
    links = spanning_links(np.unique(group["fp"].to_numpy(np.int64)))
    return pd.DataFrame({"a": np.array([x for x, _ in links], np.int64), "b": np.array([y for _, y in links], np.int64)})


def links(distinct_fps: DataFrame, limit: int = GROUP) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all within the radius.

    Fingerprints that share a variant are compared by one task, beyond ``limit`` by one a square.
    """
    keyed = distinct_fps.select(F.explode(_variants(F.col("fp"))).alias("key"), "fp")
    found = table(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_links, limit=limit), "a long, b long"), "links")
    some = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("key"))
    if hot.isEmpty():
        return some
    crowded = keyed.join(table(hot.distinct(), "crowded"), "key")
    sizes = table(crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (limit // 2)).cast("int").alias("parts")), "parts")
    dealt = crowded.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"), "fp")
    return some.union(dealt.groupBy("key", "row", "col").applyInPandas(_square, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id, kept``.

    ``component_id`` is the smallest id whose fingerprint is reachable by links of at
    most ``RADIUS`` bits, the row itself included; ``kept`` marks the row that stays.
    Equal fingerprints are one class before any variant is made, so thousands of copies
    cost one. Null and blank texts have fingerprint zero and link like any other. Null
    ids take part, never become a ``component_id`` (null if a class has no other), and
    aren't kept unless so. Rows that share an id are rows of their own. Empty tables give no rows.
    """
    rows, labels = _labelled(docs, id_col, text_col)
    return rows.join(labels, "fp").select(
        F.col("doc").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc, th, fp`` of all rows, and ``fp, root, component_id`` of all fingerprints."""
    rows = cut(fingerprints(docs, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc").alias("least")))
    linked = connected_components(links(classes.select("fp")))
    roots = classes.join(linked, classes.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = table(roots.groupBy("root").agg(F.min("least").alias("component_id")), "roots")  # so that the join has exchanges of its own
    return rows, roots.join(least, "root").select("fp", "root", "component_id")


def with_balls(sets: DataFrame) -> DataFrame:
    """``sets`` (with ``fp, keys``) with one key more, which all fingerprints share that links within the radius connect."""
    groups = connected_components(links(sets.select("fp").distinct()))
    key = F.xxhash64(F.coalesce("component", "fp"))
    found = sets.join(groups, F.col("fp") == F.col("node"), "left").withColumn("keys", F.concat(F.array(key), "keys"))
    return table(found.select(*sets.columns), "nominated")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each class left, all its columns unchanged.

    The smallest id stays, of equal ids the smallest text hash, null ids only where a class
    has no other; of rows equal in id and text one stays. Rows are told apart by id and
    text, so no row goes for sharing an id, null or not, with another. Null, empty and blank texts
    are one class; an empty table stays empty.

    Classes are those of ``near_duplicates``, or with ``similarity`` connected by pairs whose
    sets of five-word shingles have that Jaccard similarity or more. Pairs to verify come from
    the balls over the SimHashes of those sets, and beyond the radius from bands of min-hashes.
    """
    if similarity is None:
        rows, labels = _labelled(docs, id_col, text_col)
        placed = rows.join(labels.select("fp", "root"), "fp").select("doc", "th", "root")
    else:
        rows = similar.keyed(docs, id_col, text_col)
        sets = with_balls(similar.distinct_sets(rows))
        placed = similar.classes(docs, rows, sets, similarity, id_col, text_col)
    placed = table(placed, "placed")
    order = F.struct(F.col("doc").isNull(), "doc", "th")
    first = table(placed.groupBy("root").agg(F.min(order).alias("first")), "firsts")
    return keep_first(docs, placed.join(first, "root").select("doc", "th", (order == F.col("first")).alias("keep")), id_col, text_col)
