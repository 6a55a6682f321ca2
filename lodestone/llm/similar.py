"""Near-duplicates by the Jaccard similarity of word shingles, behind ``simhash.keep_one``.

Keys only nominate. The first of a shingle set is that of its SimHash: ``simhash.with_balls``
gives one key to all fingerprints that balls connect. At a similarity of 0.8 a pair is expected to
differ in 10 of 64 bits, far beyond the balls that can be emitted, so band keys of min-hashes
nominate the rest: a pair shares none of the ``BANDS`` keys with a probability of about 3 in
100,000. Nominated pairs are verified on their whole shingle sets. Each key's members are first
compared with its least one; then members that this has not connected are compared in squares of
``SQUARE``, which return only as many links as connect them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import table, text_hash
from lodestone.llm.components import connected_components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
SQUARE = 256
#: Shingles whose bits are counted at once: bounds memory for very long texts.
CHUNK = 1 << 16
_DRAWN = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_FLIPS, _FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted, distinct hashes of all runs of ``WORDS`` lower-cased words; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = (b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64))


def majority(found: np.ndarray) -> int:
    """The SimHash of distinct shingle hashes, signed: a bit is 1 if it is set in over half of them; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        part = found[at : at + CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big", signed=True)


def band_keys(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    least = np.array([((found ^ r) * a).min() for r, a in zip(_FLIPS, _FACTORS)], np.uint64).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(least)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x.as_py()) for x in batch.column(2)]
        kinds = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
        fps = pa.array([majority(x) for x in sets], pa.int64())
        columns = [pa.array(kinds, pa.int64()), fps, pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "th", "kind", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["kind", "found"])


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _verifier(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [_alike(x.values.to_numpy(), y.values.to_numpy(), similarity) for x, y in zip(batch.column(2), batch.column(3))]
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return verify


def _square(similarity: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Links of the members of a square that aren't connected already, as few as connect them."""
        kinds, sets = group["kind"].to_numpy(), [np.asarray(x) for x in group["found"]]
        _, root = np.unique(group["of"].to_numpy(), return_inverse=True)
        a, b = [], []
        for i in range(len(kinds)):
            for j in range(i):
                if root[i] != root[j] and _alike(sets[i], sets[j], similarity):
                    root[root == root[j]] = root[i]
                    a.append(kinds[i])
                    b.append(kinds[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return compare


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, kind, fp, keys`` of every row: its id, and its text's hash, shingle set (a hash of it), SimHash and band keys."""
    source = _source(docs, id_col, text_col)
    return table(source.mapInArrow(_keyed, "id long, th long, kind long, fp long, keys array<long>"), "keyed")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """``kind, th, fp, keys`` once for each shingle set; ``th`` is that of one text that has it."""
    least = rows.groupBy("kind").agg(F.min(F.struct("th", "fp", "keys")).alias("r"))
    return table(least.select("kind", "r.th", "r.fp", "r.keys"), "shingle-sets")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text).alias("th"), text.alias("text"))


def links(docs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: links of distinct shingle sets that connect all nominated pairs at ``similarity``.

    ``docs`` has ``th, text``; ``sets`` has ``kind, th, keys``, and those that share a key are nominated.
    """
    classes = sets.select("kind", "th", F.explode("keys").alias("key"))
    shared = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("least")).where("n > 1")
    members = table(classes.join(table(shared, "shared"), "key").select("key", "kind", "th", "least", "n"), "members")
    wanted = table(members.select("kind", F.col("th").alias("of")).distinct(), "wanted")
    texts = docs.join(wanted, F.col("th") == F.col("of")).select("kind", "text").dropDuplicates(["kind"])
    found_sets = table(texts.mapInArrow(_sets, "kind long, found array<long>"), "sets")
    left, right = (found_sets.select(F.col("kind").alias(k), F.col("found").alias(f)) for k, f in (("a", "fa"), ("b", "fb")))
    stars = table(members.where("kind <> least").select(F.col("least").alias("a"), F.col("kind").alias("b")).distinct(), "stars")
    stars = stars.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(_verifier(similarity), "a long, b long")
    stars = table(stars, "star-links")
    found = connected_components(stars)
    placed = members.join(found, F.col("kind") == F.col("node"), "left").select("key", "kind", "n", F.coalesce("component", "kind").alias("of"))
    placed = table(placed, "placed")
    mixed = table(placed.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi").select("key"), "mixed")
    parts = F.ceil(F.col("n") / SQUARE).cast("int")
    dealt = placed.join(mixed, "key").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("kind"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("row"), F.greatest("mine", "other").alias("col"), "kind", "of")
    rest = dealt.join(found_sets, "kind").groupBy("key", "row", "col").applyInPandas(_square(similarity), "a long, b long")
    return stars.union(rest)


def classes(docs: DataFrame, rows: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, th, root`` of every row: its id, its text's hash and its group, which all linked rows share.

    Groups are connected by nominated pairs of a Jaccard similarity of ``similarity`` or more. ``rows`` are those of
    ``keyed``, ``sets`` those of ``distinct_sets``, with further keys or not. Null, empty and blank texts are one group.
    Rows are told apart by id and text.
    """
    groups = connected_components(links(_source(docs, id_col, text_col), sets, similarity))
    return rows.join(groups, F.col("kind") == F.col("node"), "left").select(F.col("id").alias("doc"), "th", F.coalesce("component", "kind").alias("root"))
