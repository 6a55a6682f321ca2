"""Removal of long repeated byte strings by bucket-pointer refinement of sampled suffixes.

A byte goes if a ``LENGTH``-byte string that covers it also starts anywhere else. Initial
buckets are those of the first 8 bytes of each suffix. The bucket of suffix i to depth 2h is
named by the pair of its bucket to depth h and that of suffix i + h, the one its pointer at that
offset leads to, from 8 bytes up to 128; buckets of other depths are pairs at a smaller
offset, so that the two parts overlap. A name is a pair of 64-bit mixes of the two names
(so 128 bits), equal wherever the pair is, so that no round of naming over all suffixes is needed.

The suffixes to sort are cut down first, without loss: in each window of ``LENGTH`` bytes
the suffix with the smallest bucket to depth ``Q`` is its anchor, chosen by content alone
(leftmost of ties), so equal windows have equal anchors at equal offsets. One suffix in
about fifty is an anchor. What lies around it are at most ``Q + 1`` windows, by how many
bytes the window starts before the anchor. Anchors are sorted into buckets to depth ``Q``, and
those alone in theirs are done. The others are refined in blocks of neighbouring windows,
101 to 13 to 1, by two buckets each: that of the *core*, the bytes that all windows of
the block share, and that of the *cover*, all bytes of the block. A block whose core is
alone in its bucket holds no repeat and is dropped; one whose cover is in a bucket with
others is repeated whole; the rest are split. The blocks that are settled as repeated stay
on as witnesses, one for each cover, since others may match a part of them. A bucket that
a third of all suffixes share is counted by partial aggregation, and joins with what was counted
can be split by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import drop_table, same_row, table, text_hash

LENGTH = 200
Q = 100
#: Windows of LENGTH bytes that hold the q-gram at one place.
REACH = LENGTH - Q
#: Neighbouring windows in a block of the second level.
BLOCK = 13
#: The depth that names of other depths are put together from.
DEPTH = 128
#: Suffixes that are named at once: small enough for the caches, whatever the length of a text.
SEGMENT = 1 << 15
#: Rows gathered before they are passed on.
BATCH = 1 << 18

_POSITION_BITS = 21
_u = np.uint64
#: Odd multipliers of the two halves of a name.
_LANES = (
    (_u(0x9E3779B97F4A7C15), _u(0xBF58476D1CE4E5B9), _u(0x94D049BB133111EB)),
    (_u(0xD6E8FEB86659FD93), _u(0xA0761D6478BD642F), _u(0xE7037ED1A0B428DB)),
)


def _pair(x: np.ndarray, y: np.ndarray, lane: int) -> np.ndarray:
    """Half of the names of pairs; one to one in either part."""
    a, b, c = _LANES[lane]
    h = x * a
    h ^= h >> _u(32)
    h += y
    h *= b
    h ^= h >> _u(29)
    h *= c
    h ^= h >> _u(32)
    return h


def _buckets(raw: np.ndarray, depth: int, lane: int) -> np.ndarray:
    """Half of the bucket of each suffix to ``depth``, a power of two from 8 on. ``raw`` holds bytes, at least ``depth`` of them."""
    found = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,)).copy()
    h = 8
    while h < depth:
        found = _pair(found[:-h], found[h:], lane)
        h *= 2
    return found


def _spans(deep: np.ndarray, starts: np.ndarray, lengths, lane: int) -> np.ndarray:
    """Half of the names of strings of ``DEPTH`` to 3 * DEPTH bytes from the buckets that their bytes are covered by."""
    lengths = np.asarray(lengths)
    ends = starts + lengths - DEPTH
    middle = _pair(deep[starts], deep[starts + (lengths - DEPTH) // 2], lane)
    return _pair(middle, deep[ends] + lengths.astype(np.uint64), lane)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings or binaries, nulls being empty, and where each begins, with the end."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), places


def anchors(raw: np.ndarray, places: np.ndarray, covers: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """For the anchors of each segment: bucket, two halves of the name of all bytes it stands for, number of the
    text, place in it, and how far before it the last and the first of its windows start. ``places`` are the bounds of texts in ``raw``."""
    end = int(places[-1])
    for at in range(int(places[0]), end - LENGTH + 1, SEGMENT):
        part = raw[at : min(at + SEGMENT + LENGTH - 1, end)]
        n = len(part) - LENGTH + 1
        texts = np.arange(max(0, np.searchsorted(places, at, "right") - 1), np.searchsorted(places, at + n, "left"))
        texts = texts[places[texts + 1] - places[texts] >= LENGTH]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.clip(places[texts] - at, 0, n), 1)
        np.add.at(edge, np.clip(places[texts + 1] - LENGTH + 1 - at, 0, n), -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]))  # windows within one text
        if not len(starts):
            continue
        half = _buckets(part, 64, 0)
        gram = _pair(half[: -(Q - 64)], half[Q - 64 :], 0)
        least = (gram >> _u(_POSITION_BITS) << _u(_POSITION_BITS)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        place = (least[starts] & _u((1 << _POSITION_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))  # another text has other places
        last = np.append(first[1:], len(place)) - 1
        where, begin, stop = place[first], starts[first], starts[last]
        text = np.searchsorted(places, begin + at, "right") - 1
        names = [np.zeros(0, np.uint64)] * 2
        if covers:
            deep = _pair(half[:-64], half[64:], 0), _buckets(part, DEPTH, 1)
            names = [_spans(deep[lane], begin, stop - begin + LENGTH, lane) for lane in (0, 1)]
        yield gram[where], *names, text, where + at - places[text], where - stop, where - begin


ROW = "k1 long, k2 long, c1 long, c2 long, doc long, th long, at int, lo int, hi int, witness boolean"
_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("k1", "k2", "c1", "c2", "doc", "th")] + [(c, pa.int32()) for c in ("at", "lo", "hi")] + [("witness", pa.bool_())]
)


class _Out:
    """Gathers rows of ROW and passes them on in large batches."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.n = 0

    def add(self, k1, k2, c1, c2, doc, th, at, lo, hi, witness) -> None:
        longs = [pa.array(np.asarray(x).view(np.int64)) for x in (k1, k2, c1, c2)]
        ints = [pa.array(np.asarray(x).astype(np.int32)) for x in (at, lo, hi)]
        self.parts.append(pa.RecordBatch.from_arrays([*longs, doc, th, *ints, witness], schema=_SCHEMA))
        self.n += len(longs[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from pa.Table.from_batches(self.parts).combine_chunks().to_batches()
        self.parts, self.n = [], 0


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket of each anchor only."""
    for batch in batches:
        for gram, *_ in anchors(*_flat(batch.column(0)), covers=False):
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["k1"])


def _first_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor: its bucket to depth ``Q``, and the name of all it stands for."""
    out = _Out()
    for batch in batches:
        for gram, c1, c2, text, at, lo, hi in anchors(*_flat(batch.column(2))):
            row = pa.array(text)
            out.add(gram, np.zeros(len(gram), np.int64), c1, c2, batch.column(0).take(row), batch.column(1).take(row), at, lo, hi, pa.array(np.zeros(len(gram), bool)))
            if out.n >= BATCH:
                yield from out.flush()
    yield from out.flush()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each open anchor, cut from its text."""
    for batch in batches:
        raw, begins = _flat(batch.column(2))
        data, lists = raw.tobytes(), batch.column(3)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        found = lists.flatten()
        at, lo, hi, witness = (found.field(c) for c in ("at", "lo", "hi", "witness"))
        row = np.repeat(np.arange(batch.num_rows), counts)
        place = begins[row] + at.to_numpy()
        starts, ends = (place - hi.to_numpy()).tolist(), (place - lo.to_numpy() + LENGTH).tolist()
        for i in range(0, len(row), BATCH // 8):
            part, of = slice(i, i + BATCH // 8), pa.array(row[i : i + BATCH // 8])
            cut = pa.array([data[s:e] for s, e in zip(starts[part], ends[part])], pa.binary())
            columns = [batch.column(0).take(of), batch.column(1).take(of), *(c[part] for c in (at, lo, hi, witness)), cut]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "th", "at", "lo", "hi", "witness", "bytes"])


def _split(width: int):
    """Splits the windows of each row at multiples of ``width`` before the anchor, each block with its buckets."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out()
        for batch in (b.slice(i, SEGMENT // 256) for b in batches for i in range(0, b.num_rows, SEGMENT // 256)):
            at, lo, hi = (batch.column(i).to_numpy() for i in (2, 3, 4))
            raw, begins = _flat(batch.column(6))
            raw = raw[begins[0] : begins[-1]]
            begins = begins - begins[0]
            deep = _buckets(raw, DEPTH, 0), _buckets(raw, DEPTH, 1)
            n = hi // width - lo // width + 1
            row = np.repeat(np.arange(len(n)), n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (lo // width)[row]
            low, high = np.maximum(number * width, lo[row]), np.minimum(number * width + width - 1, hi[row])
            start = begins[row] + hi[row]  # the anchor
            c1, c2 = (_spans(deep[lane], start - high, high - low + LENGTH, lane) for lane in (0, 1))
            # The core is that of the whole block, as others may own other windows of it; it lies within each window.
            k1, k2 = (c1, c2) if width == 1 else (_spans(deep[lane], start - number * width, np.full(len(row), LENGTH - width + 1), lane) for lane in (0, 1))
            of = pa.array(row)
            out.add(k1, k2, c1, c2, batch.column(0).take(of), batch.column(1).take(of), at[row], low, high, batch.column(5).take(of))
            if out.n >= BATCH:
                yield from out.flush()
        yield from out.flush()

    return split


def _refine(rows: DataFrame, name: str, leaf: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Settles the rows whose cover is repeated. Returns the runs they cover, what stays open with its witnesses, and the table behind both."""
    cover = rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "at")).alias("first")).where("n > 1")
    cover = table(cover, f"{name}-covers")  # so that the join has exchanges of its own, which it can split where a cover is hot
    marked = rows.join(cover, ["c1", "c2"], "left").select(
        "k1", "k2", "doc", "th", "at", "lo", "hi", "witness", F.col("n").isNotNull().alias("settled"),
        F.coalesce(F.struct("doc", "th", "at").eqNullSafe(F.col("first")), F.lit(False)).alias("is_first"),
    )
    marked = table(marked, name)
    runs = marked.where("settled and not witness").select("doc", "th", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + LENGTH).alias("end"))
    if leaf:
        return runs, None, marked
    alive = marked.where("not settled or witness or is_first").withColumn("aside", F.expr("settled or witness"))
    cores = alive.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("aside").alias("all_aside")).where("n > 1 and not all_aside")
    still = alive.join(table(cores.select("k1", "k2"), f"{name}-cores"), ["k1", "k2"], "left_semi")
    return runs, still.select("doc", "th", "at", "lo", "hi", F.col("aside").alias("witness")), marked


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``doc, th, start, end``: overlapping byte runs to remove. ``docs`` has ``doc, th, text``; ``th`` tells texts of one id apart."""
    shared = docs.select("text").mapInArrow(_first_keys, "k1 long").groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1")
    shared = table(shared, "grams")
    first = docs.mapInArrow(_first_buckets, ROW).join(shared, "k1", "left_semi").select(*[c.split()[0] for c in ROW.split(", ")])
    first = table(first, "buckets")
    runs, still, _ = _refine(first, "level0")
    places = table(still.groupBy("doc", "th").agg(F.collect_set(F.struct("at", "lo", "hi", "witness")).alias("places")), "places")
    around = docs.join(places, same_row(docs, places)).select(docs["doc"], docs["th"], "text", "places")
    around = around.mapInArrow(_contexts, "doc long, th long, at int, lo int, hi int, witness boolean, bytes binary")
    around = table(around, "contexts")
    drop_table(first)
    blocks = table(around.mapInArrow(_split(BLOCK), ROW), "blocks")
    more, still, _ = _refine(blocks, "level1")
    still = table(still.distinct(), "open")
    text = around.select("doc", "th", "at", F.col("lo").alias("from"), F.col("hi").alias("to"), "bytes").dropDuplicates(["doc", "th", "at", "from", "to"])
    inside = (still["at"] == text["at"]) & (still["lo"] >= text["from"]) & (still["hi"] <= text["to"])
    cut = F.expr(f"substring(bytes, to - hi + 1, hi - lo + {LENGTH})")
    leaves = still.join(text, same_row(still, text) & inside).select(still["doc"], still["th"], still["at"], "lo", "hi", "witness", cut.alias("bytes"))
    leaves = table(leaves.mapInArrow(_split(1), ROW), "windows")
    drop_table(blocks)
    last, _, _ = _refine(leaves, "level2", leaf=True)
    return runs.union(more).union(last)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ones."""
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data, spans = (text or "").encode("utf-8", "surrogatepass"), merged([(r["start"], r["end"]) for r in runs or ()])
            digest, at = hashlib.sha256(), 0
            for start, end in [*spans, (len(data), len(data))]:
                digest.update(memoryview(data)[at:start])
                at = end
            rows.append((doc, len(data), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), spans]
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    ``spans`` are the maximal removed byte runs (start, end) of the UTF-8 text, in order.
    Strings are judged on the input, across and within all rows, overlaps counting; never
    across texts. Null and empty texts have no bytes, and texts under ``LENGTH`` bytes lose
    none. Of equal rows every copy loses what it shares, ids alike or not. A null id is an
    id like any other. Only the columns named are read.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_hash(text).alias("th"), text.alias("text"))
    runs = repeated_runs(rows).groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    runs = table(runs, "runs")
    found = rows.join(runs, same_row(rows, runs), "left").select(rows["doc"], "text", "runs")
    found = found.mapInArrow(_kept, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start int, end int>>")
    return found.withColumnRenamed("doc", id_col)
