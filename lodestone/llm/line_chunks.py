"""Line deduplication on content-defined chunks of lines.

A text is cut after line i where a rolling hash over the hashes of lines i-1 and i is
divisible by ``DIVISOR``, so an inserted or missing line moves no boundary but those next
to it. Of each chunk of several lines that occurs more than once, over all texts, the
first occurrence (by id, then place) stays. Equal 128-bit digests only nominate: the bytes
of all nominated chunks are compared, and should two differ under one digest they are told
apart by their bytes.

A chunk that a passage shares with foreign lines is lost to that rule, whatever the passage's
length. ``dedup_passages`` judges by content alone: its units are all windows of two
consecutive non-blank lines and all single lines of ``LONG_WORDS`` words or ``LONG_CHARS``
characters. The windows of a run overlap, so a repeated run goes from its first to its
last line, wherever it begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._shared import fresh, table

DIVISOR = 4
#: Non-blank lines that a chunk must have to be removable.
MIN_LINES = 2
#: A single line of so many words, or (for scripts without spaces) characters, is a passage.
LONG_WORDS, LONG_CHARS = 50, 250
_MASK = (1 << 64) - 1


def chunks(text: str | None) -> list[list[str]]:
    """The lines of a text in chunks; joined again by newlines they are the text. None for null."""
    if text is None:
        return []
    out, now, before = [], [], 0
    for line in text.split("\n"):
        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        now.append(line)
        rolled = ((before * 0x9E3779B97F4A7C15 + h) & _MASK) >> 40
        before = h
        if rolled % DIVISOR == 0:
            out.append(now)
            now = []
    return out + [now] if now else out


def _blank(line: str) -> bool:
    return not line or line.isspace()


def _removable(lines: list[str]) -> bool:
    return sum(not _blank(x) for x in lines) >= MIN_LINES


def _chunk_spans(text: str | None) -> list[tuple[int, int, bool]]:
    """First line, line after the last, and whether it may go, of each chunk."""
    out, at = [], 0
    for lines in chunks(text):
        out.append((at, at + len(lines), _removable(lines)))
        at += len(lines)
    return out


def _long(line: str) -> bool:
    return len(line) >= LONG_CHARS or (len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS)


def _passage_spans(text: str | None) -> list[tuple[int, int, bool]]:
    """As ``_chunk_spans``, of all windows of two non-blank lines (blank ones between them included) and all long lines, in order."""
    if text is None:
        return []
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if not _blank(x)]
    return sorted([(i, j + 1, True) for i, j in zip(full, full[1:])] + [(i, i + 1, True) for i in full if _long(lines[i])])


Spans = Callable[[str | None], list[tuple[int, int, bool]]]


def _digest(lines: list[str]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest("\n".join(lines).encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _nominator(spans: Spans):
    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
        for batch in batches:
            rows = []
            for doc, th, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = (text or "").split("\n")
                rows += [(doc, th, no, *_digest(lines[start:end])) for no, (start, end, may_go) in enumerate(spans(text)) if may_go]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return nominate


def _reader(spans: Spans):
    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("is_first", pa.bool_()), ("body", pa.string())])
        for batch in batches:
            rows = []
            for doc, th, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines, parts = (text or "").split("\n"), spans(text)
                rows += [(doc, th, w["no"], w["h1"], w["h2"], w["is_first"], "\n".join(lines[slice(*parts[w["no"]][:2])])) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    return bodies


def _rewriter(spans: Spans, text_at: int, gone_at: int, stat_names: list[str]):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stats = [], []
            for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(gone_at).to_pylist()):
                parts, gone = spans(text), set(gone or ())
                lines = [] if text is None else text.split("\n")
                lost = {i for no in gone for i in range(*parts[no][:2])}
                kept = [x for i, x in enumerate(lines) if i not in lost]
                if lost and spans is _passage_spans and all(map(_blank, kept)):
                    kept = []
                texts.append(text if not gone else "\n".join(kept))
                stats.append((len(lines), len(lines) - len(kept), len(parts), len(gone)))
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != gone_at]
            names = [f.name for i, f in enumerate(batch.schema) if i != gone_at]
            columns += [pa.array(c, pa.int64()) for c in (zip(*stats) if stats else [[]] * 4)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *stat_names])

    return rewrite


STATS = ("n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks")


def removals(docs: DataFrame, spans: Spans = _chunk_spans) -> DataFrame:
    """``doc, th, gone``: the numbers of the spans that each text of ``docs`` (``doc, th, text``) loses."""
    spark = docs.sparkSession
    place = F.struct("doc", "th", "no")
    named = table(docs.mapInArrow(_nominator(spans), "doc long, th long, no int, h1 long, h2 long"), "chunks")
    repeated = named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = table(repeated, "digests")  # so that the join has exchanges of its own, which it can split where a digest is hot
    many = table(named.join(repeated, ["h1", "h2"]).select("doc", "th", "no", "h1", "h2", F.col("first").eqNullSafe(place).alias("is_first")), "repeated")
    wanted = many.groupBy("doc", "th").agg(F.collect_set(F.struct("no", "h1", "h2", "is_first")).alias("wanted"))
    on = docs["doc"].eqNullSafe(wanted["doc"]) & (docs["th"] == wanted["th"])
    bodies = docs.hint("merge").join(wanted, on).select(docs["doc"], docs["th"], "text", "wanted")
    bodies = table(bodies.mapInArrow(_reader(spans), "doc long, th long, no int, h1 long, h2 long, is_first boolean, body string"), "bodies")
    firsts = bodies.where("is_first").groupBy("h1", "h2").agg(F.min("body").alias("first_body"))
    firsts = table(firsts, "firsts")  # the join with it can be split where a digest is hot
    differ = table(bodies.join(firsts, ["h1", "h2"]).where("body <> first_body").select("h1", "h2"), "differ")
    gone = many.where("not is_first").join(differ, ["h1", "h2"], "left_anti").select("doc", "th", "no")
    if not differ.isEmpty():  # two texts under one digest: told apart by their bytes
        apart = table(bodies.join(differ, ["h1", "h2"], "left_semi"), "apart")
        first = apart.groupBy("h1", "h2", "body").agg(F.min(place).alias("first"))
        apart = apart.join(first, ["h1", "h2", "body"])
        gone = gone.union(apart.where(~F.col("first").eqNullSafe(place)).select("doc", "th", "no"))
    return table(gone.groupBy("doc", "th").agg(F.collect_set("no").alias("gone")), "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks removed from ``text_col``, and four counts added:
    ``n_lines, n_removed_lines, n_chunks, n_removed_chunks`` (lengthened by ``_`` where a column has the name).

    Every row and column stays. Null texts stay null with counts of zero; a text all of
    whose chunks occur earlier becomes empty; one-line and blank chunks are never removed.
    Of equal rows under different ids the smallest id keeps its text, null ids before all;
    rows equal in id and text are one occurrence and lose or keep the same.
    """
    return _dedup(docs, id_col, text_col, _chunk_spans)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``dedup_lines``, with the windows of ``_passage_spans`` for chunks, in the counts as well.

    A line goes if it lies in a window that occurs earlier. Each line that goes has an equal
    one that stays: the first occurrence of a line is in no later window. A shorter line
    that is repeated without either neighbour stays, and a text left with blank lines only
    becomes empty.
    """
    return _dedup(docs, id_col, text_col, _passage_spans)


def _dedup(docs: DataFrame, id_col: str, text_col: str, spans: Spans) -> DataFrame:
    th, gone_col = fresh(docs, "text_hash"), fresh(docs, "gone_chunks")
    text = F.col(text_col).cast("string")
    gone = removals(docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")), spans)
    own = docs.withColumn(th, F.xxhash64(text))
    gone = gone.select(F.col("doc").alias("gone_doc"), F.col("th").alias("gone_th"), F.col("gone").alias("gone_list"))
    found = own.hint("merge").join(gone, own[id_col].cast("long").eqNullSafe(gone["gone_doc"]) & (own[th] == gone["gone_th"]), "left")
    found = found.select(*[own[c] for c in docs.columns], gone["gone_list"].alias(gone_col))
    names = [fresh(docs, c) for c in STATS]
    fields = [T.StructField(text_col, T.StringType()) if f.name == text_col else f for f in docs.schema.fields]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in names]])
    out = found.mapInArrow(_rewriter(spans, docs.columns.index(text_col), len(docs.columns), names), schema)
    return out

