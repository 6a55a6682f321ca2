"""Language identification by words first, then by shorter and shorter character n-grams.

A word that training has seen is scored by its log frequency in each language. An unseen
one falls back to its n-grams (with word boundaries) of the longest length of which any
is known, each scored likewise. The tables are fitted on a sample of about ``PER_LANGUAGE``
labelled documents a language, drawn by the hash of their ids, and keep every word and
n-gram of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import table

PER_LANGUAGE = 2500
LENGTHS = (4, 3, 2, 1)
SMOOTHING = 0.5
#: Words beyond which more evidence no longer raises the score.
FULL_EVIDENCE = 12
UNDETERMINED = "und"
#: Unseen words whose scores a task keeps at hand.
CACHE = 1 << 18
WORD = regex.compile(r"\p{L}+")
_WORDLIKE = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters of a text."""
    found = _WORDLIKE.findall((text or "").lower())
    return found if all(map(str.isalpha, found)) else [w for x in found for w in WORD.findall(x)]


@dataclass
class Tables:
    """Rows of ``scores``, one for each known term, hold its centred log score in each language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    scores: np.ndarray
    #: Words met so far and their rows of ``table``: those of ``scores``, then what others were found to have.
    place: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def _take_in(self, words: set[str]) -> None:
        """Words get their scores: a known one its own, another the mean of its known n-grams of the longest length that has any, or zeros."""
        if self.table is None or len(self.place) > len(self.words) + CACHE:
            self.place, self.table = dict(self.words), self.scores
        new = list(words.difference(self.place))
        if not new:
            return
        rows, counts = [], []
        for word in new:
            for n in LENGTHS:
                known = self.grams[n]
                found = [known[g] for g in grams(word, n) if g in known]
                if found:
                    break
            rows += found
            counts.append(len(found))
        counts, sums = np.array(counts), np.zeros((len(new), len(self.languages)))
        np.add.at(sums, np.repeat(np.arange(len(new)), counts), self.scores[rows])
        self.place.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.concatenate([self.table, sums / np.maximum(counts, 1)[:, None]])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text: the mean over its words, as much as ``FULL_EVIDENCE`` words at most count."""
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        found = [words_of(t) for t in texts]
        full = [i for i, w in enumerate(found) if w] if self.languages else []
        if not full:
            return langs, scores
        every = [w for i in full for w in found[i]]
        self._take_in(set(every))
        picked = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        lengths = np.array([len(found[i]) for i in full])
        sums = np.add.reduceat(self.table[picked], np.cumsum(lengths) - lengths, axis=0)
        mean = sums * (np.minimum(lengths, FULL_EVIDENCE) / lengths)[:, None]
        best = mean.argmax(axis=1)
        odds = np.exp(np.clip(mean - mean.max(axis=1, keepdims=True), -700, 0))
        scores[full] = 1 / odds.sum(axis=1)
        for i, k in zip(full, best.tolist()):
            langs[i] = self.languages[k]
        return langs, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["lang", "n", "term", "times"],
        )

    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, times in Counter(words_of(text)).items():
                counts[lang, 0, word] += times
                for n in LENGTHS:
                    for g in grams(word, n):
                        counts[lang, n, g] += times
            if len(counts) > 1 << 18:
                yield rows(counts)
                counts = Counter()
    if counts:
        yield rows(counts)


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from; false for null ids, from which nothing is learned either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tables:
    """Fits on the bounded sample; rows with a null id, text or language and held-out rows aren't used."""
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    share = usable.groupBy("lang").agg((F.lit(float(PER_LANGUAGE)) / F.count(F.lit(1))).alias("share"))
    share = table(share, "shares")  # a row a language: known to be small, so that no text is shuffled to meet it
    drawn = (F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))) < F.col("share")
    sample = usable.join(share, "lang").where(drawn & F.col("text").isNotNull()).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, n int, term string, times long").groupBy("lang", "n", "term").agg(F.sum("times").alias("times"))
    got = counts.toArrow()
    return tables(*(got.column(c).to_pylist() for c in ("lang", "n", "term", "times")))


def tables(langs: list[str], lengths: list[int], terms: list[str], times: list[int]) -> Tables:
    """The scores of counted terms; ``lengths`` has 0 for words."""
    languages = sorted(set(langs))
    at = {x: i for i, x in enumerate(languages)}
    lang, kind, count = np.array([at[x] for x in langs], np.int64), np.array(lengths, np.int64), np.array(times, np.float64)
    kinds, parts, base = {}, [np.zeros((0, len(languages)))], 0
    for n in (0, *LENGTHS):
        mine = np.flatnonzero(kind == n).tolist()
        place = {t: i for i, t in enumerate(sorted({terms[i] for i in mine}))}
        found = np.zeros((len(place), len(languages)))
        np.add.at(found, (np.array([place[terms[i]] for i in mine], np.int64), lang[mine]), count[mine])
        total = found.sum(axis=0)
        total = np.where(total > 0, total, total.max(initial=1.0))  # a language without such terms is no likelier for it
        logs = np.log((found + SMOOTHING) / (total + SMOOTHING * max(1, len(place))))
        parts.append(logs - logs.mean(axis=1, keepdims=True) if len(place) else logs)
        kinds[n] = {term: base + i for term, i in place.items()}
        base += len(place)
    return Tables(languages, kinds[0], {n: kinds[n] for n in LENGTHS}, np.concatenate(parts))


#: Characters of the texts that are scored at once, or more if one text has more.
CHARACTERS = 1 << 21


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores, texts, held = [], [], [], 0
            for text in batch.column(1).to_pylist():
                texts.append(text)
                held += len(text or "")
                if held >= CHARACTERS:
                    found = model.predict(texts)
                    langs, scores, texts, held = langs + found[0], [*scores, found[1]], [], 0
            found = model.predict(texts)
            scores = np.concatenate([*scores, found[1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs + found[0], pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, fitted: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row and whole text.

    ``lang_pred`` is ``und`` with score 0 for null texts and texts without a letter, and
    for all if nothing could be learned; ties go to the language that sorts first.
    Repeated rows are judged alike, and only the text is an input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded by the sample
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_predict(shared), f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
