"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its lower-cased terms, hashed to ``BUCKETS``. Besides a weight each
bucket has ``FACTORS`` factors, whose products weigh pairs of terms. The machine is fitted
on the driver over a sample bounded by ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled
documents, drawn by the hash of their ids. Every document of the sample counts; near
copies of one label share the weight of one. Scores of documents that a machine hasn't seen
are closer to even odds than the labels warrant, so each of ``FOLDS`` parts of the sample is scored by
a machine fitted on the others, and a slope and a shift are fitted to these scores. All documents
are scored where they lie.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._shared import fresh

BUCKETS = 1 << 20
FACTORS = 4
MAX_POSITIVE, MAX_NEGATIVE = 3000, 12000
#: Documents of the sample (near copies sharing one weight) that a bucket must occur in: in fewer, nothing general is learned.
MIN_DOCS = 4
#: Slack of sums of weights against rounding.
SLACK = 1e-6
#: Jaccard similarity of the bucket sets of near copies.
COPY = 0.8
BATCH, RATE, L1, L2 = 256, 0.5, 3e-4, 1e-4
#: Steps of descent, each over ``BATCH`` documents, rounded up to whole passes.
STEPS = 600
#: Parts of the sample that calibration fits and scores by turns.
FOLDS = 2
THRESHOLD = 0.7
TERM = re.compile(r"\w+")
_CACHE_TERMS = 1 << 19


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # of the kept buckets
    factors: np.ndarray
    place: dict[int, int]  # bucket: row of weights and factors
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: list[int]) -> float:
        if not rows:
            return self.bias
        v = self.factors[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, rows: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(sorted(rows)) + self.shift, -30, 30))))


def terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


def bucket(term: str) -> int:
    return xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass")) % BUCKETS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({bucket(t) for t in terms(x.as_py())}) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["label", "buckets"])


def _alike(sets: list[np.ndarray], counts: list[int]) -> list[int]:
    """For each of the distinct ``sets``, the sum of the ``counts`` of those at ``COPY`` or more, itself included.

    Exact: of two such sets each holds one of the other's ``size - ceil(COPY * size) + 1`` rarest members.
    """
    often = np.bincount(np.concatenate(sets).astype(np.int64), minlength=1)
    mark, total, index = np.zeros(len(often), bool), list(counts), defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        x = sets[i]
        rarest = x[np.lexsort((x, often[x]))][: len(x) - math.ceil(COPY * len(x) - 1e-9) + 1].tolist()
        mark[x] = True
        for j in {j for b in rarest for j in index[b]}:
            y = sets[j]
            if len(y) >= COPY * len(x):
                both = np.count_nonzero(mark[y])
                if both >= COPY * (len(x) + len(y) - both):
                    total[i] += counts[j]
                    total[j] += counts[i]
        mark[x] = False
        for b in rarest:
            index[b].append(i)
    return total


def witness_weights(labels: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """1 / (rows of the same label that are near copies of the row, itself included)."""
    weights = np.ones(len(features))
    for label in np.unique(labels):
        groups: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(labels == label).tolist():
            groups.setdefault(features[i].tobytes(), []).append(i)
        same = list(groups.values())
        for rows, n in zip(same, _alike([features[r[0]] for r in same], [len(r) for r in same])):
            weights[rows] = 1 / n
    return weights


def fit(labels: np.ndarray, features: list[np.ndarray], seed: int = 7) -> Machine:
    """A calibrated machine; without labels of both kinds it scores every text by their share."""
    weight = witness_weights(labels, features)
    machine = _descend(labels, features, weight, seed)
    fold = np.arange(len(labels)) % FOLDS
    parts = [fold != k for k in range(FOLDS)]
    if any(len(np.unique(labels[p])) < 2 for p in parts) or not machine.place:
        return machine
    raw = np.zeros(len(labels))
    for part in parts:
        other = _descend(labels[part], [x for x, p in zip(features, part) if p], weight[part], seed)
        for i in np.flatnonzero(~part):
            raw[i] = other.raw([other.place[b] for b in features[i].tolist() if b in other.place])
    machine.slope, machine.shift = calibration(raw, labels, weight)
    return machine


def calibration(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of raw scores that make them log odds of the label, by Newton's method on smoothed labels; 1 and 0 if scores don't rise with it."""
    ones, zeros = weight[labels == 1].sum(), weight[labels != 1].sum()
    wanted = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    columns, found = np.stack([raw, np.ones(len(raw))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(columns @ found, -30, 30)))
        bend = (columns * (weight * chance * (1 - chance))[:, None]).T @ columns + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, columns.T @ (weight * (chance - wanted)))
        found = found - step
        if np.abs(step).max() < 1e-8:
            break
    return (float(found[0]), float(found[1])) if np.isfinite(found).all() and found[0] > 0 else (1.0, 0.0)


def _descend(labels: np.ndarray, features: list[np.ndarray], weight: np.ndarray, seed: int) -> Machine:
    """Adaptive-gradient descent on the log loss; weights and factors shrink to zero unless the labels bear them out."""
    prior = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    empty = Machine(float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)), {})
    if not len(labels) or labels.min() == labels.max():
        return empty
    flat, sizes = np.concatenate(features) if features else np.zeros(0, np.int64), np.array([len(x) for x in features])
    found, at = np.unique(flat, return_inverse=True)
    counts = np.bincount(at, np.repeat(weight, sizes), len(found)) + SLACK
    kept = found[counts >= MIN_DOCS]
    if not len(kept):
        return empty
    rows = []
    for x in features:
        at = np.searchsorted(kept, x)
        at[at == len(kept)] = 0
        rows.append(at[kept[at] == x])
    y = labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    n = len(kept)
    b, w, v = empty.bias, np.zeros(n), rng.normal(0, 0.05, (n, FACTORS))
    gw, gv = np.full(n, 1e-3), np.full((n, FACTORS), 1e-3)
    for _ in range(-(-STEPS // -(-len(rows) // BATCH))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            lengths = np.array([len(rows[i]) for i in part])
            index = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), lengths)
            own = v[index]
            total = np.stack([np.bincount(owner, own[:, f], len(part)) for f in range(FACTORS)], axis=1)
            square = np.bincount(owner, (own * own).sum(axis=1), len(part))
            raw = b + np.bincount(owner, w[index], len(part)) + 0.5 * ((total * total).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * weight[part] / weight[part].sum()
            grad_w = np.bincount(index, error[owner], n)
            pull = error[owner][:, None] * (total[owner] - own)
            grad_v = np.stack([np.bincount(index, pull[:, f], n) for f in range(FACTORS)], axis=1) + L2 * v
            touched = np.unique(index)
            gw[touched] += grad_w[touched] ** 2
            gv[touched] += grad_v[touched] ** 2
            step = RATE / np.sqrt(gw[touched])
            new = w[touched] - step * grad_w[touched]
            w[touched] = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
            v[touched] -= 0.1 * RATE / np.sqrt(gv[touched]) * grad_v[touched]
            b -= 0.5 * error.sum()
        idle = w == 0
        v[idle] *= 0.5  # a term that tells nothing alone needs strong pairs to stay
    live = (w != 0) | (np.abs(v).max(axis=1) > 0.1)
    return Machine(float(b), w[live], v[live], {int(k): i for i, k in enumerate(kept[live])})


def _scorer(machine, at: int, keep_text: bool, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = machine.value
        place, cache = model.place, {}
        for batch in batches:
            scores = []
            for x in batch.column(at):
                found = terms(x.as_py())
                for t in found.difference(cache):
                    cache[t] = place.get(bucket(t), -1)
                rows = {cache[t] for t in found}
                rows.discard(-1)
                scores.append(model.score(list(rows)))
                if len(cache) > _CACHE_TERMS:
                    cache.clear()
            kept = [i for i in range(batch.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(scores, pa.float64())], [*[batch.schema.names[i] for i in kept], name])

    return score


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from; false for null ids, whose labels can't be found either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fits on a bounded sample of the labelled documents that aren't held out. Null labels are none; contradictory ones count as toxic."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    drawn = None
    for label, bound in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id", F.lit(label)), "id").limit(bound)
        drawn = some if drawn is None else drawn.union(some)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(drawn), F.col("doc") == F.col("id")).select("label", "text")  # MAX_POSITIVE + MAX_NEGATIVE rows of two numbers
    got = sample.mapInArrow(_features, "label int, buckets array<int>").toArrow()
    rows = [(y, x.values.to_numpy()) for y, x in zip(got.column(0).to_pylist(), got.column(1))]
    rows.sort(key=lambda r: (r[0], r[1].astype(">i4").tobytes()))  # the same model whatever order tasks end in
    return fit(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows])


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep_text: bool = True, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1) for every whole text; null and empty texts get the machine's bias."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)
    fields = [f for i, f in enumerate(docs.schema.fields) if keep_text or i != at]
    return docs.mapInArrow(_scorer(shared, at, keep_text, name), T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: ``id_col, held_out, score, predicted`` (1 if the score is ``THRESHOLD`` or more).

    Empty tables give no rows; without labels of both kinds every score is the prior.
    Repeated rows score alike. No column but the text is an input of a score.
    """
    machine = train(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), machine, keep_text=False)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` without those predicted toxic, all columns unchanged.

    A row goes by its own text alone, so repeated rows stay or go together; null and empty
    texts get the machine's bias, and without labels of both kinds the share of the toxic ones decides
    for all rows alike. An empty table stays empty.
    """
    machine = train(docs, labels, id_col, text_col, label_col)
    name = fresh(docs, "toxicity")
    return score(docs, machine, text_col, name=name).where(F.col(name) < THRESHOLD).drop(name)
