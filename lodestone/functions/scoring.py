"""Relevance as column expressions; the same formulas over plain numbers serve tests and callers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def term_count(tokens: Column, term: str | Column) -> Column:
    """How often a term is among the tokens, without a lambda."""
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def rounded(value: Column, digits: int = 6) -> Column:
    """A figure of 0 or more, rounded in binary as DuckDB does; Spark's ``round`` goes through decimal text for each row."""
    return F.floor(value * 10.0**digits + 0.5) / F.lit(10.0**digits)


def tf(count: Column, length: Column) -> Column:
    return F.when((count > 0) & (length > 0), count / length).otherwise(0.0)


def idf(n_docs: Column, n_with: Column) -> Column:
    """``ln(N / df) + 1``; 0 where either is 0."""
    return F.when((n_docs > 0) & (n_with > 0), F.log(n_docs / n_with) + 1).otherwise(0.0)


def tfidf(count: Column, length: Column, n_docs: Column, n_with: Column) -> Column:
    return tf(count, length) * idf(n_docs, n_with)


def bm25(count: Column, length: Column, n_docs: Column, n_with: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """BM25 on the share of a term in its document rather than its count."""
    share = tf(count, length)
    norm = k1 * (1 - b + b * length / average)
    score = idf(n_docs, n_with) * (share * (k1 + 1)) / (share + norm)
    return F.when((count > 0) & (average > 0), score).otherwise(0.0)


def bm25_value(count: int, length: int, n_docs: int, n_with: int, average: float, k1: float = K1, b: float = B) -> float:
    if not (count and length and n_docs and n_with and average):
        return 0.0
    share = count / length
    return (math.log(n_docs / n_with) + 1) * share * (k1 + 1) / (share + k1 * (1 - b + b * length / average))
