"""BM25 as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def bm25(tf: Column, df: Column, length: Column, n: Column, mean_length: Column, k1: float = K1, b: float = B) -> Column:
    """The part of one term in a document's score; 0 where any count is 0."""
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    score = idf * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * length / mean_length))
    return F.when((tf > 0) & (df > 0) & (n > 0) & (mean_length > 0), score).otherwise(F.lit(0.0))
