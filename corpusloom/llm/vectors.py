"""Rows of vectors as packed blocks: what the two vector searches share.

A block is one row that holds up to ``BLOCK`` vectors as one binary column per property, so that a
shuffle moves few large rows and a task works on matrices. Shorter vectors count as filled up with
zeros to the length of the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

BLOCK = 2048


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, odd)


def numbered(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(row, vec_id, vec): usable vectors as doubles, each row with a number of its own.

    The numbers are fixed by writing the rows once: a task that runs again finds the same ones.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("vec")))
    if nonzero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def length_of(rows: DataFrame) -> int:
    """The length of the longest vector."""
    return rows.agg(F.max(F.size("vec"))).first()[0] or 0


def matrix(vecs: pd.Series, length: int) -> np.ndarray:
    out = np.zeros((len(vecs), length))
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def slices(batches: Iterator[pd.DataFrame], size: int = BLOCK) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for low in range(0, len(pdf), size):
            yield pdf.iloc[low : low + size]


class Nearest:
    """The best ``k`` candidates of each of some queries: highest score, then smallest id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0)] * queries
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * queries

    def bound(self, q: int) -> float:
        """What a candidate must reach to matter."""
        return self.scores[q][-1] if len(self.scores[q]) >= self.k else -np.inf

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(scores) > 4 * self.k:  # keep ties of the k-th score
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= least
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of candidates (query_row, query_id, vec_id, score) from all parts."""
    from pyspark.sql import Window

    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
