"""Exact top-k by integer inner product as a Voronoi kNN join.

Largest inner product becomes smallest distance: with ``M`` the largest length of a vector, a vector
``s`` gets one more component, sqrt(M^2 - |s|^2), and a query gets 0 there; then the squared distance
is |q|^2 + M^2 - 2 <q, s>.

1. Pivots are vectors chosen by a hash of their ids; every vector and every query belongs to its
   nearest pivot.
2. Summaries: per group of queries the largest distance to its pivot, per group of vectors the k + 1
   smallest distances to its pivot. Distances between pivots turn them into a bound on the k-th
   distance of every query of a group (k + 1, as one of the vectors may be the query itself).
3. Vectors are packed in blocks of one group, ordered by distance to the pivot. A block is sent to a
   group of queries only if the triangle inequality lets it hold a vector within the bound.
4. Every group of queries is solved by itself, with exact integers.

Summaries are of the size of the pivots, a parameter. Groups of vectors are cut into blocks and groups
of queries into parts of at most ``query_rows``, so a group that holds a third of all rows, or one
vector that is repeated very often, does not gather in one task. In many dimensions the bounds prune
little, and blocks go to most groups; then the join does the work of a scan in blocks, not less.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part; an empty vector counts as zeros; repeated ids are separate rows, and only a query's
own row is no candidate; equal scores go to the smaller id; scores beyond 64 bits stop at its ends;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.vectors import Nearest, length_of, matrix, numbered, ranked
from corpusloom.session import materialize

EXACT = float(1 << 53)


@dataclass(frozen=True)
class Join:
    k: int = 5
    pivots: int = 12
    block_rows: int = 1024
    query_rows: int = 8192
    seed: int = 9


def integers(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, kept as doubles, which hold them exactly."""
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))


def distances(points: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray, most: float) -> np.ndarray:
    """Distances of points to pivots in the space with one more component."""
    own = (points * points).sum(1) + extra * extra
    squares = own[:, None] + most - 2 * (points @ pivots.T + np.outer(extra, pivot_extra))
    return np.sqrt(np.maximum(0, squares))


@dataclass(frozen=True)
class Space:
    """Pivots with their extra component; ``most`` is the largest squared length."""

    pivots: np.ndarray
    extra: np.ndarray
    most: float

    def nearest(self, points: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = distances(points, extra, self.pivots, self.extra, self.most)
        group = away.argmin(1)
        return group, away[np.arange(len(points)), group]

    def lift(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.most - (points * points).sum(1)))

    def between(self) -> np.ndarray:
        return distances(self.pivots, self.extra, self.pivots, self.extra, self.most)


def choose_pivots(rows: DataFrame, length: int, j: Join) -> Space:
    """At most ``pivots`` vectors, chosen by a hash of their ids, reach the driver."""
    most = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    taken = rows.orderBy(F.xxhash64(F.lit(j.seed), "vec_id"), "vec_id").select("vec").limit(j.pivots).collect()
    pivots = np.unique(matrix(pd.Series([r["vec"] for r in taken], dtype=object), length), axis=0)
    return Space(pivots, np.sqrt(np.maximum(0, most - (pivots * pivots).sum(1))), float(most))


def blocks_of(rows: DataFrame, length: int, space: Space, j: Join, tasks: int) -> DataFrame:
    """Blocks of vectors of one group in order of distance to its pivot."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = matrix(pdf["vec"], length)
            group, away = space.nearest(points, space.lift(points))
            yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "group": group.astype(np.int32), "away": away, "vec": pdf["vec"]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block() -> pd.DataFrame:
            pdf = pd.concat(held)
            held.clear()
            away = pdf["away"].to_numpy()
            return pd.DataFrame(
                {
                    "group": [pdf["group"].iat[0]],
                    "low": [away.min()],
                    "high": [away.max()],
                    "first": [np.sort(away)[: j.k + 1].tolist()],
                    "rows": [pdf["row"].to_numpy(np.int64).tobytes()],
                    "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                    "vecs": [matrix(pdf["vec"], length).tobytes()],
                }
            )

        count, last = 0, None
        for pdf in batches:
            for group, some in pdf.groupby("group", sort=False):
                for low in range(0, len(some), j.block_rows):
                    piece = some.iloc[low : low + j.block_rows]
                    if held and (group != last or count + len(piece) > j.block_rows):
                        yield block()
                        count = 0
                    held.append(piece)
                    count, last = count + len(piece), group
        if held:
            yield block()

    placed = rows.mapInPandas(assign, "row long, vec_id long, group int, away double, vec array<double>")
    dealt = placed.repartition(tasks, "row").sortWithinPartitions("group", "away")
    schema = "group int, low double, high double, first array<double>, rows binary, ids binary, vecs binary"
    return materialize(dealt.mapInPandas(pack, schema))


def reach_of(blocks: DataFrame, queries: DataFrame, space: Space, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group of queries: the largest distance to the pivot, and a bound on the k-th distance."""
    near = Window.partitionBy("group").orderBy("d")
    first = (
        blocks.select("group", F.explode("first").alias("d"))
        .withColumn("at", F.row_number().over(near))
        .filter(F.col("at") <= k + 1)
    )
    n = len(space.pivots)
    smallest = np.full((n, k + 1), np.inf)
    for r in first.collect():
        smallest[r["group"], r["at"] - 1] = r["d"]
    wide = np.full(n, -np.inf)
    for r in queries.groupBy("group").agg(F.max("away").alias("away")).collect():
        wide[r["group"]] = r["away"]
    between = space.between()
    bound = np.full(n, np.inf)
    for i in range(n):
        reach = np.sort((between[i][:, None] + smallest).ravel())[k]
        bound[i] = wide[i] + reach
    return wide, bound


def join(
    vectors: DataFrame,
    is_query: Column,
    j: Join = Join(),
    id_col: str = "vec_id",
    vec_col: str = "vec",
    tasks: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): exactly the ``k`` best of every row that ``is_query`` (over vec_id)."""
    spark = vectors.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(vectors, id_col, vec_col, nonzero=False)
    length = length_of(rows)
    space = choose_pivots(rows, length, j)
    blocks = blocks_of(rows, length, space, j, tasks)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = matrix(pdf["vec"], length)
            group, away = space.nearest(points, np.zeros(len(points)))
            yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "group": group.astype(np.int32), "away": away, "vec": pdf["vec"]})

    queries = rows.filter(is_query).mapInPandas(assign, "row long, vec_id long, group int, away double, vec array<double>")
    wide, bound = reach_of(blocks, queries, space, j.k)
    between = space.between()
    slack = 1e-6 * (1 + np.sqrt(space.most))
    sizes = {r["group"]: r["n"] for r in queries.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {g: -(-n // j.query_rows) for g, n in sizes.items()}

    def targets(group: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = []
        for g, a, b in zip(group, low, high):
            gap = between[g]
            wanted = (b >= gap - wide - bound - slack) & (a <= gap + wide + bound + slack) & np.isfinite(wide)
            out.append([int(i) * (1 << 16) + p for i in np.flatnonzero(wanted) for p in range(parts[int(i)])])
        return pd.Series(out)

    sent = F.pandas_udf(targets, "array<int>")
    blocks = blocks.select(
        F.explode_outer(sent("group", "low", "high")).alias("cell"), F.lit(1).alias("side"), "rows", "ids", "vecs"
    ).filter(F.col("cell").isNotNull())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group = pdf["group"].to_numpy(np.int64)
            part = pdf["row"].to_numpy(np.int64) % np.array([parts[int(g)] for g in group], np.int64)
            pdf = pdf.assign(cell=(group * (1 << 16) + part).astype(np.int32))
            for cell, own in pdf.groupby("cell"):
                yield pd.DataFrame(
                    {
                        "cell": [np.int32(cell)],
                        "side": [np.int32(0)],
                        "rows": [own["row"].to_numpy(np.int64).tobytes()],
                        "ids": [own["vec_id"].to_numpy(np.int64).tobytes()],
                        "vecs": [matrix(own["vec"], length).tobytes()],
                    }
                )

    asked = queries.mapInPandas(pack, "cell int, side int, rows binary, ids binary, vecs binary")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, key = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.cell != key:
                    if cell is not None:
                        yield cell.result()
                    cell, key = Region(length, j.k), r.cell
                cell.take(r)
        if cell is not None:
            yield cell.result()

    regions = blocks.unionByName(asked).repartition(tasks, "cell").sortWithinPartitions("cell", "side")
    return ranked(regions.mapInPandas(solve, "query_row long, query_id long, vec_id long, score long"), j.k)


class Region:
    """A group of queries, then the blocks that may hold their nearest vectors."""

    def __init__(self, length: int, k: int) -> None:
        self.length, self.k = length, k
        self.held: list[tuple] = []
        self.best: Nearest | None = None

    def take(self, r) -> None:
        rows, ids = np.frombuffer(r.rows, np.int64), np.frombuffer(r.ids, np.int64)
        vecs = np.frombuffer(r.vecs).reshape(len(ids), self.length)
        if r.side == 0:
            self.held.append((rows, ids, vecs))
            return
        self._ready()
        for low in range(0, len(self.ids), 1024):
            scores = products(self.vecs[low : low + 1024], vecs)
            for i in range(len(scores)):
                q = low + i
                near = np.flatnonzero((scores[i] >= self.best.bound(q)) & (rows != self.rows[q]))
                if len(near) > 4 * self.k:
                    some = scores[i][near]
                    near = near[some >= np.partition(some, len(some) - self.k)[len(some) - self.k]]
                if len(near):
                    self.best.offer(q, scores[i][near], ids[near])

    def _ready(self) -> None:
        if self.best is None:
            self.rows, self.ids = (np.concatenate([h[i] for h in self.held] or [np.empty(0, np.int64)]) for i in (0, 1))
            self.vecs = np.concatenate([h[2] for h in self.held] or [np.empty((0, self.length))])
            self.best = Nearest(len(self.ids), self.k)
            self.best.scores = [np.empty(0, np.int64)] * len(self.ids)

    def result(self) -> pd.DataFrame:
        self._ready()
        counts = [len(x) for x in self.best.ids]
        return pd.DataFrame(
            {
                "query_row": np.repeat(self.rows, counts),
                "query_id": np.repeat(self.ids, counts),
                "vec_id": np.concatenate([*self.best.ids, np.empty(0, np.int64)]),
                "score": np.concatenate([*self.best.scores, np.empty(0, np.int64)]),
            }
        )


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as int64; in doubles while those are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    ends = np.iinfo(np.int64)
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    return np.array([[min(max(sum(x * y for x, y in zip(u, v)), ends.min), ends.max) for v in whole[1]] for u in whole[0]], np.int64)
