"""Exact n-gram Jaccard join in the metric space of n-gram sets.

One minus the Jaccard similarity is a metric, so distances to pivots bound distances between documents.
Most documents are at distance one from each other, where such bounds say nothing; so a document is
only sent to regions of pivots that it may reach:

1. Equal sets become one set. N-grams that are frequent within single batches are known as common;
   the order of n-grams is rare before common, so that passages shared by many documents come last.
   The order decides the work, never the result.
2. Two sets that link share one of the first ``n - ceil(t n) + 1`` n-grams of either. Of all documents
   with such an n-gram the most central one (fewest rare n-grams) is its pivot, and the others belong
   to the pivot's region. Every pair that can link meets in the region of a pivot. Pivots of a family of
   near copies coincide, so a family is one region and not one per n-gram. A document leaves a region in
   which no other one's size allows a link, before anything but its size and row has moved there.
3. In a region documents are first held as counts of n-grams per hash class. The sum of differences of
   counts never exceeds the symmetric difference, so it too separates documents; a document that no
   other can reach leaves the region before its set is moved. A region of more than ``region_docs``
   documents is cut into slices of at most half as many along the distance to its pivot, ties by a hash of
   the row. All distances of a region are taken at its coarsest number of classes, so the triangle
   inequality holds: slices further apart than the link distance need not meet, and every pair of slices
   that may is a region of its own.
4. Regions are solved one by one: central documents become pivots, each with exact distances to all;
   what links to a pivot joins its star. Stars of different groups meet again only in the windows that
   the triangle inequality leaves: documents there become pivots in turn, until no window is left.
   A region yields a forest of links, never all pairs.
5. Components of the forests' edges come from rounds of least neighbours and pointer jumps.

Defined results: a null text is an empty text; texts without words have an empty set and link with
nothing; null ids are documents like others and never the smallest id (a group of null ids has
null); repeated ids are separate documents; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fan_out
from corpusloom.ids import running_total
from corpusloom.llm.memory import lean
from corpusloom.llm.shingles import batches_of, mixed, sets_of
from corpusloom.session import materialize


@dataclass(frozen=True)
class Join:
    """``percent``: least similarity; ``common_keys`` bounds the list of common n-grams that tasks hold."""

    percent: int = 85
    n: int = 4
    common_count: int = 4
    common_keys: int = 1_000_000
    region_docs: int = 20_000
    broadcast_rows: int = 1_000_000

    def links(self, shared, one, other):
        return 100 * shared >= self.percent * (one + other - shared)

    def first(self, size: int) -> int:
        """How many n-grams of a set must hold one that a linked set shares."""
        return size - -(-self.percent * size // 100) + 1

    def apart(self, one, other):
        """The largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (one + other) / (100 + self.percent)


def read_sets(docs: DataFrame, j: Join) -> DataFrame:
    """(row, doc_id, n_shingles, digest, keys, counts): one row per document.

    The first document of a batch also carries n-grams that ``common_count`` documents of the batch share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for low, high in batches_of(texts, 6 << 20):
                sets = sets_of(texts[low:high], j.n)
                keys, counts = np.unique(np.concatenate(sets), return_counts=True)
                often = counts >= j.common_count
                out = pdf.iloc[low:high][["row", "doc_id"]].copy()
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["n_shingles"] = [len(s) for s in sets]
                out["digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                none = [np.empty(0, np.int64)] * (high - low - 1)
                out["keys"] = [keys[often].view(np.int64), *none]
                out["counts"] = [counts[often], *none]
                yield out

    schema = "row long, doc_id long, n_shingles long, digest binary, keys array<long>, counts array<long>"
    return materialize(docs.mapInPandas(lean(run), schema))


def common_keys(base: DataFrame, j: Join) -> np.ndarray:
    """The most frequent common n-grams, sorted; at most ``common_keys``."""
    listed = (
        fan_out(base, [], F.arrays_zip("keys", "counts"), "one")
        .groupBy("one.keys")
        .agg(F.sum("one.counts").alias("count"))
        .orderBy(F.col("count").desc(), "keys")
        .limit(j.common_keys)
        .select("keys")
        .toPandas()
    )
    return np.sort(listed["keys"].to_numpy(np.int64).view(np.uint64))


def survey(docs: DataFrame, common: np.ndarray, j: Join) -> DataFrame:
    """(row, rank, n, keys, outline): the first n-grams of every set and its counts per hash class.

    ``rank`` orders documents by their number of rare n-grams, then by a hash of the set; it also names a
    pivot. Equal sets have equal ranks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for low, high in batches_of(texts):
                keys, rare, seal, outline = [], [], [], []
                sets = sets_of(texts[low:high], j.n)
                for s in sets:
                    at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                    often = known[at] == s if len(known) else np.zeros(len(s), bool)
                    order = np.concatenate([s[~often], s[often]])[: j.first(len(s)) if len(s) else 0]
                    keys.append(order.view(np.int64))
                    rare.append(int(len(s) - often.sum()))
                    seal.append(np.bitwise_xor.reduce(s))
                    outline.append(class_counts(s).tobytes())
                row = pdf["row"].iloc[low:high].to_numpy(np.int64)
                rank = np.minimum(rare, (1 << 20) - 1).astype(np.uint64) << np.uint64(43)
                rank |= mixed(np.array(seal, np.uint64)) >> np.uint64(21)
                n = [len(s) for s in sets]
                yield pd.DataFrame({"row": row, "rank": rank.view(np.int64), "n": n, "keys": keys, "outline": outline})

    schema = "row long, rank long, n long, keys array<long>, outline binary"
    return materialize(docs.select("row", "text").mapInPandas(lean(run), schema))


def regions(surveyed: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, row, rank, n): the pivots whose regions one of ``sets`` (row, rank, n) may reach, pivots included.

    The n-grams move once, each with nothing but the rank of its set; n-grams of one set go. Where ranks
    coincide a region is only larger than it must be.
    """
    each = fan_out(surveyed, ["rank"], "keys", "key").repartition("key")
    along = Window.partitionBy("key").orderBy("rank")
    first = F.min("rank").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = each.select("rank", first.alias("pivot"), F.lead("rank").over(along).alias("next"))
    met = met.filter("pivot <> rank or next is not null").select("pivot", "rank").distinct()
    return met.join(sets, "rank")


def of_like_size(reach: DataFrame, j: Join) -> DataFrame:
    """(pivot, row) of ``reach`` without documents that no other of their region is near enough in size to link with.

    Sizes of one class may always link; of a class of one document the nearest sizes of the classes
    beside it decide, so a region is seen as a few classes. A region that keeps others keeps its pivot.
    """
    size_class = F.floor(F.log("n") / math.log(max(100 / j.percent, 1.05)))
    classes = reach.groupBy("pivot", size_class.alias("size_class")).agg(
        F.count(F.lit(1)).alias("docs"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.min("row").alias("row"),
        F.max(F.col("rank") == F.col("pivot")).alias("hub"),
    )
    region = Window.partitionBy("pivot")
    order = region.orderBy("size_class")
    below, above = F.lag("most").over(order), F.lead("least").over(order)
    linked = (F.col("docs") > 1) | (100 * below >= j.percent * F.col("least")) | (100 * F.col("most") >= j.percent * above)
    classes = classes.withColumn("linked", F.coalesce(linked, F.lit(False)))
    classes = classes.withColumn("kept", F.col("linked") | (F.col("hub") & F.max("linked").over(region)))
    return reach.select("pivot", "row").join(classes.filter("not kept").select("pivot", "row"), ["pivot", "row"], "left_anti")


def without_contained(reach: DataFrame) -> DataFrame:
    """``reach`` without regions whose sets all lie in one larger region, which sees all their pairs.

    Each region is held against one other: the largest that its first set reaches.
    """
    sizes = reach.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    sized = reach.join(sizes, "pivot")
    largest = sized.groupBy("row").agg(F.max(F.struct("size", (-F.col("pivot")).alias("order"))).alias("top"))
    first = reach.groupBy("pivot").agg(F.min("row").alias("row"))
    host = first.join(largest, "row").select("pivot", (-F.col("top.order")).alias("host")).filter("pivot <> host")
    inside = sized.join(host, "pivot").select("pivot", "size", "row", "host")
    contained = (
        inside.join(reach.select(F.col("pivot").alias("host"), "row"), ["host", "row"])
        .groupBy("pivot", "size")
        .agg(F.count(F.lit(1)).alias("common"))
        .filter("common = size")
    )
    return reach.join(contained.select("pivot"), "pivot", "left_anti")


def class_counts(s: np.ndarray) -> np.ndarray:
    """Counts of n-grams per hash class, stopped at 255; the number of classes follows the size."""
    bits = min(16, max(4, int(np.ceil(np.log2(len(s) / 3 + 1)))))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8)


def whole_texts(docs: DataFrame, near: DataFrame, j: Join) -> DataFrame:
    """(row, text, pivot, part) of the documents in ``near`` (pivot, part, row).

    These rows are broadcast while they are few, so that texts do not move to meet them; else both sides
    are dealt out by row.
    """
    small = near.count() <= j.broadcast_rows
    rows = near.select("row").distinct()
    rows, near = (F.broadcast(rows), F.broadcast(near)) if small else (rows, near)
    return docs.join(rows, "row", "left_semi").select("row", "text").join(near, "row")


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of differences between the rows of two count matrices; the finer one is folded."""
    if a.shape[1] != b.shape[1]:
        width = min(a.shape[1], b.shape[1])
        a, b = (m.reshape(len(m), width, -1).sum(2, dtype=np.int32) for m in (a, b))
    step = max(1, (1 << 22) // max(1, b.size))
    parts = [np.abs(a[i : i + step, None, :].astype(np.int32) - b[None].astype(np.int32)).sum(2) for i in range(0, len(a), step)]
    return np.concatenate(parts)


def folded(outline: bytes, classes: int) -> np.ndarray:
    """The counts of ``outline`` at a number of classes that divides its own."""
    return np.frombuffer(outline, np.uint8).reshape(classes, -1).sum(1, dtype=np.int64)


def reachable(n: np.ndarray, counts: list[np.ndarray], j: Join, chunk: int = 256) -> np.ndarray:
    """Which documents of a region have another one within reach, judged by their counts."""
    found = np.zeros(len(n), bool)
    if len(n) == 2:
        near = max(map(len, counts)) <= 2 * min(map(len, counts))
        found[:] = near and gaps(counts[0][None], counts[1][None])[0, 0] <= j.apart(n[0], n[1])
        return found
    width = np.array([len(c) for c in counts])
    stacked = {w: (np.flatnonzero(width == w), np.stack([c for c in counts if len(c) == w])) for w in np.unique(width)}
    for w, (own, mine) in stacked.items():
        for v in (w // 2, w, 2 * w):
            if v not in stacked:
                continue
            other, theirs = stacked[v]
            for low in range(0, len(other), chunk):
                open_ = np.flatnonzero(~found[own])
                if not len(open_):
                    break
                some = other[low : low + chunk]
                near = gaps(mine[open_], theirs[low : low + chunk]) <= j.apart(n[own[open_], None], n[None, some])
                near &= own[open_, None] != some[None]
                found[own[open_[near.any(1)]]] = True
    return found


def solve(rows: np.ndarray, sets: list[np.ndarray], j: Join) -> list[tuple[int, int]]:
    """Links that connect exactly what the links among these documents connect."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(rows[0]), int(rows[1]))] if j.links(shared, n[0], n[1]) else []
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(m, dtype=np.int32), n)[np.argsort(codes, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    group = list(range(m))
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    def distances(y: int) -> np.ndarray:
        """Exact distances of ``y`` to all, linking what is near enough on the way."""
        own = codes[ends[y] - n[y] : ends[y]]
        low, count = starts[own], starts[own + 1] - starts[own]
        at = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        shared = np.bincount(owner[at], minlength=m)
        for x in np.flatnonzero(j.links(shared, n[y], n)):
            a, b = root(int(x)), root(y)
            if a != b:
                group[max(a, b)] = min(a, b)
                out.append((int(rows[y]), int(rows[x])))
        return 1 - shared / (n[y] + n - shared)

    reach = 1 - j.percent / 100 + 1e-9
    star = np.full(m, -1)
    away = np.zeros(m)
    pivots: list[int] = []
    between: dict[int, np.ndarray] = {}
    spread = np.array([np.diff(starts)[codes[e - k : e]].mean() for e, k in zip(ends, n)])
    for y in np.argsort(-spread, kind="stable"):  # what shares most with the region goes first
        y = int(y)
        if star[y] >= 0:
            continue
        d = distances(y)
        star[y] = y
        joined = (star < 0) & (d <= reach)
        star[joined], away[joined] = y, d[joined]
        if joined.any():
            pivots.append(y)
            between[y] = d
    radius = {p: away[star == p].max() for p in pivots}
    done = set()
    for i, p in enumerate(pivots):
        for q in pivots[:i]:
            if root(p) == root(q) or between[p][q] > radius[p] + radius[q] + reach:
                continue
            small, large = sorted((p, q), key=lambda s: int((star == s).sum()))
            window = np.flatnonzero((star == small) & (away >= between[p][q] - radius[large] - reach))
            for y in window:
                if root(p) == root(q):
                    break
                if int(y) not in done and int(y) != small:
                    done.add(int(y))
                    distances(int(y))
    return out


def sliced(reach: DataFrame, members: DataFrame, j: Join) -> DataFrame:
    """``members`` (pivot, row, rank, n, outline) with ``part``: too large regions cut into pairs of slices.

    Slices follow the difference of counts to the pivot's, at one number of classes for the whole region;
    equal differences are cut by a hash of the row. Pairs of slices that are further apart than any link is
    long are left out. A part has at most ``region_docs`` documents, whatever the size of the region.
    """
    large = reach.groupBy("pivot").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > j.region_docs)
    large = materialize(large)
    if large.isEmpty():
        return members.withColumn("part", F.lit(0).cast("long"))
    classes = members.groupBy("pivot").agg(F.min(F.length("outline")).alias("classes"))
    hub = members.filter("pivot = rank").dropDuplicates(["pivot"]).select("pivot", F.col("outline").alias("hub"))

    def to_hub(outline: pd.Series, hub: pd.Series, classes: pd.Series) -> pd.Series:
        return pd.Series([int(np.abs(folded(a, w) - folded(b, w)).sum()) for a, b, w in zip(outline, hub, classes)])

    placed = (
        members.join(large, "pivot")
        .join(hub, "pivot")
        .join(classes, "pivot")
        .withColumn("t", F.pandas_udf(to_hub, "long")("outline", "hub", "classes"))
        .withColumn("order", F.shiftleft("t", 20) + F.shiftrightunsigned(F.xxhash64("row"), 44))
        .drop("hub", "classes")
    )
    placed = materialize(placed)
    ranked = running_total(placed.select("pivot", "row", "order", "docs"), "place", ["order", "row"], ["pivot"], spread="range")
    count = F.ceil(2 * F.col("docs") / j.region_docs).cast("long")
    slice_ = F.floor(F.col("place") * count / F.col("docs")).cast("long")
    placed = placed.join(ranked.select("pivot", "row", count.alias("count"), slice_.alias("slice")), ["pivot", "row"])
    ranges = placed.groupBy("pivot", "count", "slice").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.max("n").alias("most"))
    a, b = ranges.alias("a"), ranges.alias("b")
    most = F.greatest("a.most", "b.most")
    longest = F.lit(2 * (100 - j.percent)) * most / (100 + j.percent)
    pairs = a.join(b, (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.slice") <= F.col("b.slice"))).filter(
        F.col("b.low") - F.col("a.high") <= longest
    )
    name = F.col("a.slice") * F.col("a.count") + F.col("b.slice") + 1
    ends = F.array_distinct(F.array("a.slice", "b.slice"))
    pairs = pairs.select(F.col("a.pivot").alias("pivot"), F.explode(ends).alias("slice"), name.alias("part"))
    cut = placed.join(pairs, ["pivot", "slice"]).select(*members.columns, "part")
    whole = members.join(large.select("pivot"), "pivot", "left_anti").withColumn("part", F.lit(0).cast("long"))
    return whole.unionByName(cut)


def by_region(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one region after the other, from rows sorted by (pivot, part)."""
    held: list[pd.DataFrame] = []
    key = None
    for pdf in batches:
        pivot, part = pdf["pivot"].to_numpy(), pdf["part"].to_numpy()
        cuts = np.flatnonzero((pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, len(pdf)]):
            if held and (pivot[low], part[low]) != key:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            key = pivot[low], part[low]
            held.append(pdf.iloc[low:high])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def region_rows(members: DataFrame) -> DataFrame:
    return members.repartition("pivot", "part").sortWithinPartitions("pivot", "part")


def packed(data: Column) -> Column:
    """Compressed bytes, for columns that move to every region of their row."""

    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: zlib.compress(bytes(d), 1))

    return F.pandas_udf(run, "binary")(data)


def near_members(members: DataFrame, j: Join) -> DataFrame:
    """(pivot, part, row) of documents that another one of their region may link with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_region(batches):
            outlines = [np.frombuffer(zlib.decompress(o), np.uint8) for o in pdf["outline"]]
            keep = reachable(pdf["n"].to_numpy(np.int64), outlines, j)
            if keep.any():
                yield pdf[["pivot", "part", "row"]][keep]

    rows = region_rows(members.select("pivot", "part", "row", "n", packed("outline").alias("outline")))
    return rows.mapInPandas(lean(run), "pivot long, part long, row long")


def forest(members: DataFrame, j: Join) -> DataFrame:
    """(a, b): links between rows that connect what all links within regions connect.

    Texts move to their regions, not sets: they are the smaller ones.
    """

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [zlib.decompress(t).decode() for t in pdf["text"]]
            sets = [s for low, high in batches_of(texts) for s in sets_of(texts[low:high], j.n)]
            yield pdf[["pivot", "part", "row"]].assign(set=pd.Series(sets, pdf.index, dtype=object))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_region(with_sets(batches)):
            order = np.argsort(pdf["row"].to_numpy(), kind="stable")
            sets = pdf["set"].tolist()
            edges = solve(pdf["row"].to_numpy(np.int64)[order], [sets[i] for i in order], j)
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return region_rows(members.withColumn("text", packed(F.encode("text", "utf-8")))).mapInPandas(lean(run), "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(row, label): the least row that each row of ``edges`` (a, b) is connected with.

    Every round takes the least label of a row's neighbours and then the label of that label, so
    chains halve; labels are written after each round.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("row")).agg(F.least(F.col("row"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row")).agg(F.min("label").alias("near"))
        step = labels.join(near, "row").select("row", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("row").alias("label"), F.col("label").alias("further"))
        step = materialize(step.join(jump, "label", "left").select("row", "old", F.coalesce("further", "label").alias("label")))
        labels = step.select("row", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def components(
    docs: DataFrame, j: Join = Join(), id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """(row, doc_id, n_shingles, component, component_id) of every document.

    ``component`` is a row number, ``component_id`` the smallest id of the component. ``row_col`` names
    numbers that stay the same whenever ``docs`` is read; without it rows are numbered and written once.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs = docs if row_col else materialize(docs)
    with small_batches(docs.sparkSession, 1000):
        base = read_sets(docs, j)
        surveyed = survey(docs, common_keys(base, j), j)
    first = base.filter("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("set_row"))
    sets = surveyed.select("row", "rank", "n").join(first.select(F.col("set_row").alias("row")), "row", "left_semi")
    reach = materialize(of_like_size(materialize(regions(surveyed, sets)), j))
    reach = materialize(without_contained(reach))
    members = reach.join(surveyed.select("row", "rank", "n", "outline"), "row")
    near = materialize(near_members(sliced(reach, members, j), j))
    with small_batches(docs.sparkSession):
        edges = materialize(forest(whole_texts(docs, near, j), j))
    return placed(base, first, connected(edges))


@contextmanager
def small_batches(spark, rows: int = 500):
    """Fewer rows per Arrow batch for what is written meanwhile: sets may have many kilobytes each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def placed(base: DataFrame, first: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with the component of its set."""
    named = first.join(labels.withColumnRenamed("row", "set_row"), "set_row", "left").select(
        "digest", F.coalesce("label", "set_row").alias("label")
    )
    rows = base.select("row", "doc_id", "n_shingles", "digest").join(named, "digest", "left").drop("digest")
    rows = rows.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("row"))).drop("label")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("row", "doc_id", "n_shingles", "component", "component_id")
