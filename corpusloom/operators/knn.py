"""Exact nearest neighbours, retrieval and rank metrics.

The search is a blocked product: both sides are cut into blocks of bounded size, every block pair
is one numpy matrix product, and only the best ``k`` of each (query, block) leave the task. The
final merge ranks a bounded number of rows per query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fan_out
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.ids import seeded_key, top_per_group
from corpusloom.operators.skew import skew_join
from corpusloom.session import materialize

DIGITS = 6
HOT_POSTINGS = 1_000_000
# What a task holds at once: entries of a matrix product, and pairs that are scored again.
PRODUCT, PAIRS = 1 << 21, 1 << 14


def _nearest(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the best ``k`` rows of ``c`` per row of ``q``, by (score, id); smaller is better.

    One matrix product finds all rows that can be among them, with room for its rounding; these are
    scored again from the components, and only that score ranks.
    """
    near = q @ c.T
    q2, c2 = (q * q).sum(1), (c * c).sum(1)
    near *= -1.0 if metric == "IP" else -2.0
    if metric != "IP":
        near += c2
        near += q2[:, None]
    room = 1e-12 * (q2 + c2.max())
    last = min(k, len(c)) - 1
    border = np.partition(near, last, axis=1)[:, last] + room
    row, at = np.nonzero(near <= border[:, None])
    exact = np.empty(len(row))
    # as many copies as there are may stand on the border: pairs are scored in slices
    for i in range(0, len(row), PAIRS):
        left, right = q[row[i : i + PAIRS]], c[at[i : i + PAIRS]]
        exact[i : i + PAIRS] = -(right * left).sum(1) if metric == "IP" else ((right - left) ** 2).sum(1)
    order = np.lexsort((ids[at], exact, row))
    row, at, exact = row[order], at[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    return row[kept], ids[at[kept]], exact[kept]


def _block_search(want: int, metric: str, query_rows: int):
    """Best ``want`` rows of the right block for every row of the left one; both have (id, v)."""

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "neighbor_id": [], "score": []})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("id")
        cids = right["id"].to_numpy()
        cmat = np.stack(right["v"].to_numpy()).astype(float)
        lids = left["id"].to_numpy()
        rows = min(query_rows, max(1, PRODUCT // len(cmat)))
        outs = []
        for i in range(0, len(left), rows):
            part = np.stack(left["v"].iloc[i : i + rows].to_numpy()).astype(float)
            row, near, scores = _nearest(part, cmat, cids, want, metric)
            outs.append(pd.DataFrame({"query_id": lids[i + row], "neighbor_id": near, "score": scores}))
        return pd.concat(outs)

    return block


def _lists_search(k: int, metric: str, exclude_self: bool, query_rows: int):
    """Best ``k`` rows of the right block for every row of the left one, among the lists that it names.

    The left block has (id, v, lists), the right one (id, v, list).
    """
    want = k + 1 if exclude_self else k

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "neighbor_id": [], "score": []})
        if left.empty or right.empty:
            return empty
        right = right.sort_values(["list", "id"])
        cids, cmat = right["id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(float)
        held, starts = np.unique(right["list"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(cids))
        outs = []
        for i in range(0, len(left), query_rows):
            part = left.iloc[i : i + query_rows]
            lids, qmat = part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float)
            asked = np.concatenate(part["lists"].to_list())
            asking = np.repeat(np.arange(len(part)), part["lists"].map(len))
            by_list = np.argsort(asked, kind="stable")
            asked, asking = asked[by_list], asking[by_list]
            found = []
            for name, a, b in zip(held, starts, ends):
                who = asking[np.searchsorted(asked, name) : np.searchsorted(asked, name, "right")]
                rows = max(1, PRODUCT // (b - a))
                for j in range(0, len(who), rows):
                    row, near, scores = _nearest(qmat[who[j : j + rows]], cmat[a:b], cids[a:b], want, metric)
                    found.append((who[j + row], near, scores))
            if not found:
                continue
            row, near, scores = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((near, scores, row))
            if exclude_self:
                order = order[near[order] != lids[row[order]]]
            ranked = row[order]
            order = order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]
            outs.append(pd.DataFrame({"query_id": lids[row[order]], "neighbor_id": near[order], "score": scores[order]}))
        return pd.concat(outs) if outs else empty

    return block


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 20,
    metric: str = "L2",
    query_id: str = "query_id",
    corpus_id: str = "vec_id",
    vector: str = "embedding",
    exclude_self: bool = True,
    block_rows: int = 20_000,
    query_rows: int = 1024,
) -> DataFrame:
    """The ``k`` nearest corpus vectors of each query by squared L2 or inner product.

    Scores are computed in double precision and rank as they are; ties go to the smaller id.
    Returns (query_id, rank, neighbor_id, score); rank starts at 1.

    ``block_rows`` bounds what one task holds of each side; products are cut to ``PRODUCT`` entries. With Q query blocks and C corpus blocks
    every query is sent C times and every corpus vector Q times, so larger blocks mean less shuffle;
    choose it as large as task memory allows.
    """
    if metric not in ("L2", "IP"):
        raise ValueError("metric is L2 or IP")
    want = k + 1 if exclude_self else k
    spark = queries.sparkSession
    slots = spark.sparkContext.defaultParallelism
    nq, nc = queries.count(), corpus.count()
    # enough block pairs for every slot, and no block above the size bound
    q_blocks = max(math.ceil(nq / block_rows), min(math.ceil(math.sqrt(slots)), max(1, nq // 64)), 1)
    c_blocks = max(math.ceil(nc / block_rows), min(math.ceil(math.sqrt(slots)), max(1, nc // 64)), 1)

    qs = queries.select(
        F.col(query_id).cast("long").alias("id"),
        F.col(vector).alias("v"),
        F.pmod(F.xxhash64(query_id), F.lit(q_blocks)).cast("int").alias("qb"),
    ).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    cs = corpus.select(
        F.col(corpus_id).cast("long").alias("id"),
        F.col(vector).alias("v"),
        F.pmod(F.xxhash64(corpus_id), F.lit(c_blocks)).cast("int").alias("cb"),
    ).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    partial = (
        qs.groupBy("qb", "cb")
        .cogroup(cs.groupBy("qb", "cb"))
        .applyInPandas(_block_search(want, metric, query_rows), "query_id long, neighbor_id long, score double")
    )
    return _ranked(partial, k, metric, exclude_self)


def _ranked(partial: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    if exclude_self:
        partial = partial.filter(F.col("query_id") != F.col("neighbor_id"))
    ranked = top_per_group(partial, ["query_id"], [F.col("score"), F.col("neighbor_id")], k, out="rank")
    score = F.col("score") + 0.0 if metric == "L2" else F.lit(0.0) - F.col("score")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", score.alias("score"))


@dataclass(frozen=True)
class Lists:
    """A coarse quantizer: ``centres`` and the corpus rows (id, v, list), with the size of every list."""

    centres: np.ndarray
    sizes: np.ndarray
    rows: DataFrame
    metric: str

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """All lists per vector, the most promising first."""
        near = -(vectors @ self.centres.T)
        if self.metric == "L2":
            near = (self.centres**2).sum(1)[None, :] + 2.0 * near
        return np.argsort(near, axis=1, kind="stable")


def inverted_lists(
    corpus: DataFrame,
    metric: str = "L2",
    corpus_id: str = "vec_id",
    vector: str = "embedding",
    most_lists: int = 4096,
    sample_rows: int = 50_000,
    rounds: int = 10,
    seed: int = 7,
) -> Lists:
    """Lists around centres fitted to at most ``sample_rows`` rows; every row is in the list of its nearest centre.

    There are about as many lists as rows in a list, up to ``most_lists``, which with ``sample_rows`` bounds
    what the driver holds.
    """
    rows = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(vector).alias("v"))
    n = rows.count()
    picked = rows.orderBy(seeded_key(seed, "id"), "id").limit(sample_rows)  # a bounded heap per task
    sample = np.stack(picked.toPandas()["v"].to_numpy()).astype(float) if n else np.zeros((1, 1))
    count = max(1, min(math.isqrt(n), most_lists, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(rounds):
        home = np.argmin((centres**2).sum(1)[None, :] - 2.0 * sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        held = np.bincount(home, minlength=count)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)

    @F.pandas_udf("int")
    def home_of(col: pd.Series) -> pd.Series:
        v = np.stack(col.to_numpy()).astype(float)
        return pd.Series(np.argmin((centres**2).sum(1)[None, :] - 2.0 * v @ centres.T, axis=1))

    placed = materialize(rows.withColumn("list", home_of("v")))
    sizes = np.zeros(count, np.int64)
    for row in placed.groupBy("list").count().collect():  # one row per list
        sizes[row["list"]] = row["count"]
    return Lists(centres, sizes, placed, metric)


def lists_needed(lists: Lists, queries: DataFrame, k: int, recall: float, exclude_self: bool, sample: int, **cols: str) -> tuple[int, float]:
    """How many lists to probe for ``recall``, and the recall measured with them.

    ``sample`` queries are answered exactly. A true neighbour is found if its list is among the first
    ones of its query, so the place of that list says how many lists it needs.
    """
    query_id, vector = cols.get("query_id", "query_id"), cols.get("vector", "embedding")
    some = sample_queries(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("v")), sample, "query_id", 11)
    some = materialize(some)
    true = knn(some, lists.rows, k, lists.metric, "query_id", "id", "v", exclude_self)
    found = true.join(lists.rows.select(F.col("id").alias("neighbor_id"), "list"), "neighbor_id").join(some, "query_id")
    found = found.select("v", "list").toPandas()  # sample * k rows
    if found.empty:
        return 1, 1.0
    order = lists.order(np.stack(found["v"].to_numpy()).astype(float))
    place = np.sort((order == found["list"].to_numpy()[:, None]).argmax(axis=1))
    probes = int(place[math.ceil(recall * len(place)) - 1]) + 1
    return probes, float((place < probes).mean())


def _blocks_of_lists(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) per list: small lists share a block, a large one has blocks of its own."""
    parts = np.maximum(1, -(-sizes // block_rows))
    first = np.zeros(len(sizes), np.int64)
    block, filled = -1, block_rows
    for i, n in enumerate(sizes):  # at most as many as there are centres
        if parts[i] > 1:
            block, filled = block + 1, block_rows
            first[i] = block
            block += int(parts[i]) - 1
        else:
            if filled + n > block_rows:
                block, filled = block + 1, 0
            first[i], filled = block, filled + n
    return first, parts


def knn_approximate(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "L2",
    recall: float = 0.95,
    exclude_self: bool = True,
    sample: int = 200,
    block_rows: int = 20_000,
    query_rows: int = 1024,
    **cols: str,
) -> tuple[DataFrame, float]:
    """The nearest neighbours found in the inverted lists that each query probes, and the recall on a sample.

    The number of lists is what brings the recall of ``sample`` exactly answered queries to ``recall``; a
    query whose lists hold fewer than ``k`` rows probes further ones until they do, so every query gets
    ``k`` rows if the corpus has them. Candidates are scored exactly in double precision, ties by id.

    Lists stand together in blocks of about ``block_rows`` rows, and a query goes once to each block that has
    lists for it, not once to each list; so both sides move as often as the other has blocks.
    """
    query_id, vector = cols.get("query_id", "query_id"), cols.get("vector", "embedding")
    lists = inverted_lists(corpus, metric, cols.get("corpus_id", "vec_id"), vector)
    probes, measured = lists_needed(lists, queries, k, recall, exclude_self, sample, query_id=query_id, vector=vector)
    want = k + 1 if exclude_self else k
    order, sizes = replace(lists, rows=None).order, lists.sizes
    side = math.ceil(math.sqrt(queries.sparkSession.sparkContext.defaultParallelism))
    # enough blocks for every slot
    first, parts = _blocks_of_lists(sizes, min(block_rows, max(64, int(sizes.sum()) // side + 1)))
    nq = queries.count()
    q_blocks = max(math.ceil(nq / block_rows), min(side, nq // 64), 1)

    @F.pandas_udf("array<struct<cb:int,lists:array<int>>>")
    def probed(col: pd.Series) -> pd.Series:
        near = order(np.stack(col.to_numpy()).astype(float))
        enough = (np.cumsum(sizes[near], axis=1) < want).sum(axis=1) + 1
        out = []
        for row, n in zip(near, enough):
            named = row[: max(probes, n)]
            # a list of several blocks is asked for in each of them
            wide = np.repeat(named, parts[named])
            at = first[wide] + np.arange(len(wide)) - np.repeat(np.cumsum(parts[named]) - parts[named], parts[named])
            by_block = np.argsort(at, kind="stable")
            blocks, starts = np.unique(at[by_block], return_index=True)
            out.append([{"cb": int(b), "lists": x.astype(np.int32)} for b, x in zip(blocks, np.split(wide[by_block], starts[1:]))])
        return pd.Series(out, dtype=object)

    qs = fan_out(queries, [F.col(query_id).cast("long").alias("id"), F.col(vector).alias("v")], probed(vector), "p")
    qs = qs.select("id", "v", "p.cb", "p.lists", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"))

    @F.pandas_udf("int")
    def block_of(names: pd.Series, hashes: pd.Series) -> pd.Series:
        name = names.to_numpy()
        return pd.Series((first[name] + hashes.to_numpy() % parts[name]).astype(np.int32))

    cs = lists.rows.withColumn("cb", block_of("list", F.xxhash64("id")))
    cs = cs.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    key = ["qb", "cb"]
    partial = qs.groupBy(*key).cogroup(cs.groupBy(*key)).applyInPandas(
        _lists_search(k, metric, exclude_self, query_rows), "query_id long, neighbor_id long, score double"
    )
    return _ranked(partial, k, metric, exclude_self), measured


def exclude_self(neighbors: DataFrame, k: int) -> DataFrame:
    """Drop the query from its own list and rank again."""
    kept = neighbors.filter(F.col("query_id") != F.col("neighbor_id")).drop("rank")
    return top_per_group(kept, ["query_id"], [F.col("score"), F.col("neighbor_id")], k, out="rank")


def neighbor_lists(neighbors: DataFrame, length: int = 20) -> DataFrame:
    """Array form ``[query, n1, ...]`` cut to ``length``; a query's list is bounded by k."""
    lists = neighbors.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))), lambda s: s["neighbor_id"]
        ).alias("_n")
    )
    return lists.select("query_id", F.slice(F.concat(F.array("query_id"), F.col("_n")), 1, length).alias("ids"))


def hydrate(neighbors: DataFrame, sequences: DataFrame, seq_id: str, value: str, order: str = "rank") -> DataFrame:
    """Neighbour ids to their sequences, in rank order (a query has at most k of them)."""
    joined = neighbors.join(sequences.select(F.col(seq_id).alias("neighbor_id"), F.col(value).alias("_v")), "neighbor_id")
    return joined.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "_v"))), lambda s: s["_v"]).alias(value)
    )


def attach_documents(hits: DataFrame, passages: DataFrame, passage_id: str) -> DataFrame:
    return hits.join(passages.withColumnRenamed(passage_id, "neighbor_id"), "neighbor_id", "left")


def retrieve(
    questions: DataFrame, passages: DataFrame, k: int, dims: int, question_id: str, passage_id: str, vector: str
) -> DataFrame:
    """Top-k by inner product with the vectors; short results are padded (id -1, zero vector)."""
    hits = knn(questions, passages, k, "IP", question_id, passage_id, vector, exclude_self=False)
    slots = questions.select(
        F.col(question_id).alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
    )
    vecs = passages.select(F.col(passage_id).alias("neighbor_id"), F.col(vector).cast("array<double>").alias("_v"))
    found = hits.join(vecs, "neighbor_id")
    return slots.join(found, ["query_id", "rank"], "left").select(
        "query_id",
        "rank",
        F.coalesce("neighbor_id", F.lit(-1)).alias("neighbor_id"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("_v", F.array_repeat(F.lit(0.0), dims)).alias("vector"),
    )


def retrieve_filtered(
    queries: DataFrame, passages: DataFrame, k: int, text: str, min_words: int = 20, **cols: str
) -> DataFrame:
    """Fetch 2k hits, drop passages of at most ``min_words`` words, keep k; scores stay with their rows."""
    corpus_id = cols.get("corpus_id", "vec_id")
    hits = knn(queries, passages, 2 * k, "IP", exclude_self=cols.pop("exclude_self", True), **cols)
    long_enough = passages.filter(F.size(F.split(F.col(text), " ", -1)) > min_words).select(
        F.col(corpus_id).alias("neighbor_id")
    )
    kept = hits.join(long_enough, "neighbor_id", "left_semi").drop("rank")
    return top_per_group(kept, ["query_id"], [F.desc("score"), F.col("neighbor_id")], k, out="rank")


@dataclass(frozen=True)
class Postings:
    """``rows``: (field, term, passage_id, impact, level); ``blocks``: (field, term, level, n, low, high).

    A block holds the postings of a term whose impacts lie in one of ``levels`` equal steps below the
    term's largest; ``low`` and ``high`` bound them. ``hot`` says that a term has over ``HOT_POSTINGS`` of them.
    """

    rows: DataFrame
    blocks: DataFrame
    hot: bool


def impact_postings(
    passages: DataFrame, vocabulary: DataFrame, fields: dict[str, float], passage_id: str, k1: float, b: float, levels: int = 16
) -> Postings:
    """The impact of every term of ``vocabulary`` in every passage, from one pass over each field's tokens.

    The empty term, once in every passage, carries the passage's length to the field's averages.
    """
    known = vocabulary.select("term").union(vocabulary.sparkSession.createDataFrame([("",)], "term string")).distinct()
    counted = []
    for field in fields:
        toks = passages.select(F.col(passage_id).alias("passage_id"), F.coalesce(T.match_tokens(field), F.array().cast("array<string>")).alias("_t"))
        each = fan_out(toks, ["passage_id", F.size("_t").alias("len")], F.concat(F.array(F.lit("")), "_t"), "term")
        counted.append(
            each.join(known, "term", "left_semi").groupBy("term", "passage_id", "len").agg(F.count(F.lit(1)).alias("tf")).withColumn("field", F.lit(field))
        )
    posts = materialize(reduce(DataFrame.unionByName, counted))
    sizes = posts.filter("term = ''").groupBy("field").agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("mean"))  # one row per field
    terms = posts.filter("term <> ''").groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boost = F.create_map(*[x for f, w in fields.items() for x in (F.lit(f), F.lit(float(w)))])
    terms = materialize(terms.join(F.broadcast(sizes), "field").select("field", "term", "df", "mean", (boost[F.col("field")] * idf).alias("weight")))
    # document frequencies are known: only an index with a hot term needs salted joins
    hot = not terms.filter(F.col("df") > HOT_POSTINGS).isEmpty()
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.col("mean"))
    impact = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    key = ["field", "term"]
    scored = _joined(posts.filter("term <> ''"), terms.drop("df"), key, hot).select(*key, "passage_id", impact.alias("impact"))
    most = scored.groupBy(*key).agg(F.max("impact").alias("most"))
    level = F.least(F.floor(F.lit(levels) * F.col("impact") / F.col("most")), F.lit(levels - 1)).cast("int")
    rows = materialize(_joined(scored, most, key, hot).select(*key, "passage_id", "impact", level.alias("level")))
    blocks = rows.groupBy(*key, "level").agg(F.count(F.lit(1)).alias("n"), F.min("impact").alias("low"), F.max("impact").alias("high"))
    return Postings(rows, materialize(blocks), hot)


def _joined(postings: DataFrame, small: DataFrame, keys: list[str], hot: bool) -> DataFrame:
    return skew_join(postings, small, keys, "passage_id", hot_rows=HOT_POSTINGS) if hot else postings.join(small, keys)


def lexical_search(
    queries: DataFrame,
    passages: DataFrame,
    k: int,
    fields: dict[str, float],
    query_id: str = "query_id",
    query_text: str = "query",
    passage_id: str = "passage_id",
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """Term match with per-field boosts (BM25, best field wins), top k per query by unrounded scores.

    The answer is that of summing every posting, but most postings of frequent terms are not read:

    * the best small blocks of a query's terms give partial sums of at least ``k`` passages; the k-th of these is
      a score that every answer reaches;
    * terms whose largest impacts together stay below it can't bring a passage in alone; and of the other
      terms, blocks that don't reach it even with all other terms at their largest are skipped;
    * what is left are candidates, whose scores are then summed over all their terms in one order, so equal
      passages have equal scores. Ties go to the smaller id.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(T.match_tokens(query_text))).alias("term"))
    wanted = materialize(wanted.distinct())
    index = impact_postings(passages, wanted.select("term").distinct(), fields, passage_id, k1, b)
    key, pair = ["field", "term"], ["query_id", "field"]
    # small from here on: queries x terms x levels
    best = index.blocks.groupBy(*key).agg(F.max("high").alias("most"))
    asked = materialize(wanted.join(best, "term"))
    stack = asked.join(index.blocks, key)
    down = Window.partitionBy("query_id", *key).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    first = stack.withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0))).filter((F.col("above") < k) & (F.col("n") <= 64 * k))
    floor = _kth_score(_sums(index, first.select("query_id", *key, "level")), k)
    asked = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    rising = Window.partitionBy(*pair).orderBy("most", "term")
    asked = asked.withColumn("needed", F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("floor"))
    asked = materialize(asked.withColumn("others", F.sum("most").over(Window.partitionBy(*pair)) - F.col("most")))
    kept = asked.filter("needed").join(index.blocks.select(*key, "level", "high"), key).filter((F.col("high") + F.col("others")) * (1 + 1e-9) >= F.col("floor"))
    partial = materialize(_sums(index, kept.select("query_id", *key, "level")))
    # what the terms that were not needed could still add, against the k-th of the sums so far
    spare = asked.groupBy(*pair).agg(F.sum(F.when(~F.col("needed"), F.col("most")).otherwise(0.0)).alias("spare"))
    floor = _kth_score(partial, k)
    candidates = partial.join(spare, pair).join(floor, "query_id", "left")
    candidates = candidates.filter((F.col("score") + F.col("spare")) * (1 + 1e-9) >= F.coalesce("floor", F.lit(0.0))).select(*pair, "passage_id")
    full = candidates.join(asked.select(*pair, "term"), pair).join(index.rows.drop("level"), [*key, "passage_id"])
    terms = full.groupBy(*pair, "passage_id").agg(F.array_sort(F.collect_list(F.struct("term", "impact"))).alias("t"))
    scored = terms.select("query_id", "passage_id", F.aggregate("t", F.lit(0.0), lambda a, x: a + x["impact"]).alias("score"))
    whole = scored.groupBy("query_id", "passage_id").agg(F.max("score").alias("score"))
    return top_per_group(whole, ["query_id"], [F.desc("score"), F.col("passage_id")], k, out="rank")


def _kth_score(sums: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): a score that the k best passages of a query reach; no row for a query with fewer."""
    best = sums.groupBy("query_id", "passage_id").agg(F.max("score").alias("score"))
    kth = top_per_group(best, ["query_id"], [F.desc("score"), F.col("passage_id")], k, out="rank").filter(F.col("rank") == k)
    return kth.select("query_id", (F.col("score") * (1 - 1e-9)).alias("floor"))


def _sums(index: Postings, blocks: DataFrame) -> DataFrame:
    """(query_id, field, passage_id, score): impacts in the named blocks (query_id, field, term, level)."""
    found = _joined(index.rows, blocks, ["field", "term", "level"], index.hot)
    return found.groupBy("query_id", "field", "passage_id").agg(F.sum("impact").alias("score"))


def rank_of_gold(scores: DataFrame, query: str = "query_id", item: str = "item", score: str = "score", gold: str = "gold") -> DataFrame:
    """Rank of each query's gold item: one plus the items that beat it (ties go to the smaller item).

    Counting beats sorting: partial aggregates replace a window over all items of a query.
    """
    target = scores.filter(F.col(item) == F.col(gold)).select(query, F.col(score).alias("_gs"), F.col(item).alias("_gi"))
    better = (F.col(score) > F.col("_gs")) | ((F.col(score) == F.col("_gs")) & (F.col(item) < F.col("_gi")))
    return scores.join(target, query).groupBy(query).agg((F.sum(better.cast("long")) + 1).alias("rank"))


def rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean rank, mean reciprocal rank and accuracy at k."""
    hits = [F.round(F.avg((F.col("rank") <= k).cast("double")), DIGITS).alias(f"acc_{k}") for k in ks]
    return ranks.agg(
        F.round(F.avg("rank"), DIGITS).alias("mean_rank"),
        F.round(F.avg(F.lit(1.0) / F.col("rank")), DIGITS).alias("mrr"),
        *hits,
    )


def sample_queries(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """``n`` reproducible random rows (a global top-n, one bounded heap per task)."""
    return df.orderBy(seeded_key(seed, id_col), id_col).limit(n)
