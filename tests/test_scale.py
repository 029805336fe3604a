"""Answers do not depend on partitioning or slab size, and plans keep their shape."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.ids import dense_ids, running_total, shuffled_ids
from corpusloom.operators import contrastive as C
from corpusloom.operators import sampling as G
from corpusloom.operators import sequences as Q
from corpusloom.operators.skew import skew_join
from corpusloom.plans import all_queries
from corpusloom.plans.prompting import datasets
from corpusloom.plans.registry import QUERIES
from corpusloom.session import dealt, load


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows share one key, and most share one value."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"), "id", F.when(F.col("id") % 5 > 0, 1.5).otherwise(F.col("id") / 10.0).alias("x")
    )


@pytest.mark.parametrize("slab", [7, 64, 100_000])
@pytest.mark.parametrize("parts", [1, 4, 32])
def test_running_total_dense(hot, slab, parts):
    from pyspark.sql import Window

    got = running_total(hot.repartition(parts), "p", ["id"], keys=["k"], weight=F.col("id"), slab=slab, total="n").select("k", "id", "p", "n")
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = hot.select("k", "id", F.coalesce(F.sum("id").over(w), F.lit(0)), F.sum("id").over(Window.partitionBy("k")))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("descending", [False, True])
def test_running_total_with_heavy_ties(hot, descending):
    from pyspark.sql import Window

    got = running_total(hot, "p", ["x", "id"], spread="range", descending=descending).select("id", "p")
    order = [F.desc("x"), F.desc("id")] if descending else ["x", "id"]
    want = hot.select("id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).alias("p"))
    assert rows(got) == rows(want)


def test_positions_are_a_permutation(hot):
    assert sorted(r.nid for r in dense_ids(hot, "id", slab=10).collect()) == list(range(900))
    once = rows(shuffled_ids(hot.repartition(1), 5, "id").select("id", "nid"))
    again = rows(shuffled_ids(hot.repartition(16), 5, "id").select("id", "nid"))
    assert once == again and sorted(n for _, n in once) == list(range(900))


def test_skew_join_equals_join(spark, hot):
    small = spark.createDataFrame([(0, "zero"), (3, "three")], "k long, name string")
    for how in ("inner", "left"):
        got = skew_join(hot, small, ["k"], "id", how, hot_rows=50).select("k", "id", "name")
        assert rows(got) == rows(hot.join(small, "k", how).select("k", "id", "name"))


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_pack_is_independent_of_partitions(spark, sf, parts):
    docs = load(spark, sf, "documents").select("doc_id", T.regex_tokens("text").alias("tokens"))
    got = Q.pack(docs.repartition(parts), 128, "doc_id", end_token=F.lit("<end>"))
    flat = [t for r in docs.orderBy("doc_id").collect() for t in [*r.tokens, "<end>"]]
    want = [flat[i : i + 128] for i in range(0, len(flat) - 127, 128)]
    assert [r.tokens for r in got.orderBy("block").collect()] == want


def test_negatives_hold_their_promises(spark, sf):
    sets = datasets(spark, sf)
    pool = C.rendered_pool(sets)
    easy = C.easy_negatives(pool, pool, 3, 1).collect()
    assert easy
    for r in easy:
        texts = [x.text for x in r.negatives]
        assert len(texts) == len(set(texts)) == 3
        assert all(not x.label.startswith(r.dataset + "-") for x in r.negatives)
    hard = C.hard_negatives(pool, sets, 2, 1).collect()
    assert all(len(r.negatives) == 2 and all(x.label.endswith("-" + r.prompt) for x in r.negatives) for r in hard)
    pairs = C.pair_positive(pool, 1)
    assert pairs.filter("id = pos_id").count() == 0
    assert pairs.count() == pool.filter("fits").count()


def test_easy_negatives_need_no_digests_and_leave_out_twins(spark):
    # the pool has no hash; a and b share the text of id 0, and so do draws of a c row
    rows = [(d, "p", i, "same" if i == 0 and d != "c" else f"{d} {i}", True) for d, n in (("a", 2), ("b", 2), ("c", 30)) for i in range(n)]
    pool = spark.createDataFrame(rows, "dataset string, prompt string, id long, text string, fits boolean")
    got = C.easy_negatives(pool, pool, 4, 3, 20).collect()
    assert len(got) == 34
    for r in got:
        texts = [x.text for x in r.negatives]
        assert len(texts) == len(set(texts)) and r.short == (len(texts) < 4)
        # the other datasets of a c row hold three texts, and 24 draws find them all
        assert r.dataset != "c" or sorted(t[:2] for t in texts) == ["a ", "b ", "sa"]
        assert all(x.label in {"a-p", "b-p", "c-p"} - {r.dataset + "-p"} for x in r.negatives)


def test_batches(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.n_tokens("text").alias("len"))
    n = docs.count()
    budget = G.token_budget_batches(docs, 4096, "len", "id", 8)
    assert budget.select("id").distinct().count() == budget.count() == n
    per = budget.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("m"))
    assert per.filter((F.col("n") > 1) & (F.col("n") * F.col("m") > 4096)).count() == 0
    sortish = G.sortish_batches(docs, 8, 2, "len", "id")
    assert sortish.select("id").distinct().count() == sortish.count() == n
    first = sortish.filter("batch = 0 and place = 0").first()
    assert first.len == docs.agg(F.max("len")).first()[0]
    ranks = G.assign_workers(docs, 3, "id").groupBy("worker").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len({r.n for r in ranks}) == 1


def test_epochs_do_not_repeat_within_a_pass(spark):
    df = spark.range(10).select(F.lit("d").alias("dataset"), "id")
    out = G.epoch_index(df, 5, 4, 3, ["dataset"]).collect()
    per = [[r.id for r in out if r.epoch == e] for e in range(5)]
    assert all(len(x) == 4 for x in per)
    flat = [r.id for r in sorted(out, key=lambda r: (r.epoch, r.place))]
    assert sorted(flat[:10]) == sorted(flat[10:20]) == list(range(10))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    docs = load(spark, sf, "documents")
    top = plan_of(G.take_pool(docs.select("doc_id", "lang"), 5, ["lang"], "doc_id"))
    assert "WindowGroupLimit" in top
    packed = plan_of(Q.pack(docs.select("doc_id", T.regex_tokens("text").alias("tokens")), 128, "doc_id"))
    assert "CartesianProduct" not in packed and "BroadcastNestedLoopJoin" not in packed
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in packed


def test_tables_of_few_partitions_are_dealt_out(spark, sf):
    few = spark.range(0, 1000, 1, 1).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), "id")
    slots = spark.sparkContext.defaultParallelism
    assert dealt(few, "k").rdd.getNumPartitions() == slots
    many = dealt(few, "k", rows=20)
    assert many.rdd.getNumPartitions() == 50 and rows(many) == rows(few)
    assert dealt(few.limit(0), "k").count() == 0
    assert all(d.records.rdd.getNumPartitions() >= slots for d in datasets(spark, sf))


@pytest.mark.parametrize("name", ["d03_pair_positive", "g04_cap_per_prompt"])
def test_records_are_rendered_once(spark, sf, name):
    assert "Generate" not in plan_of(QUERIES[name](spark, sf))


def test_vocabulary_and_frequent_tokens_do_not_split_all_texts_again(spark, sf):
    plan = all_queries()["i02_encode"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # the sequences, what they ask for, and a part of them (once per side of the join) for its frequent tokens
    assert plan.count("regexp_extract_all") <= 4


def test_frequent_keys_seen_in_a_part_change_no_row(spark, hot):
    small = spark.createDataFrame([(0, "zero"), (3, "three")], "k long, name string")
    part = hot.filter(F.col("id") % 10 == 0)
    for how in ("inner", "left"):
        got = skew_join(hot, small, ["k"], "id", how, hot_rows=50, seen=part, share=10).select("k", "id", "name")
        assert rows(got) == rows(hot.join(small, "k", how).select("k", "id", "name"))
