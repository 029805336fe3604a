"""End-to-end compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import knn as K
from corpusloom.operators import segment as S
from corpusloom.plans.registry import query, table, wide


def clean_paragraphs(spark: SparkSession, sf: str, budget: int = 128) -> DataFrame:
    """Distinct flattened paragraph units: (para_id, doc_id, ord, text, n_tokens)."""
    docs = S.drop_short_docs(wide(spark, sf, "documents", "doc_id", "text"))
    units = S.segment_paragraphs(docs, budget)
    flat = units.select("doc_id", "ord", T.flatten_whitespace("text").alias("text"))
    flat = flat.withColumn("para_id", F.col("doc_id") * 1_000_000 + F.col("ord"))
    keep = C.dedup_exact(flat, "text", "para_id")
    kept = flat.join(keep, "para_id", "left_semi")
    return kept.withColumn("n_tokens", T.n_tokens("text"))


def neighbour_paragraphs(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """Nearest neighbours of every vector with the size of the neighbour's cleaned document."""
    vectors = table(spark, sf, "embeddings", "vec_id", "embedding")
    hits = K.knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors, k)
    sizes = clean_paragraphs(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.sum("n_tokens").alias("n_tokens")
    )
    joined = hits.join(sizes.withColumnRenamed("doc_id", "neighbor_id"), "neighbor_id", "left")
    return joined.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "neighbor_id",
        F.round("score", 6).alias("score"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
    )


def _sql() -> str:
    from corpusloom.plans.text import SEGMENT_SQL
    from corpusloom.plans.registry import strip, toks

    flat = strip("replace(text, chr(10), chr(32))")
    return (
        SEGMENT_SQL
        + f""", flat as (select doc_id, ord, {flat} as text, doc_id * 1000000 + ord as para_id from units),
    kept as (select doc_id, text from flat where para_id in (select min(para_id) from flat group by text)),
    sizes as (select doc_id, count(*)::bigint as n_paragraphs, sum(len({toks('text')}))::bigint as n_tokens from kept group by doc_id),
    v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    d as (select a.vec_id as query_id, b.vec_id as neighbor_id,
            list_sum(list_transform(generate_series(1, len(a.e)), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) as score
          from v a join v b on a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by query_id order by score, neighbor_id) as rank from d)
    select query_id, rank::bigint as rank, neighbor_id, round(score, 6) as score, coalesce(n_paragraphs, 0)::bigint as n_paragraphs, coalesce(n_tokens, 0)::bigint as n_tokens
    from r left join sizes on sizes.doc_id = r.neighbor_id where rank <= 20"""
    )


query("p01_neighbour_paragraphs", _sql())(neighbour_paragraphs)
