"""Queries: streaming jobs run to completion over the tables, and model hooks."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import hooks as H
from corpusloom.operators.corpus import QualityLimits
from corpusloom.plans.registry import query, table, toks, wide
from corpusloom.plans.text import _quality_sql
from corpusloom.session import checkpoint_root
from corpusloom.streaming import jobs


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input and read what it wrote."""
    root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


SHARDS = 32


@query(
    "k01_stream_pack",
    f"""with s as (select doc_id, doc_id % {SHARDS} as shard, list_append({toks('text')}, '<end>') as t from documents),
    o as (select *, sum(len(t)) over (partition by shard order by doc_id) - len(t) as off from s),
    x as (select shard, off + generate_subscripts(t, 1) - 1 as pos, unnest(t) as v from o)
    select shard::bigint as shard, (pos // 512)::bigint as block, md5(string_agg(v, ' ' order by pos)) as digest from x group by 1, 2 having count(*) = 512""",
)
def stream_pack(spark, sf):
    docs = source(spark, sf, "documents").select("doc_id", T.regex_tokens("text").alias("tokens"))
    out = drain(spark, jobs.stream_pack(docs, 512, "<end>", SHARDS, "doc_id"), "pack")
    return out.select(F.col("shard").cast("long").alias("shard"), "block", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("k02_stream_shuffle", "select event_id, event_type from events")
def stream_shuffle(spark, sf):
    root = f"{checkpoint_root(spark)}/shuffle-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    events = source(spark, sf, "events").select("event_id", "event_type")
    run = jobs.stream_shuffle(events, 5, "event_id", write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type")


@query(
    "k03_chunk_then_pack",
    f"""with c as (select doc_id, {toks('text')} as t from documents), g as (select doc_id, t, unnest(generate_series(1, len(t), 64)) as s from c),
    z as (select doc_id, string_agg(len(list_slice(t, s, s + 63))::varchar, ',' order by s) as sizes from g group by 1)
    select doc_id, coalesce(sizes, '') as sizes from documents left join z using (doc_id)""",
)
def chunk_then_pack(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text").select("doc_id", T.regex_tokens("text").alias("t"))
    starts = F.when(F.size("t") > 0, F.sequence(F.lit(1), F.size("t"), F.lit(64))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda s: F.slice("t", s, F.lit(64)))

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(c) for c in pdf["chunk"]]})

    out = H.chunk_then_pack(rows, "doc_id", chunks, sizes, "n long", "n")
    return out.select("doc_id", F.array_join(F.col("n").cast("array<string>"), ",").alias("sizes"))


# any copy of a text may arrive first in a stream, so copies are compared by their hash
@query(
    "k04_stream_clean",
    r"select distinct md5(regexp_replace(html, '\s+', '', 'g')) as hash from pages where page_id in (" + _quality_sql(0) + ") and length(html) >= 20",
)
def stream_clean(spark, sf):
    limits = QualityLimits(line_max=100_000, line_mean=100_000, drop_share=0.0)
    pages = source(spark, sf, "pages").select("page_id", "html")
    return drain(spark, jobs.stream_clean(pages, "html", "page_id", limits), "clean").select("hash")


@query("l04_embed", "select item_id, length(text)::double as first, (length(text) - length(replace(text, 'e', '')))::double as second from benchmark")
def embed(spark, sf):
    def model(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count("e")] for t in texts], dtype=np.float32)

    out = H.embed(table(spark, sf, "benchmark"), model, "text", "item_id")
    return out.select("item_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.get("embedding", F.lit(1)).cast("double").alias("second"))


@query("l06_predict", "select conv_id, turn, (length(text) + length(role))::bigint as score from conversations")
def predict(spark, sf):
    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": pdf["text"].str.len() + pdf["role"].str.len()})

    out = H.predict(table(spark, sf, "conversations"), ["text", "role"], model, "score long", batch=64)
    return out.select("conv_id", "turn", "score")


@query("l05_score", f"select conv_id, turn, len({toks('text')})::bigint as n, round(coalesce(list_sum(list_transform({toks('text')}, lambda t: length(t) / 8.0)), 0)::double, 4) as loss from conversations")
def score(spark, sf):
    def model(rows: list[list[str]]) -> list[np.ndarray]:
        return [np.array([len(t) / 8.0 for t in toks], dtype=np.float32) for toks in rows]

    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.regex_tokens("text").alias("tokens"))
    out = H.score(rows, model, "tokens")
    total = F.aggregate("loss", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("conv_id", "turn", F.size("loss").cast("long").alias("n"), F.round(total, 4).alias("loss"))
