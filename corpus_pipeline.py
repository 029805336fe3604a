"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and reads it again as
the next stage's ``docs``. All but the last return the columns of ``documents``. As a stage's input has
been written, a stage begins by deleting the copies that the stage before it made for itself.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fan_out
from corpusloom.llm import curriculum, jaccard_voronoi, prefix_bpe, secrets, weak_toxicity
from corpusloom.llm.files import shared_folder
from corpusloom.session import drop_copies, load, materialize, recorded_copies

# copies that the stage before made in this run; runs in other threads have their own
_COPIES: ContextVar[tuple[str, ...]] = ContextVar("copies", default=())

NEAR = jaccard_voronoi.Join(percent=80, n=5)


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_copies(spark, list(_COPIES.get()))
        with recorded_copies() as made:
            out = work(spark, docs, sf_dir)
        _COPIES.set(tuple(made))
        return out

    return run_stage


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number per row, written once so that every later reading finds the same numbers, and its name."""
    (row,) = fresh(docs, "row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id())), row


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the classifier learns from the labels of ``sf_dir``."""
    settings = weak_toxicity.Settings()
    model = weak_toxicity.fit(docs, load(spark, sf_dir, "labels"), settings)
    (toxicity,) = fresh(docs, "toxicity")
    scored = weak_toxicity.score(docs, model, tuple(docs.columns), name=toxicity)
    return scored.filter(F.col(toxicity) < settings.threshold).drop(toxicity)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Near copies share 80 percent of their sets of five words, whatever op8's own query takes.
    """
    rows, row = numbered(docs)
    groups = jaccard_voronoi.components(rows, NEAR, row_col=row)
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that the ledger's rules find replaced by a mask."""
    blob, hit, masked = fresh(docs, "blob", "hit", "masked")
    found = secrets.blobs_with_findings(docs, shared_folder(spark, "secret-ledger"))
    hits = found.select(F.col("blob").alias(blob), F.lit(True).alias(hit))
    marked = docs.withColumn(blob, secrets.blob_of(F.coalesce(F.col("text"), F.lit("")))).join(hits, blob, "left")
    rows = secrets.redact(marked.withColumn(masked, F.when(F.col(hit), F.col("text"))), masked)
    text = F.when(F.col(hit), F.col(masked)).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col(hit), F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them, to the nearest whole time, each reading at its own position.

    Documents of size 0 have no words to read: the mix reads them no time, so they are not in the result.
    """
    rows, row = numbered(docs)
    (position,) = fresh(docs, "position")
    plan = curriculum.placed(rows, row_col=row)
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    readings = fan_out(plan, [F.col("row").alias(row)], F.slice("positions", F.lit(1), times), position)
    return rows.join(readings, row).repartitionByRange(position, row).sortWithinPartitions(position, row).select(*docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

# Stages fit classifiers and run tokenizers: no SQL. tests/llm holds the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
