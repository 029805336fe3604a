"""Corpus cleaning: exact duplicates, unit limits and quality heuristics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fan_out
from corpusloom.functions import text as T
from corpusloom.ids import running_total, seeded_unit


def dedup_exact(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """One row per distinct value of ``col``: the smallest id.

    The value is hashed first, so the shuffle and the partial aggregate carry a fixed-width digest
    and an id, never the text; a value held by a third of the rows costs one row per map task.
    """
    return df.groupBy(F.sha2(F.col(col), 256).alias("digest")).agg(F.min(id_col).alias(id_col)).select(id_col)


def first_copy(df: DataFrame, digest: Column, id_col: str) -> DataFrame:
    """Rows that are the first of their digest in id order."""
    first = df.groupBy(digest.alias("_d")).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(first, id_col, "left_semi")


def duplicate_fraction(df: DataFrame, digest: Column, approximate: bool = False) -> DataFrame:
    """1 - distinct / total, from pre-aggregated digests (or a sketch)."""
    distinct = F.approx_count_distinct(digest) if approximate else F.count_distinct(digest)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct.alias("n_distinct"),
        (F.lit(1.0) - distinct / F.count(F.lit(1))).alias("fraction"),
    )


def limit_units(units: DataFrame, limit: int, doc_col: str = "doc_id") -> DataFrame:
    """Whole documents, in id order, until ``limit`` units are reached (the last one may overshoot)."""
    per_doc = units.groupBy(doc_col).agg(F.count(F.lit(1)).alias("_units"))
    before = running_total(per_doc, "_before", [doc_col], weight=F.col("_units"))
    return units.join(before.filter(F.col("_before") < limit).select(doc_col), doc_col, "left_semi")


def split_first_n(df: DataFrame, n: int, key: str, out: str = "split") -> DataFrame:
    """First ``n`` rows by key are ``valid``, the rest ``train``."""
    placed = running_total(df, "_pos", [key])
    return placed.withColumn(out, F.when(F.col("_pos") < n, "valid").otherwise("train")).drop("_pos")


@dataclass(frozen=True)
class QualityLimits:
    """Thresholds of the code-corpus filter."""

    line_max: float = 1000
    line_mean: float = 100
    alpha_frac: float = 0.25
    min_token_ratio: float = 1.5
    drop_share: float = 0.7


def quality_columns(text: str = "text") -> dict[str, Column]:
    return {
        "hash": T.content_hash(text),
        "line_mean": T.line_mean(text),
        "line_max": T.line_max(text),
        "alpha_frac": T.alnum_fraction(text),
        "ratio": T.chars_per_token(text),
        "autogenerated": T.is_autogenerated(text),
        "config_or_test": T.is_config_or_test(text),
        "has_no_keywords": T.has_no_code_words(text),
        "has_few_assignments": T.has_few_assignments(text),
    }


def passes_quality(text: str, id_col: str, limits: QualityLimits = QualityLimits(), seed: int = 0) -> Column:
    """One boolean expression over the text; the two random tests draw independently per row."""
    q = quality_columns(text)
    unlucky_config = q["config_or_test"] & (seeded_unit(seed, F.lit("config"), F.col(id_col)) < limits.drop_share)
    unlucky_plain = q["has_no_keywords"] & (seeded_unit(seed, F.lit("plain"), F.col(id_col)) < limits.drop_share)
    return ~(
        q["autogenerated"]
        | (q["line_max"] > limits.line_max)
        | (q["line_mean"] > limits.line_mean)
        | (q["alpha_frac"] < limits.alpha_frac)
        | (q["ratio"] < limits.min_token_ratio)
        | unlucky_config
        | unlucky_plain
        | q["has_few_assignments"]
    )


def quality_filter(
    df: DataFrame, text: str, id_col: str, limits: QualityLimits = QualityLimits(), seed: int = 0
) -> DataFrame:
    """First copies that pass the heuristics.

    Duplicates are settled before the heuristics: when the first copy fails, later copies do not
    take its place.
    """
    unique = first_copy(df, T.content_hash(text), id_col)
    return unique.filter(passes_quality(text, id_col, limits, seed))


def drop_short_sequences(df: DataFrame, tokens: str = "tokens", longer_than: int = 11) -> DataFrame:
    return df.filter(F.size(tokens) > longer_than)


def drop_unknown(df: DataFrame, unknown: int, tokens: str = "tokens", share: float = 0.5) -> DataFrame:
    """Rows of which less than ``share`` is unknown; an empty sequence has nothing known and goes."""
    hits = F.size(F.filter(F.col(tokens), lambda x: x == unknown))
    return df.filter(hits < share * F.size(tokens))


def token_counts(df: DataFrame, vocab_size: int, tokens: str = "tokens") -> DataFrame:
    """Occurrences per token id, zero for ids that do not occur."""
    seen = fan_out(df, [], tokens, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ids = df.sparkSession.range(vocab_size).select(F.col("id").cast("long").alias("token"))
    seen = seen.select(F.col("token").cast("long").alias("token"), "n")
    return ids.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def masking_weights(counts: DataFrame, smoothing: float, special: list[int]) -> DataFrame:
    weight = F.pow(F.greatest(F.col("n"), F.lit(1)).cast("double"), F.lit(-smoothing))
    return counts.withColumn("weight", F.when(F.col("token").isin(special), F.lit(0.0)).otherwise(weight))


def zscore(df: DataFrame, col: str, out: str = "z") -> DataFrame:
    """(x - mean) / population deviation; the statistics are one row, broadcast."""
    stats = df.agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, (F.col(col) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def length_histogram(df: DataFrame, bins: list[int], length: Column) -> DataFrame:
    """Right-bisect bin number of each length and how many rows fall in it."""
    arr = F.array(*[F.lit(b) for b in bins])
    return (
        df.select(F.size(F.filter(arr, lambda b: b <= length)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def most_frequent_value(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """All values having the largest count in their group (counts are aggregated before ranking)."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("n"))))
    return ranked.filter(F.col("_r") == 1).drop("_r")
