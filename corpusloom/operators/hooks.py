"""User-supplied models: batch functions run where the rows are, loaded once per task.

Per-prompt and per-metric hooks are plain Column functions: see ``prompts.render_all(hooks=...)`` and
``metrics.TASK_METRICS``; a tokenizer is a Column function given to ``sequences.tokenize``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from corpusloom.functions.arrays import fan_out
def embed(df: DataFrame, fn, text: str, id_col: str, out: str = "embedding") -> DataFrame:
    """Apply a batch model ``fn(list of texts) -> 2-d array``; ``fn`` is loaded once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = np.asarray(fn(list(pdf[text])), dtype=np.float32)
            yield pd.DataFrame({id_col: pdf[id_col], out: list(vecs)})

    return df.select(id_col, text).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, {out} array<float>")


def score(df: DataFrame, fn: Callable, tokens: str, out: str = "loss", batch: int = 256) -> DataFrame:
    """Per-token losses by a batch model ``fn(list of token lists) -> list of float lists``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({out: fn(list(pdf[tokens]))})

    return predict(df, [tokens], run, f"{out} array<float>", batch)


def predict(df: DataFrame, cols: list[str], fn, schema: str, batch: int = 256) -> DataFrame:
    """Batch inference: ``fn(DataFrame of cols) -> DataFrame of the new columns``, ``batch`` rows a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch].reset_index(drop=True)
                yield pd.concat([part, fn(part[cols])], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kept}, {schema}")


def chunk_then_pack(df: DataFrame, key: str, chunks: Column, fn, schema: str, value: str, batch: int = 256) -> DataFrame:
    """Explode items to chunks, run ``fn`` over chunk batches, put results back in chunk order; an item without chunks gets none.

    An item's results are collected together; an item is one input row, so the group is as large as
    that row's chunk list.
    """
    rows = fan_out(df, [key], chunks, "chunk", "pos")
    done = predict(rows, ["chunk"], fn, schema, batch)
    lists = done.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias(value)
    )
    none = F.array().cast(lists.schema[value].dataType)
    return df.select(key).join(lists, key, "left").withColumn(value, F.coalesce(value, none))
