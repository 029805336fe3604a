"""Sinks: each task writes its own files, by a plain DataFrame write or, for a file per row, through Arrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

UINT16_VOCAB = 65_536


def write_docs(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(T.encode_newlines(text).alias("value")).write.text(path)


def write_records(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, one directory per dataset / prompt / split."""
    df.write.partitionBy(*(by or ["dataset", "prompt", "split"])).json(path)


def write_sharded_json(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    df.write.option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).json(path)


def narrow_ids(df: DataFrame, vocab_size: int, tokens: str = "tokens") -> DataFrame:
    """Smallest signed type that holds the vocabulary (ids up to 65,535 need ``int``)."""
    kind = "tinyint" if vocab_size <= 128 else "smallint" if vocab_size <= 32_768 else "int"
    return df.withColumn(tokens, F.col(tokens).cast(f"array<{kind}>"))


def write_sequences(df: DataFrame, path: str, vocab_size: int | None = None, tokens: str = "tokens") -> None:
    """Variable-length sequences with their size."""
    out = df.withColumn("n_tokens", F.size(tokens))
    (narrow_ids(out, vocab_size, tokens) if vocab_size else out).write.parquet(path)


def write_embeddings(df: DataFrame, path: str, vector: str = "embedding") -> None:
    df.withColumn(vector, F.col(vector).cast("array<float>")).write.mode("append").parquet(path)


def write_conll(sentences: DataFrame, path: str) -> None:
    """One ``word label`` line per word and a blank line after each sentence.

    A sentence becomes one text value, so its lines stay together whichever task writes it.
    """
    lines = F.zip_with("words", "labels", lambda w, l: F.concat_ws(" ", w, l))
    body = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    sentences.select("file", "sent", body.alias("value")).sortWithinPartitions("file", "sent").select("value").write.text(path)


def write_parallel(pairs: DataFrame, path: str, src: str, tgt: str, order: str, split: str = "split") -> None:
    """Line-aligned source and target files per split (``validation`` becomes ``val``).

    Both sides are written from one sorted, materialised frame so that their part files agree.
    """
    from corpusloom.session import materialize

    named = pairs.withColumn(split, F.when(F.col(split) == "validation", "val").otherwise(F.col(split)))
    ordered = materialize(named.repartitionByRange(split, order).sortWithinPartitions(split, order))
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" ")).alias("value")
    for side in (src, tgt):
        ordered.select(split, flat(side)).write.partitionBy(split).text(f"{path}/{side}")


def write_report(lines: DataFrame, path: str) -> None:
    """One text directory per dataset from (dataset, part, place, line)."""
    ordered = lines.repartitionByRange("dataset", "part", "place").sortWithinPartitions("dataset", "part", "place")
    ordered.select("dataset", F.col("line").alias("value")).write.partitionBy("dataset").text(path)


def write_stories(df: DataFrame, path: str, text: str = "value") -> list[str]:
    """One file per row under ``path``, written by the tasks; returns the folders that hold them, one per task.

    A task that is tried again writes a folder of its own, and only folders of finished tasks are returned. As
    in Spark's text files a line break ends the row, and a row without text is that alone.
    """
    local = urlsplit(path).scheme in ("", "file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = (fs.LocalFileSystem(), urlsplit(path).path) if local else fs.FileSystem.from_uri(path)
        name = f"story-{uuid.uuid4().hex}"
        made = 0
        for pdf in batches:
            for value in pdf[text]:
                if not made:
                    files.create_dir(f"{root}/{name}", recursive=True)
                with files.open_output_stream(f"{root}/{name}/{made}.story") as out:
                    out.write(f"{value or ''}\n".encode())
                made += 1
        if made:
            yield pd.DataFrame({"name": [name]})

    folders = df.select(text).mapInPandas(run, "name string").collect()
    return [f"{path}/{r['name']}" for r in folders]
