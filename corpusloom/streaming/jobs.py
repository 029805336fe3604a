"""Structured Streaming jobs: packing, bounded shuffle and cleaning of arriving documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import text as T
from corpusloom.ids import seeded_key
from corpusloom.operators.corpus import QualityLimits, passes_quality

PACKED = "shard int, block long, tokens array<string>"
CARRY = "held array<string>, done long, next long, early array<long>, waiting array<string>"
# Tokens of finished blocks that a task holds before they leave.
TOKENS_OUT = 1 << 17


def stream_pack(stream: DataFrame, length: int, end_token: str, shards: int, order: str, tokens: str = "tokens") -> DataFrame:
    """Token lists in any order of arrival to blocks of exactly ``length``, per shard, each list closed by ``end_token``.

    ``order`` numbers the lists 0, 1, 2, ... without gaps; a shard is ``order mod shards``. A list that comes before
    its predecessors waits in the shard's state, and lists are packed strictly by their numbers, so the
    blocks of a shard equal those of packing it in one batch, however the input is cut into files and
    micro-batches. A number that comes again raises an error. State holds the unfinished block, the number that
    is due and the lists that wait for it; a gap keeps later lists waiting. Use more shards than the
    cluster has slots.

    A list moves and waits as one JSON text: an array of strings takes several times its bytes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done, due, early, waiting = state.get if state.exists else ([], 0, int(key[0]), [], [])
        buffer, ready = list(held), dict(zip(early, waiting))
        rows: list[tuple[int, int, list[str]]] = []
        for arrived in frames:
            for o, toks in zip(arrived["o"], arrived["t"]):
                if o < due or o in ready:
                    raise ValueError(f"list {o} came twice")
                ready[int(o)] = toks
            while due in ready:
                buffer.extend(json.loads(ready.pop(due)))
                buffer.append(end_token)
                due += shards
                full = len(buffer) // length * length
                rows += [(int(key[0]), done + i, buffer[i * length : (i + 1) * length]) for i in range(full // length)]
                done, buffer = done + full // length, buffer[full:]
                if len(rows) * length >= TOKENS_OUT:
                    yield pd.DataFrame(rows, columns=["shard", "block", "tokens"])
                    rows = []
        state.update((buffer, done, due, list(ready), list(ready.values())))
        yield pd.DataFrame(rows, columns=["shard", "block", "tokens"])

    rows = stream.select(
        F.pmod(F.col(order), F.lit(shards)).cast("int").alias("shard"), F.col(order).cast("long").alias("o"), F.to_json(tokens).alias("t")
    )
    return rows.groupBy("shard").applyInPandasWithState(step, PACKED, CARRY, "append", GroupStateTimeout.NoTimeout)


def stream_shuffle(stream: DataFrame, seed: int, key: str, write: Callable[[DataFrame, int], None]):
    """Each micro-batch is the shuffle buffer: its rows reach ``write`` in a reproducible random order.

    The buffer size is the source's own limit per trigger (``maxFilesPerTrigger`` and the like).
    """

    def one(batch: DataFrame, epoch: int) -> None:
        write(batch.orderBy(seeded_key(seed, F.lit(epoch), key), key), epoch)

    return stream.writeStream.foreachBatch(one)


def stream_clean(
    stream: DataFrame,
    text: str,
    id_col: str,
    limits: QualityLimits = QualityLimits(),
    min_chars: int = 20,
    event_time: str | None = None,
    keep_for: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Cleaned documents of a stream: first copies by whitespace-free hash that pass the heuristics.

    Hash state grows with the number of distinct documents; give ``event_time`` and ``keep_for`` to
    forget hashes after a time. The hash is consumed before the heuristics, as in the batch job.
    """
    rows = stream.filter(F.length(text) >= min_chars).withColumn("hash", T.content_hash(text))
    if event_time and keep_for:
        unique = rows.withWatermark(event_time, keep_for).dropDuplicatesWithinWatermark(["hash"])
    else:
        unique = rows.dropDuplicates(["hash"])
    return unique.filter(passes_quality(text, id_col, limits, seed))
