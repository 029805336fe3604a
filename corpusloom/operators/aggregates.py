"""A user's own metric as an aggregate: init, update, merge, finish.

Every task keeps one partial state per group that it meets and updates it with its own rows, batch by
batch. Partial states are merged by group, at most ``fan`` tasks at a time, and only then finished. A
metric over one group, or over a group with most of the rows, never gathers that group's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL = "key string, part long, states binary"


@dataclass(frozen=True)
class Metric:
    """``update`` takes a state and some rows of a group; ``finish`` gives named values.

    The order of rows and of merges is not fixed: ``merge`` must not depend on it.
    """

    init: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict[str, float]]


def user_metrics(
    df: DataFrame, metrics: dict[str, Metric], cols: list[str], keys: list[str] | None = None, most_groups: int = 10_000, fan: int = 256
) -> DataFrame:
    """(keys, metric, name, value) of every group; metrics see the columns ``cols``.

    A task holds the states of at most ``most_groups`` groups; beyond that it hands on what it has and goes
    on with new states. Without rows there is no group.
    """
    keys, names = list(keys or []), list(metrics)
    parts = list(metrics.values())

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[Any]] = {}
        part = TaskContext.get().partitionId()

        def handed() -> pd.DataFrame:
            return pd.DataFrame([(k, part, cloudpickle.dumps(s)) for k, s in held.items()], columns=["key", "part", "states"])

        for pdf in batches:
            for key, rows in pdf.groupby("key", sort=False):
                states = held.get(key) or [m.init() for m in parts]
                held[key] = [m.update(s, rows[cols]) for m, s in zip(parts, states)]
                if len(held) >= most_groups:
                    yield handed()
                    held = {}
        yield handed()

    def merged(pdf: pd.DataFrame) -> list[Any]:
        return reduce(lambda a, b: [m.merge(x, y) for m, x, y in zip(parts, a, b)], map(cloudpickle.loads, pdf["states"]))

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["key"].iloc[0], pdf["part"].iloc[0] // fan, cloudpickle.dumps(merged(pdf)))], columns=["key", "part", "states"])

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(n, k, float(v)) for n, m, s in zip(names, parts, merged(pdf)) for k, v in m.finish(s).items()]
        out = pd.DataFrame(rows, columns=["metric", "name", "value"])
        out.insert(0, "key", pdf["key"].iloc[0])
        return out

    key = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    states = df.select(key.alias("key"), *cols).mapInPandas(partial, PARTIAL)
    states = states.groupBy("key", F.floor(F.col("part") / fan)).applyInPandas(some, PARTIAL)
    out = states.groupBy("key").applyInPandas(finished, "key string, metric string, name string, value double")
    if not keys:
        return out.drop("key")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return out.withColumn("key", F.from_json("key", schema)).select(*[F.col(f"key.`{k}`") for k in keys], "metric", "name", "value")
