"""Greedy grouping of a long ordered sequence: a sequential fold, computed in parallel.

Every row has a weight and, if it starts a group, a room. A row joins the open group if its weight fits
into what is left of the group's room, in both of two dimensions; otherwise it starts a group. Packing
under a limit and batches of a size that their first row sets are both of this form.

The rows are cut into consecutive units. What a unit does to the open group at its entry depends only on
where its first cut falls: from that row on everything is settled by the unit itself. A unit is
therefore a table of first cuts and the exit that each leads to. Tables of neighbouring units are composed
into tables of larger ones, in a tree of fan ``FAN``. Going down again, the entry of a unit follows from
that of its parent and the tables of its elder siblings; then all units are replayed at once. The groups
are those of one pass over all rows, wherever the units end.

A table keeps only rows at which the sums of weights grow, up to the largest room, so it stays small
however many rows weigh nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

FAN = 256
NODE = "unit long, cums array<long>, exits array<long>, total array<long>, closed boolean"
ENTRY = "unit long, entry array<long>"
START = np.array([[-1, -1, -1, 0]])  # no room, no row, no group yet


@dataclass
class Table:
    """``cums``: (rows, 2) sums of weights up to each row that may be the first cut, this row included.

    ``exits``: what the fold has at the end if a row is the first cut: room left (2), the row that started
    the open group, and the groups started since. ``closed``: no open group survives the table.
    """

    cums: np.ndarray
    exits: np.ndarray
    total: np.ndarray
    closed: bool

    def apply(self, entries: np.ndarray) -> np.ndarray:
        at = np.minimum(*[np.searchsorted(self.cums[:, d], entries[:, d], "right") for d in (0, 1)])
        out = entries.copy()
        out[:, :2] -= self.total
        cut = np.flatnonzero(at < len(self.cums))
        out[cut] = self.exits[at[cut]]
        out[cut, 3] += entries[cut, 3]
        return out

    def row(self, unit: int) -> tuple:
        return unit, self.cums.ravel(), self.exits.ravel(), self.total, self.closed

    @staticmethod
    def of(row) -> Table:
        return Table(np.asarray(row.cums).reshape(-1, 2), np.asarray(row.exits).reshape(-1, 4), np.asarray(row.total), row.closed)


def _next_starts(weights: np.ndarray, rooms: np.ndarray) -> np.ndarray:
    """For a group started at each row, the first row that it can't take; the number of rows if none."""
    cums = np.cumsum(weights, axis=0)
    ends = [np.searchsorted(cums[:, d], cums[:, d] + rooms[:, d], "right") for d in (0, 1)]
    return np.maximum(np.minimum(*ends), np.arange(len(weights)) + 1)


def unit_table(weights: np.ndarray, rooms: np.ndarray, places: np.ndarray, most: np.ndarray) -> Table:
    n, cums = len(weights), np.cumsum(weights, axis=0)
    last, started = _chains(_next_starts(weights, rooms))
    exits = np.column_stack([rooms[last] - (cums[-1] - cums[last]), places[last], started])
    keep = np.append(True, (np.diff(cums, axis=0) > 0).any(axis=1))
    beyond = (cums > most).any(axis=1)
    closed = bool(beyond.any())
    if closed:
        keep[int(np.argmax(beyond)) + 1 :] = False
    return Table(cums[keep], exits[keep], cums[-1], closed)


def _chains(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each row on, if a group starts there: the last row that starts one, and their number."""
    n = len(after)
    step, last = np.append(after, n), np.append(np.where(after < n, -1, np.arange(n)), -1)
    started = np.append(np.ones(n, np.int64), 0)
    while (step[:n] < n).any():  # pointer doubling
        last = np.where(last < 0, last[step], last)
        started = started + started[step]
        step = step[step]
    return last[:n], started[:n]


def compose(tables: list[Table]) -> Table:
    """The table of consecutive units as one."""
    cums, exits, before = [], [], np.zeros(2, np.int64)
    closed = False
    for i, table in enumerate(tables):
        if not closed:
            ends = table.exits
            for later in tables[i + 1 :]:
                ends = later.apply(ends)
            cums.append(table.cums + before)
            exits.append(ends)
            closed = table.closed
        before = before + table.total
    return Table(np.concatenate(cums), np.concatenate(exits), before, closed)


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows[["wx", "wy"]].to_numpy(np.int64), rows[["rx", "ry"]].to_numpy(np.int64), rows["place"].to_numpy(np.int64)


def greedy_groups(rows: DataFrame, weights: Iterable[Column], rooms: Iterable[Column], unit: Column, order: list[Column], place: Column) -> DataFrame:
    """(place, start, grp) of every row: the ``place`` of its group's first row and the group's number from 0.

    ``unit`` is a whole number that never falls along the sequence and bounds the rows that one task holds;
    ``order`` (numbers) sorts the rows of a unit; ``place`` is a unique whole number. Units may be empty.
    """
    (wx, wy), (rx, ry) = weights, rooms
    sorts = [f"o{i}" for i in range(len(order))]
    cols = [c.cast("long").alias(n) for c, n in zip((unit, place, wx, wy, rx, ry), ("unit", "place", "wx", "wy", "rx", "ry"))]
    narrow = materialize(rows.select(*cols, *[c.alias(n) for c, n in zip(order, sorts)]))
    bounds = narrow.agg(F.max("rx"), F.max("ry"), F.max("unit"), F.min("unit")).first()
    if bounds[0] is None:
        return narrow.select("place", F.col("place").alias("start"), F.col("place").alias("grp"))
    most, first = np.array(bounds[:2]), bounds[3]
    narrow = narrow.withColumn("unit", F.col("unit") - first)

    def tabled(pdf: pd.DataFrame) -> pd.DataFrame:
        table = unit_table(*_arrays(pdf.sort_values(sorts)), most)
        return pd.DataFrame([table.row(int(pdf["unit"].iloc[0]))], columns=["unit", "cums", "exits", "total", "closed"])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        table = compose([Table.of(r) for r in pdf.itertuples()])
        return pd.DataFrame([table.row(int(pdf["unit"].iloc[0]) // FAN)], columns=["unit", "cums", "exits", "total", "closed"])

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("unit"), []
        state = np.asarray(pdf["entry"].iloc[0])[None, :]
        for r in pdf.itertuples():
            out.append((r.unit, state[0]))
            state = Table.of(r).apply(state)
        return pd.DataFrame(out, columns=["unit", "entry"])

    levels, span = [materialize(narrow.groupBy("unit").applyInPandas(tabled, NODE))], bounds[2] - first + 1
    while span > FAN:
        levels.append(materialize(levels[-1].groupBy(F.floor(F.col("unit") / FAN)).applyInPandas(composed, NODE)))
        span = -(-span // FAN)
    entries = levels[-1].select(F.lit(0).cast("long").alias("up"), F.array(*[F.lit(int(v)).cast("long") for v in START[0]]).alias("entry")).limit(1)
    for level in reversed(levels):
        children = level.withColumn("up", F.floor(F.col("unit") / FAN)).join(entries, "up")
        entries = children.groupBy("up").applyInPandas(entered, ENTRY).withColumnRenamed("unit", "up")
    entries = materialize(entries.withColumnRenamed("up", "unit"))

    def replayed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sorts)
        w, r, places = _arrays(pdf)
        room_x, room_y, start, count = (int(v) for v in pdf["entry"].iloc[0])
        cums, after = np.cumsum(w, axis=0), _next_starts(w, r)
        at = int(min(np.searchsorted(cums[:, 0], room_x, "right"), np.searchsorted(cums[:, 1], room_y, "right")))
        begins = np.zeros(len(w), bool)
        while at < len(w):
            begins[at] = True
            at = int(after[at])
        number = np.cumsum(begins)
        firsts = np.concatenate([[start], places[begins]])
        return pd.DataFrame({"place": places, "start": firsts[number], "grp": count + number - 1})

    return narrow.join(entries, "unit").groupBy("unit").applyInPandas(replayed, "place long, start long, grp long")
