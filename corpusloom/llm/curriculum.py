"""Mixing sources to target weights with a curriculum that varies over the training run.

Each source has a weight and a *schedule*: how its demand is spread over the run, as a line between
knots over progress 0 to 1. The integral of a schedule, scaled to the source's target, is its
cumulative demand in words; the inverse of that integral turns a document's place in its source's
word order into the position in the run at which it is read.

Documents of a source are ordered by a seeded hash. Offsets in that order come from two levels of
sums, slabs and rows of a slab, so that a source that holds a third of all rows is never in one task.
The number of slabs follows from the number of rows.

Defined results: a null text has size 0; a null source is a source of its own, after all others;
documents of size 0 are kept with nothing taken and no position; an empty table gives an empty result; repeated ids
are separate documents; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.ids import HASH_BITS, seeded_key
from corpusloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` and ``schedules`` repeat over the sources in code-point order.

    A schedule is the demand at equally spaced knots over the run; only its shape matters.
    ``most`` is how often a source may be read. ``slab_rows`` bounds the rows of one slab.
    """

    weights: tuple[float, ...] = (1, 2, 3)
    schedules: tuple[tuple[float, ...], ...] = ((3, 2, 1), (1, 1, 1), (1, 2, 3))
    most: int = 3
    seed: int = 17
    slab_rows: int = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target, turn) of (source, source_size); one row per source.

    A source at its limit keeps ``most`` times its size. With sources in order of limit over weight,
    those at their limit come first; the level of the others is what the first of them would get,
    and the levels computed for later ones are lower.
    """
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").isNull(), "source")
    by_limit = whole.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("turn") % len(mix.weights) + 1).cast("int"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(by_limit), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0))
    return (
        sizes.withColumn("turn", turn.cast("int"))
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * mix.most)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("level", left / weight_left)
        .withColumn("open", F.col("ratio") > F.col("level"))
        .withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(whole))
        .select(
            "source",
            "source_size",
            "turn",
            F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("limit").cast("double")).alias("target"),
        )
    )


def inverse_schedule(share: Column, schedule: tuple[float, ...]) -> Column:
    """The progress at which the integral of ``schedule`` reaches ``share`` of its whole."""
    step = 1.0 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    total, before, at = sum(areas), 0.0, F.lit(1.0)
    cases = []
    for i, area in enumerate(areas):
        cases.append((before, before + area, i))
        before += area
    for low, high, i in reversed(cases):
        a, b = schedule[i], schedule[i + 1]
        need = share * total - low
        slope = (b - a) / step
        # a * x + slope / 2 * x^2 = need, written so that slope 0 needs no case of its own
        x = 2 * need / (a + F.sqrt(F.greatest(a * a + 2 * slope * need, F.lit(0.0))))
        at = F.when(share * total <= high, F.lit(i * step) + x).otherwise(at)
    return at


def placed(
    docs: DataFrame,
    mix: Mix = Mix(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken, positions, position) of every document, in no order.

    ``taken`` counts the words read from the document, repeats included; at the end of a source's
    demand a document may be read in part. ``positions`` has the progress at each reading, the whole
    source lying between two readings of one document; ``position`` is the first of them, null if the
    document is never read. ``row`` is ``row_col``, null without one.
    """
    sized = materialize(
        docs.select(
            (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
            seeded_key(mix.seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
        )
    )
    slabs = sized.count() // mix.slab_rows + 1
    half = HASH_BITS // 2
    sized = sized.withColumn("slab", F.shiftright(F.shiftright("key", half) * slabs, half))
    per_slab = sized.groupBy("source", "slab").agg(F.sum("size").alias("slab_size"))
    targets = source_targets(per_slab.groupBy("source").agg(F.sum("slab_size").alias("source_size")), mix)
    before = Window.partitionBy("source").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_slab.withColumn("offset", F.coalesce(F.sum("slab_size").over(before), F.lit(0)))
        .withColumnRenamed("source", "name")
        .join(targets, F.col("name").eqNullSafe(F.col("source")))
        .drop("source")
        .withColumnRenamed("slab", "part")
    )
    inside = (
        Window.partitionBy("source", "slab").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("name")) & (F.col("slab") == F.col("part"))
    )
    at = F.col("offset") + F.col("inside")
    size, whole = F.col("size"), F.col("source_size")
    goal = F.round(F.col("target")).cast("long")
    rounds = F.when(whole > 0, F.floor(goal / whole)).otherwise(0)
    rest = goal - rounds * whole
    part = F.greatest(F.lit(0), F.least(size, rest - at))
    readings = F.when(size > 0, rounds).otherwise(0) + (part > 0).cast("long")

    def position(reading: Column) -> Column:
        share = (at + reading * whole) / F.greatest(F.col("target"), F.lit(1.0))
        shapes = [inverse_schedule(share, s) for s in mix.schedules]
        return F.round(F.element_at(F.array(*shapes), F.col("turn") % len(shapes) + 1), 9)

    none = F.array().cast("array<double>")
    positions = F.when(readings > 0, F.transform(F.sequence(F.lit(0).cast("long"), readings - 1), position)).otherwise(none)
    return (
        rows.select(
            "row",
            "doc_id",
            "size",
            "source_size",
            "target",
            (size * rounds + part).cast("long").alias("taken"),
            positions.alias("positions"),
        )
        .withColumn("position", F.get("positions", F.lit(0)))
    )


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions, position), sorted by first position over the whole result."""
    return placed(docs, mix, id_col, text_col, source_col).drop("row").orderBy(F.col("position").asc_nulls_last(), "doc_id")
