"""Row positions and running totals without a single-task window.

``row_number() over (order by ...)`` pulls all rows of a group into one task, which fails when one
group holds a large share of the table. Every function here works in two levels instead:

1. rows are cut into consecutive *slabs* along the order key, so (group, slab) is bounded;
2. an aggregate gives each slab's total; slabs stand in a tree whose nodes have at most ``FAN``
   children, windows over the children of a node give their offsets, from the root down, and a window
   inside each slab gives the local position.

The depth of the tree follows from the span of the slabs, so sparse keys, which may leave one row in a
slab, still never bring more than ``FAN`` totals of a group into one window.

How slabs are cut is the ``spread`` argument:

* ``dense``  - the key is an integer id or position; a slab is ``slab`` consecutive values;
* ``hash``   - the key is a 60-bit value of :func:`seeded_key`; a slab is its leading 16 bits;
* ``range``  - any numeric key; slab bounds are quantiles found by one aggregate, and a value so
  frequent that it fills whole slabs is cut again along the tie-breaking id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 60
SLAB_BITS = 16
FAN = 4096


def seeded_key(seed: int, *cols: str | Column) -> Column:
    """A reproducible 60-bit random key per row: the same for any partitioning of the input."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_key(seed: int, *cols: str | Column) -> Column:
    """Like :func:`seeded_key` with Spark's own 64-bit hash: cheaper, for many draws per row."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 64 - HASH_BITS)


def seeded_unit(seed: int, *cols: str | Column) -> Column:
    """A reproducible uniform draw in [0, 1) with six decimals."""
    return F.pmod(seeded_key(seed, *cols), F.lit(1_000_000)) / F.lit(1_000_000.0)


# Fixed values of the permutation: rounds, and the multiplier, shift and width of its round function.
ROUNDS, MULTIPLIER, SHIFT, WIDTH = 4, 2654435761, 13, 1 << 30
WALKS = 24


def permutation_keys(seed: int, *cols: str | Column) -> Column:
    """The key of a permutation per row, for :func:`permuted`."""
    return F.array(*[F.pmod(seeded_key(seed, F.lit(i), *cols), F.lit(WIDTH)) for i in range(ROUNDS)])


def permuted(at: Column, n: Column, keys: Column) -> Column:
    """Where position ``at`` of 0..n-1 goes under the permutation of 0..n-1 that ``keys`` names.

    The j-th of so many draws without replacement is the image of j: it is computed, nothing is ranked.
    Positions are pairs (at mod a, at div a) with a * b >= n and both near the root of n; each round adds a hash
    of one half to the other, which is a permutation of the pairs. Images of n or more are sent on until
    they fall below; there are fewer than ``a`` such pairs, so a few steps do.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    b = F.ceil(n / a).cast("long")

    def mixed(half: Column, key: Column, size: Column) -> Column:
        return F.pmod(F.shiftright(F.pmod(half + key, F.lit(WIDTH)) * MULTIPLIER, SHIFT), size)

    def once(x: Column) -> Column:
        numbered = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        pair = F.struct(F.pmod(x, a).alias("l"), F.floor(x / a).cast("long").alias("r"))

        def step(p: Column, k: Column) -> Column:
            left = F.struct(F.pmod(p["l"] + mixed(p["r"], k["k"], a), a).alias("l"), p["r"].alias("r"))
            right = F.struct(p["l"].alias("l"), F.pmod(p["r"] + mixed(p["l"], k["k"], b), b).alias("r"))
            return F.when(k["i"] % 2 == 0, left).otherwise(right)

        return F.aggregate(numbered, pair, step, lambda p: p["r"] * a + p["l"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(at), lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def _quantile_bounds(df: DataFrame, key: Column, slabs: int) -> list[float]:
    probabilities = [i / slabs for i in range(1, slabs)]
    row = df.agg(F.percentile_approx(key.cast("double"), probabilities, 10_000).alias("q")).first()
    return list(row["q"] or [])


def _slab_columns(df: DataFrame, order: list[str], spread: str, slab: int) -> list[Column]:
    key = F.col(order[0])
    if spread == "dense":
        return [F.floor(key / F.lit(slab)).cast("long")]
    if spread == "hash":
        return [F.shiftright(key, HASH_BITS - SLAB_BITS).cast("long")]
    if spread != "range":
        raise ValueError(f"unknown spread {spread!r}")
    slabs = max(2, min(1024, df.sparkSession.sparkContext.defaultParallelism * 4))
    bounds = _quantile_bounds(df, key, slabs)
    heavy = sorted({b for i, b in enumerate(bounds) if bounds.count(b) > 1})
    cuts = sorted(set(bounds))
    value = key.cast("double")
    # two positions per cut: values below it and values equal to it are kept apart
    arr = F.array(*[F.lit(float(b)) for b in cuts]) if cuts else F.array().cast("array<double>")
    first = F.size(F.filter(arr, lambda b: b < value)) + F.size(F.filter(arr, lambda b: b <= value))
    if not heavy or len(order) < 2:
        return [first.cast("long")]
    ties = _quantile_bounds(df, F.col(order[1]), slabs)
    tie_arr = F.array(*[F.lit(float(b)) for b in sorted(set(ties))])
    tie_value = F.col(order[1]).cast("double")
    second = F.when(value.isin(heavy), F.size(F.filter(tie_arr, lambda b: b <= tie_value))).otherwise(F.lit(0))
    return [first.cast("long"), second.cast("long")]


def running_total(
    df: DataFrame,
    out: str,
    order: list[str],
    keys: list[str] | None = None,
    weight: Column | None = None,
    spread: str = "dense",
    slab: int = 65536,
    total: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over the rows before this one in its group (0 for the first).

    ``order`` must be unique inside a group. ``total`` names an extra column with the group's sum.
    With the default weight of one, ``out`` is the 0-based row position. Weights may be whole or real.
    """
    keys = list(keys or [])
    weight = F.lit(1).cast("long") if weight is None else weight
    cols = _slab_columns(df, order, spread, slab)
    names = [f"_slab{i}" for i in range(len(cols))]
    # a struct of the keys compares null as equal and keeps the window's partitioning usable for the join
    group = F.struct(*keys) if keys else F.lit(0)
    staged = df.select("*", group.alias("_grp"), *[c.alias(n) for c, n in zip(cols, names)], weight.alias("_w"))
    levels = 0 if spread == "range" else _levels(df, cols[0], spread)
    totals = staged.groupBy("_grp", *names).agg(F.sum("_w").alias("_slab_sum"))
    offsets = _offsets(totals, names, levels, descending)
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    inside = Window.partitionBy("_grp", *names).orderBy(*[direction(o) for o in order])
    local = staged.withColumn(
        "_loc", F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    )
    found = local.join(offsets, ["_grp", *names])
    extra = [F.col("_all").alias(total)] if total else []
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_loc") + F.col("_off")).alias(out), *extra)


def _levels(df: DataFrame, slab: Column, spread: str) -> int:
    """How many levels of inner nodes bring the slabs down to ``FAN`` under the root."""
    if spread == "hash":
        span = 1 << SLAB_BITS
    else:
        low, high = df.agg(F.min(slab), F.max(slab)).first()
        span = 1 if low is None else high - low + 1
    levels = 0
    while span > FAN:
        span, levels = -(-span // FAN) + 1, levels + 1
    return levels


def _offsets(totals: DataFrame, names: list[str], levels: int, descending: bool) -> DataFrame:
    """(_grp, slabs, _off, _all) of every slab: what lies before it in its group, and the group's sum."""
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    nodes = [totals]
    for _ in range(levels):
        parents = nodes[-1].withColumn(names[0], F.floor(F.col(names[0]) / FAN))
        nodes.append(parents.groupBy("_grp", names[0]).agg(F.sum("_slab_sum").alias("_slab_sum")))
    top = Window.partitionBy("_grp")
    before = F.sum("_slab_sum").over(up_to(top.orderBy(*[direction(n) for n in names]))) - F.col("_slab_sum")
    found = nodes[-1].select("_grp", *names, before.alias("_off"), F.sum("_slab_sum").over(top).alias("_all"))
    for level in reversed(nodes[:-1]):
        above = found.select("_grp", F.col(names[0]).alias("_up"), F.col("_off").alias("_base"), "_all")
        children = level.withColumn("_up", F.floor(F.col(names[0]) / FAN))
        siblings = up_to(Window.partitionBy("_grp", "_up").orderBy(direction(names[0])))
        children = children.withColumn("_before", F.sum("_slab_sum").over(siblings) - F.col("_slab_sum"))
        found = children.join(above, ["_grp", "_up"]).select("_grp", *names, (F.col("_base") + F.col("_before")).alias("_off"), "_all")
    return found


def dense_ids(df: DataFrame, key: str, out: str = "nid", spread: str = "dense", slab: int = 65536) -> DataFrame:
    """Ids 0..n-1 in the order of ``key``; (key, out) is the map in both directions."""
    return running_total(df, out, [key], spread=spread, slab=slab)


def shuffled_ids(
    df: DataFrame, seed: int, key: str, out: str = "nid", keys: list[str] | None = None, total: str | None = None
) -> DataFrame:
    """Positions of a reproducible random order inside each group (and the group's size)."""
    keyed = df.withColumn("_hk", seeded_key(seed, key))
    return running_total(keyed, out, ["_hk", key], keys=keys, spread="hash", total=total).drop("_hk")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows of each group.

    Spark puts a group limit before the shuffle for this form, so a task ships at most ``n`` rows
    of a group and a hot group never lands whole in one task (for ``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``).
    """
    name = out or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if out else kept.drop(name)
