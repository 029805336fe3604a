"""Splits, caps, demonstrations, epochs and batches.

Randomness is always a hash of (seed, keys): the same rows for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.ids import permutation_keys, permuted, running_total, seeded_key, seeded_unit, shuffled_ids, top_per_group
from corpusloom.operators.folds import greedy_groups
from corpusloom.session import materialize


def shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Global random order (a range exchange on the hash, not a single sort task)."""
    return df.orderBy(seeded_key(seed, key), key)


def take_pool(df: DataFrame, n: int, keys: list[str], order: str) -> DataFrame:
    return top_per_group(df, keys, [F.col(order)], n)


def balance_labels(df: DataFrame, n: int, n_labels: int, label: str, keys: list[str], order: list[Column]) -> DataFrame:
    """At most n // labels rows per label, then every label cut to the smallest one of its group.

    Sizes come from an aggregate of pre-capped counts; the ranking keeps at most n // labels rows per
    label and task.
    """
    per = n // n_labels
    counts = df.groupBy(*keys, label).agg(F.least(F.count(F.lit(1)), F.lit(per)).alias("_c"))
    smallest = counts.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) < n_labels, 0).otherwise(F.min("_c")).alias("_min")
    )
    ranked = top_per_group(df, [*keys, label], order, per, out="_r")
    joined = ranked.join(smallest, keys) if keys else ranked.crossJoin(F.broadcast(smallest))
    return joined.filter(F.col("_r") <= F.col("_min")).drop("_r", "_min")


def ids_by_label(df: DataFrame, keys: list[str], label: str, id_col: str, chunk: int = 10_000, skip: Column | None = None) -> DataFrame:
    """Label to ids as lists of at most ``chunk`` ids: (keys, label, part, ids).

    A label may hold a third of the rows, so its list is cut into numbered parts of bounded size.
    """
    rows = df.filter(~skip) if skip is not None else df
    placed = running_total(rows.select(*keys, label, id_col), "_at", [id_col], keys=[*keys, label])
    return (
        placed.withColumn("part", F.floor(F.col("_at") / chunk))
        .groupBy(*keys, label, "part")
        .agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    )


def length_bounds(df: DataFrame, keys: list[str], context: Column, target: Column, demos: Column) -> DataFrame:
    """Largest total, per-sample and context lengths per dataset and prompt."""
    return df.groupBy(*keys).agg(
        F.max(demos + context + target).alias("max_length"),
        F.max(context + target).alias("max_length_per_sample"),
        F.max(demos + context).alias("max_context_length"),
    )


def demos_random(
    samples: DataFrame, pool: DataFrame, shot: int, budget: int, seed: int, same_pool: bool, keys: list[str]
) -> DataFrame:
    """(keys, id, place, demo_id, n): per sample up to ``shot`` pool rows within ``budget`` tokens.

    A sample takes ``shot + 1`` consecutive places of the randomly ordered pool ring, from a place of
    its own; itself or else the last one is removed, then demonstrations are dropped from the end
    while the sample and all of them exceed the budget. Columns: id, n (tokens).
    """
    ring = shuffled_ids(pool.select(*keys, "id", "n"), seed, "id", "pos", keys=keys)
    sizes = ring.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    start = samples.select(*keys, "id", F.col("n").alias("own")).join(sizes, keys)
    # no more draws than the pool has rows, so a draw never repeats
    draws = start.withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.least(F.lit(shot), F.col("_size").cast("int") - 1)))
    )
    at = F.pmod(seeded_key(seed, "id") + F.col("draw"), F.col("_size"))
    got = draws.withColumn("pos", at).join(
        ring.select(*keys, "pos", F.col("id").alias("demo_id"), F.col("n").alias("demo_n")), [*keys, "pos"]
    )
    if same_pool:
        got = got.filter(F.col("demo_id") != F.col("id"))
    row = Window.partitionBy(*keys, "id").orderBy("draw")
    got = got.withColumn("place", F.row_number().over(row)).filter(F.col("place") <= shot)
    spent = F.sum("demo_n").over(row.rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn("_s", spent).filter(F.col("_s") + F.col("own") <= budget).select(*keys, "id", "place", "demo_id", F.col("demo_n").alias("n"))


def demos_shared(
    pool: DataFrame,
    shot: int,
    budget: int,
    seed: int,
    keys: list[str],
    label: str | None = None,
    tries: int = 10,
) -> DataFrame:
    """One demonstration set per group: (keys, id, n, try).

    Every try is its own seeded draw of ``shot`` rows (``ceil(shot / labels)`` per label when
    balanced). The first try within the token budget wins. After ``tries`` failures the shot number
    falls by one per further try, down to one; a group without any fitting set has no rows.

    Draws are positions: the j-th of a try is the image of j under the try's own permutation of the pool, so
    the pool is numbered and joined once, whatever the number of tries.
    """
    parts = [*keys, *([label] if label else [])]
    all_tries = tries + max(shot - 1, 0)
    placed = running_total(pool.select(*parts, "id", "n"), "at", ["id"], keys=parts)
    sizes = pool.groupBy(*parts).agg(F.count(F.lit(1)).alias("_size"))
    want = F.when(F.col("try") < tries, F.lit(shot)).otherwise(F.lit(shot + tries - 1) - F.col("try"))
    if label:
        labels = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
        sizes = _null_safe(sizes, labels, keys)
        want = F.ceil(want / F.col("_l"))
    draws = sizes.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(all_tries - 1))))
    draws = draws.withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(want, F.col("_size")).cast("int") - 1)))
    names = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    at = permuted(F.col("_j").cast("long"), F.col("_size"), permutation_keys(seed, *names, "try"))
    draws = draws.select(*parts, "try", at.alias("at"))
    drawn = _null_safe(draws, placed, [*parts, "at"]).select(*keys, "try", "id", "n")
    fits = drawn.groupBy(*keys, "try").agg(F.sum("n").alias("_s")).filter(F.col("_s") <= budget)
    first = fits.groupBy(*keys).agg(F.min("try").alias("try"))
    return _null_safe(drawn, first, [*keys, "try"]).select(*keys, "id", "n", "try")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    rest = [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), cond).select(*[F.col(f"l.`{c}`") for c in left.columns], *rest)


def epoch_index(df: DataFrame, epochs: int, most: int, seed: int, keys: list[str], id_col: str = "id") -> DataFrame:
    """(keys, epoch, place, id): min(most, n) rows per epoch; passes over the data do not repeat rows.

    Pass p is a random order of all rows; epoch e takes places e*m ... (e+1)*m - 1 of the passes put
    one after another.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_m", F.least(F.lit(most).cast("long"), F.col("_n")))
    passes = df.select(*keys, F.col(id_col).alias("id")).join(sizes, keys)
    passes = passes.withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(epochs) * F.col("_m") / F.col("_n")) - 1))
    )
    keyed = passes.withColumn("_hk", seeded_key(seed, "pass", "id"))
    placed = running_total(keyed, "_at", ["_hk", "id"], keys=[*keys, "pass"], spread="hash")
    placed = placed.withColumn("_g", F.col("_at") + F.col("pass") * F.col("_n"))
    return placed.select(
        *keys, F.floor(F.col("_g") / F.col("_m")).alias("epoch"), F.pmod("_g", "_m").alias("place"), "id"
    ).filter(F.col("epoch") < epochs)


def mixture(icl: DataFrame, lm: DataFrame, ratio: float | None, key: str) -> DataFrame:
    """All in-context rows and int(ratio * their number) plain rows (all of them when that is more)."""
    a = icl.select(F.col(key).alias("id"), F.lit("icl").alias("source"))
    b = lm.select(F.col(key).alias("id"), F.lit("lm").alias("source"))
    if ratio is not None:
        placed = running_total(b, "_at", ["id"])
        n = icl.agg(F.floor(F.lit(ratio) * F.count(F.lit(1))).alias("_want"))
        b = placed.crossJoin(F.broadcast(n)).filter(F.col("_at") < F.col("_want")).select("id", "source")
    return a.unionByName(b)


def drop_null_windows(windows: DataFrame, share: float, seed: int, id_col: str, is_null: Column, marked: Column) -> DataFrame:
    """Drop marked rows always and unanswerable windows with probability ``share``."""
    return windows.filter(~marked & (~is_null | (seeded_unit(seed, id_col) >= share)))


def select_confident(
    df: DataFrame, threshold: float, fraction: float, id_col: str, prob: str = "probability", shuffle_seed: int | None = None
) -> DataFrame:
    """Rows above the threshold, the best int(fraction * n) of them; ``prediction`` becomes ``label``."""
    sure = df.filter(F.col(prob) > threshold)
    placed = running_total(
        sure.withColumn("_o", -F.col(prob)), "_at", ["_o", id_col], spread="range"
    ).drop("_o")
    n = sure.agg(F.floor(F.lit(fraction) * F.count(F.lit(1))).alias("_want"))
    kept = placed.crossJoin(F.broadcast(n)).filter(F.col("_at") < F.col("_want")).drop("_at", "_want")
    kept = kept.withColumnRenamed("prediction", "label")
    return shuffle(kept, shuffle_seed, id_col) if shuffle_seed is not None else kept


def sample_answer_span(df: DataFrame, answers: str, min_words: int, seed: int, id_col: str) -> DataFrame:
    """One random answer, cut from a random start word so that at least ``min_words`` words remain."""
    pick = F.element_at(F.col(answers), (F.pmod(seeded_key(seed, F.lit("a"), id_col), F.size(answers).cast("long")) + 1).cast("int"))
    out = df.withColumn("_w", F.split(pick, r"\s+", -1))
    room = F.greatest(F.size("_w") - min_words + 1, F.lit(1)).cast("long")
    at = F.pmod(seeded_key(seed, F.lit("s"), id_col), room).cast("int")
    return out.withColumn("span", F.array_join(F.slice("_w", at + 1, F.size("_w")), " ")).drop("_w")


# batches -------------------------------------------------------------------------------------------


def batches_by_length(df: DataFrame, bins: list[int], size: int, length: Column, id_col: str) -> DataFrame:
    """(id, group, batch): full batches hold one length group; leftovers are batched in group order.

    Positions inside a group and the leftovers' common order both come from two-level prefix sums.
    """
    arr = F.array(*[F.lit(b) for b in sorted(bins)])
    grouped = df.select(F.col(id_col).alias("id"), F.size(F.filter(arr, lambda b: b <= length)).alias("group"))
    placed = running_total(grouped, "_at", ["id"], keys=["group"], total="_n")
    full = F.floor(F.col("_n") / size) * size
    whole = placed.filter(F.col("_at") < full).select(
        "id", "group", F.concat_ws("-", F.lit("g"), "group", F.floor(F.col("_at") / size).cast("string")).alias("batch")
    )
    # a leftover's place: leftovers of smaller groups, then its place among its own
    rest = placed.filter(F.col("_at") >= full).withColumn("_own", F.col("_at") - full)
    # at most size - 1 rows per group and as many groups as bins, so this window is small
    per_group = rest.groupBy("group").agg(F.count(F.lit(1)).alias("_c"))
    before = per_group.alias("a").join(per_group.alias("b"), F.col("b.group") < F.col("a.group"), "left").groupBy(
        F.col("a.group").alias("group")
    ).agg(F.coalesce(F.sum("b._c"), F.lit(0)).alias("_before"))
    rest = rest.join(F.broadcast(before), "group")
    last = rest.select(
        "id", "group", F.concat_ws("-", F.lit("rest"), F.floor((F.col("_before") + F.col("_own")) / size).cast("string")).alias("batch")
    )
    return whole.unionByName(last)


def sortish_batches(df: DataFrame, size: int, seed: int, length: str, id_col: str) -> DataFrame:
    """(id, batch, place): random chunks of 50 * size rows, longest first inside, in batches.

    The batch whose first row is the longest comes first; the others stand in random order.
    """
    mixed = shuffled_ids(df.select(F.col(id_col).alias("id"), F.col(length).alias("len")), seed, "id", "_pos")
    chunk = mixed.withColumn("_chunk", F.floor(F.col("_pos") / (size * 50)))
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy(F.desc("len"), "_pos")) - 1
    rows = chunk.withColumn("_in", inside).withColumn("_b", F.floor(F.col("_in") / size))
    rows = rows.withColumn("_place", F.pmod(F.col("_in"), F.lit(size)))
    heads = rows.filter(F.col("_place") == 0).select(
        (F.col("_chunk") * 50 + F.col("_b")).alias("_raw"), "len"
    )
    longest = heads.agg(F.max_by("_raw", F.struct("len", -F.col("_raw"))).alias("_first"))
    keyed = heads.crossJoin(F.broadcast(longest)).withColumn(
        "_hk", F.when(F.col("_raw") == F.col("_first"), F.lit(0).cast("long")).otherwise(seeded_key(seed, "_raw") + 1)
    )
    placed = running_total(keyed.select("_raw", "_hk"), "batch", ["_hk", "_raw"], spread="hash")
    rows = rows.withColumn("_raw", F.col("_chunk") * 50 + F.col("_b"))
    return rows.join(placed.select("_raw", "batch"), "_raw").select("id", "len", "batch", F.col("_place").alias("place"))


def token_budget_batches(
    df: DataFrame, budget: int, length: str, id_col: str, multiple: int = 64, unit_rows: int = 50_000
) -> DataFrame:
    """(id, len, batch): batches of similar lengths whose padded size stays within ``budget``, numbered from 0.

    Rows stand longest first, ids breaking ties. A batch's first row is its longest, so it sets the number of
    rows: as many as fit the budget, brought down to a multiple of ``multiple`` if it is above that. The
    batches are those of one pass; units are ranges of the order of about ``unit_rows`` rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(length).cast("long").alias("len"))
    units = rows.count() // unit_rows + 1
    ranged = rows.repartitionByRange(units, F.desc("len"), F.col("id"))
    ranged = materialize(ranged.withColumn("unit", F.spark_partition_id()))
    n = F.greatest(F.floor(F.lit(budget) / F.greatest("len", F.lit(1))), F.lit(1))
    n = F.when(n < multiple, n).otherwise(n - n % multiple)
    none = F.lit(0)
    made = greedy_groups(ranged, (F.lit(1), none), (n - 1, none), F.col("unit"), [-F.col("len"), F.col("id")], F.col("id"))
    return rows.join(made.select(F.col("place").alias("id"), F.col("grp").alias("batch")), "id")


def assign_workers(df: DataFrame, workers: int, key: str) -> DataFrame:
    """(key, worker, place): the head is repeated until the count divides, row i goes to i mod workers."""
    placed = running_total(df.select(key), "_at", [key], total="_n")
    extra = F.pmod(-F.col("_n"), F.lit(workers))
    again = placed.filter(F.col("_at") < extra).withColumn("_at", F.col("_at") + F.col("_n"))
    rows = placed.unionByName(again)
    return rows.select(
        key, F.pmod("_at", F.lit(workers)).cast("int").alias("worker"), F.floor(F.col("_at") / workers).alias("place")
    )
