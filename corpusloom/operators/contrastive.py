"""Contrastive retriever examples: query, positive, easy and hard negatives.

"Draw until valid" loops become numbered draws: every row gets a fixed list of reproducible
candidate positions, one equi join fetches them, and the first valid ones are kept. Draws are
addressed by position inside their group, so no group is collected and no group is paired with
itself row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import prompt_columns as P
from corpusloom.functions import text as T
from corpusloom.functions.arrays import fan_out
from corpusloom.ids import draw_key, running_total, shuffled_ids
from corpusloom.operators import prompts as R
from corpusloom.session import materialize

GROUP = ["dataset", "prompt"]


@dataclass
class Dataset:
    """A labelled record table with its templates and its rules to and from the standard record."""

    name: str
    records: DataFrame
    key: str
    templates: list[dict]
    to_rules: list[tuple[str, str]] | None = None
    from_rules: list[tuple[str, str | list[str]]] | None = None
    counts: dict[str, int] = field(default_factory=dict)
    needs: dict[str, int] = field(default_factory=dict)
    casts: dict[str, str] = field(default_factory=dict)


def rendered_pool(datasets: list[Dataset], words: int = 256, seed: int = 0) -> DataFrame:
    """(dataset, prompt, id, text, hash, fits) of every record with every template of its dataset."""
    frames = []
    for d in datasets:
        out = R.render_all(d.records, d.templates, d.key, seed=seed)
        both = (F.length("context") > 0) & (F.length("target") > 0)
        text = F.concat_ws(" ", "context", "target")
        frames.append(
            out.filter(both).select(
                F.lit(d.name).alias("dataset"),
                "prompt",
                F.col(d.key).cast("long").alias("id"),
                text.alias("text"),
                F.sha2(text, 256).alias("hash"),
                T.within_words(text, words).alias("fits"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def positive_ids(pool: DataFrame, seed: int) -> DataFrame:
    """(dataset, prompt, id, pos_id): for every record another one of the same dataset and prompt, never itself.

    Records stand in a reproducible random ring per group and each takes its successor, so the join
    key (group, position) is unique and balanced. A group of one record yields nothing. No text moves.
    """
    ring = shuffled_ids(pool.filter("fits").select(*GROUP, "id"), seed, "id", "pos", keys=GROUP, total="n")
    ring = materialize(ring.filter("n > 1"))
    follower = ring.select(*GROUP, F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), F.col("id").alias("pos_id"))
    return ring.drop("n").join(follower, [*GROUP, "pos"]).drop("pos")


def with_texts(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """``pairs`` with the texts of their two records, ``query`` and ``pos_context``."""
    queries = pool.select(*GROUP, "id", F.col("text").alias("query"))
    positives = pool.select(*GROUP, F.col("id").alias("pos_id"), F.col("text").alias("pos_context"))
    return pairs.join(queries, [*GROUP, "id"]).join(positives, [*GROUP, "pos_id"])


def pair_positive(pool: DataFrame, seed: int) -> DataFrame:
    """(dataset, prompt, id, query, pos_id, pos_context) of :func:`positive_ids`."""
    return with_texts(positive_ids(pool, seed), pool).select(*GROUP, "id", "query", "pos_id", "pos_context")


def _digest() -> Column:
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def _positions(pool: DataFrame, seed: int) -> DataFrame:
    """The records of distinct fitting texts with their position in (dataset, prompt); no texts."""
    digests = pool.filter("fits").select(*GROUP, "id", _digest().alias("hash"))
    first = digests.groupBy("dataset", "hash").agg(F.min(F.struct("prompt", "id")).alias("_k"))
    unique = first.select("dataset", F.col("_k.prompt").alias("prompt"), F.col("_k.id").alias("id"))
    return shuffled_ids(unique, seed, "id", "pos", keys=GROUP)


def _group_number(groups: list[tuple[str, str]]) -> Column:
    """The number of a row's (dataset, prompt) among ``groups``: one long moves instead of two names."""
    listed = F.array(*[F.struct(F.lit(d).alias("dataset"), F.lit(p).alias("prompt")) for d, p in groups])
    return F.array_position(listed, F.struct("dataset", "prompt")) - 1


SPOT = 40


def easy_negatives(queries: DataFrame, pool: DataFrame, n: int, seed: int, spare: int = 2) -> DataFrame:
    """(dataset, prompt, id, negatives, short): ``n`` distinct (text, label) of other datasets per query row.

    A draw picks another dataset, one of its prompts and a record position, each uniformly. Two draws
    of a row in the same group differ in position by their draw numbers, and the pool holds each text
    once per dataset, so ``n + spare`` draws leave ``n`` distinct ones unless the other datasets are
    smaller than that; ``short`` says that a row has fewer. A row's draws are computed and chosen inside the
    row: equal texts are one position of a dataset, and only draws of texts that several datasets have
    are looked up before. Chosen draws move once to meet the texts, as numbers, and once back.
    """
    placed = materialize(_positions(pool, seed))
    sizes = placed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_rows")).collect()
    catalog = sorted((r["dataset"], r["prompt"], r["n_rows"]) for r in sizes)
    groups = [(d, p) for d, p, _ in catalog]
    order = sorted({d for d, _ in groups})
    if len(order) < 2:
        raise ValueError("easy negatives need at least two datasets")
    names, prompts, rows_of = (F.array(*[F.lit(c[i]) for c in catalog]) for i in range(3))
    listed = F.array(*[F.lit(d) for d in order])
    counts = F.array(*[F.lit(sum(d == x for x, _ in groups)) for d in order])
    starts = F.array(*[F.lit([x for x, _ in groups].index(d)) for d in order])
    asking = sorted((tuple(r) for r in queries.select(*GROUP).distinct().collect()), key=str)
    asked = queries.select(*GROUP, "id", _group_number(asking).alias("_q"))
    tries = range(n + spare)
    key = lambda what, *more: draw_key(seed, F.lit(what), *GROUP, "id", *more)
    # one step a select, all draws side by side: each value is computed once
    rows = asked.distinct().withColumn("_own", F.array_position(listed, F.col("dataset")) - 1)
    rows = rows.select("*", *[key("d", F.lit(t)).alias(f"_k{t}") for t in tries])
    shift = lambda t: F.pmod(f"_k{t}", F.lit(len(order) - 1))
    other = lambda t: F.when(F.col("_own") < 0, F.pmod(f"_k{t}", F.lit(len(order)))).otherwise(shift(t) + (shift(t) >= F.col("_own")).cast("int"))
    rows = rows.select(*GROUP, "id", "_q", *[(other(t) + 1).cast("int").alias(f"_d{t}") for t in tries])
    at = lambda t: F.element_at(starts, F.col(f"_d{t}")) + F.pmod(key("p", F.lit(t)), F.element_at(counts, F.col(f"_d{t}"))).cast("int")
    rows = rows.select(*GROUP, "id", "_q", *[(at(t) + 1).alias(f"_g{t}") for t in tries])
    base = lambda g: key("r", F.element_at(names, g), F.element_at(prompts, g))
    spot = lambda t, g: F.shiftleft((g - 1).cast("long"), SPOT) + F.pmod(base(g) + t, F.element_at(rows_of, g))
    rows = rows.select("_q", "id", F.array_distinct(F.array(*[spot(t, F.col(f"_g{t}")) for t in tries])).alias("_l"))
    located = placed.select((F.shiftleft(_group_number(groups).cast("long"), SPOT) + F.col("pos")).alias("spot"), *GROUP, "id")
    rows = _without_twins(rows, located, pool)
    chosen = fan_out(rows, ["_q", "id"], F.slice("_l", 1, n), "spot", "at")
    chosen = chosen.select("id", (F.col("_q") * (n + spare) + F.col("at")).alias("_qa"), "spot")
    texts = located.join(pool.select(*GROUP, "id", "text"), [*GROUP, "id"]).select("spot", "text")
    met = chosen.join(texts, "spot").select("id", "_qa", F.shiftright("spot", SPOT).cast("int").alias("g"), "text")
    met = met.select("id", F.floor(F.col("_qa") / (n + spare)).alias("_q"), F.struct((F.col("_qa") % (n + spare)).cast("int").alias("at"), "text", "g").alias("_x"))
    label = lambda g: F.concat_ws("-", F.element_at(names, g + 1), F.element_at(prompts, g + 1))
    named = F.transform(F.array_sort(F.collect_list("_x")), lambda x: F.struct(x["text"].alias("text"), label(x["g"]).alias("label")))
    lists = met.groupBy("id", "_q").agg(named.alias("negatives"))
    # a row all of whose draws missed is short, too
    none = F.array().cast("array<struct<text:string,label:string>>")
    out = asked.join(lists, ["id", "_q"], "left").select(*GROUP, "id", F.coalesce("negatives", none).alias("negatives"))
    return out.withColumn("short", F.size("negatives") < n)


def _without_twins(rows: DataFrame, located: DataFrame, pool: DataFrame) -> DataFrame:
    """``rows`` (_q, id, _l) without draws whose text an earlier draw of the row has from another dataset.

    A position is a text of its dataset, so only texts that several datasets have need a look.
    """
    fitting = pool.filter("fits").select(*GROUP, "id", F.xxhash64("text").alias("_h"), "text")
    several = fitting.groupBy("_h").agg(F.min("dataset").alias("_a"), F.max("dataset").alias("_b")).filter("_a <> _b")
    several = materialize(several.select("_h"))
    if several.isEmpty():
        return rows
    twins = fitting.join(several, "_h", "left_semi").select(*GROUP, "id", _digest().alias("hash"))
    twins = located.join(twins, [*GROUP, "id"]).select("spot", "hash").distinct()
    hits = fan_out(rows, ["_q", "id"], "_l", "spot", "at").join(twins, "spot")
    hits = hits.groupBy("_q", "id").agg(F.array_sort(F.collect_list(F.struct("at", "hash", "spot"))).alias("_t"))
    later = F.filter("_t", lambda x, i: F.exists(F.slice("_t", F.lit(1), i), lambda y: y["hash"] == x["hash"]))
    hits = hits.select("_q", "id", F.transform(later, lambda x: x["spot"]).alias("_gone"))
    found = rows.alias("r").join(hits.alias("h"), F.col("r._q").eqNullSafe(F.col("h._q")) & F.col("r.id").eqNullSafe(F.col("h.id")), "left")
    kept = F.array_except("r._l", F.coalesce("h._gone", F.array().cast("array<bigint>")))
    return found.select("r._q", "r.id", kept.alias("_l"))


def _first_distinct(found: DataFrame, n: int, source: list[str]) -> DataFrame:
    """(dataset, prompt, id, try, source columns): the first ``n`` draws of a row with distinct digests.

    A row has only its own few draws.
    """
    lists = found.groupBy(*GROUP, "id").agg(F.array_sort(F.collect_list(F.struct("try", "hash", *source))).alias("_l"))
    fresh = F.filter(
        "_l", lambda x, i: ~F.exists(F.slice("_l", F.lit(1), i), lambda y: y["hash"] == x["hash"])
    )
    return lists.select(*GROUP, "id", F.explode(F.slice(fresh, 1, n)).alias("_x")).select(*GROUP, "id", "_x.try", *[f"_x.{c}" for c in source])


def _texts_of(chosen: DataFrame, texts: DataFrame, source: list[str], label: Column) -> DataFrame:
    """(dataset, prompt, id, negatives) from chosen draws and the texts of what they name."""
    both = chosen.join(texts, source).select(*GROUP, "id", F.struct("try", "text", label.alias("label")).alias("_x"))
    lists = both.groupBy(*GROUP, "id").agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    return lists.select(*GROUP, "id", F.transform("_l", lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"))).alias("negatives"))


def convertible_sources(target: Dataset, datasets: list[Dataset]) -> list[Dataset]:
    if target.from_rules is None:
        return []
    return [
        d
        for d in datasets
        if d.name != target.name
        and d.to_rules is not None
        and all(d.counts.get(k, 0) >= v for k, v in target.needs.items())
    ]


def converted_records(
    target: Dataset, source: Dataset, drawn: DataFrame, words: int, seed: int
) -> DataFrame | None:
    """(prompt, source_id, text, hash, fits) of the ``drawn`` (prompt, source_id) records of ``source``, re-shaped and rendered as the target's.

    Only drawn records are converted and rendered, and only their own prompts' texts go on. Empty renderings
    do not fit.
    """
    records = source.records.join(drawn.select(F.col("source_id").alias(source.key)).distinct(), source.key, "left_semi")
    std = records.select(F.col(source.key).cast("long").alias("id"), R.to_standard(records, source.to_rules).alias("std"))
    key = F.concat_ws(":", F.lit(source.name), F.col("id"))
    fields = R.from_standard("std", target.from_rules, key, seed, target.casts)
    shaped = std.select("id", fields.alias("_f")).select("id", "_f.*")
    usable = [t for t in target.templates if P.variables(t["jinja"]) <= set(shaped.columns)]
    if not usable:
        return None
    text = F.concat_ws(" ", "context", "target")
    fits = (F.length("context") > 0) & (F.length("target") > 0) & T.within_words(text, words)
    out = R.render_all(shaped, usable, "id", seed=seed).select("prompt", F.col("id").alias("source_id"), text.alias("text"), F.sha2(text, 256).alias("hash"), fits.alias("fits"))
    return out.join(drawn.select("prompt", "source_id").distinct(), ["prompt", "source_id"], "left_semi")


def usable_prompts(target: Dataset, source: Dataset) -> list[str]:
    """Prompts of the target whose variables the converted records of ``source`` have."""
    fields = {name.partition(".")[0] for name, _ in target.from_rules or []} | {"id"}
    return [t["name"] for t in target.templates if P.variables(t["jinja"]) <= fields]


def hard_negatives(queries: DataFrame, datasets: list[Dataset], n: int, seed: int, words: int = 256) -> DataFrame:
    """(dataset, prompt, id, negatives): ``n`` (text, label) of convertible datasets in the query's prompt.

    2n + 1 numbered draws per row: source uniform, record uniform among all records of the source. Empty,
    over-long and repeated texts use up a draw. Rows left with fewer than ``n`` are not in the result; the
    caller gives them easy negatives instead, all of them.

    Draws are positions of record ids; records are converted and rendered only once they are drawn.
    """
    tries = 2 * n + 1
    parts = []
    for target in datasets:
        sources = convertible_sources(target, datasets)
        offered = [(p, i) for i, d in enumerate(sources) for p in usable_prompts(target, d)]
        if not offered:
            continue
        by_prompt: dict[str, list[int]] = {}
        for p, i in offered:
            by_prompt.setdefault(p, []).append(i)
        choice = F.create_map(*[x for p, at in by_prompt.items() for x in (F.lit(p), F.array(*[F.lit(i) for i in at]))])
        rows = queries.filter((F.col("dataset") == target.name) & F.col("prompt").isin(list(by_prompt))).select(*GROUP, "id")
        draws = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"), choice[F.col("prompt")].alias("_at"))
        pick = F.pmod(draw_key(seed, F.lit("s"), *GROUP, "id", "try"), F.size("_at").cast("long")).cast("int")
        draws = draws.withColumn("source", F.get("_at", pick)).drop("_at")
        found = []
        for i, source in enumerate(sources):
            own = draws.filter(F.col("source") == i).drop("source")
            ids = shuffled_ids(source.records.select(F.col(source.key).cast("long").alias("source_id")).distinct(), seed, "source_id", "pos")
            ids = materialize(ids)
            size = ids.count()
            if not size:
                continue
            base = draw_key(seed, F.lit("h"), *GROUP, "id", F.lit(source.name))
            own = materialize(own.withColumn("pos", F.pmod(base + F.col("try"), F.lit(size))).join(ids, "pos").drop("pos"))
            made = converted_records(target, source, own, words, seed)
            if made is not None:
                made = materialize(made.filter("fits").drop("fits"))
                found.append(own.join(made, ["prompt", "source_id"]).withColumn("source", F.lit(source.name)))
        if found:
            drawn = reduce(DataFrame.unionByName, found)
            key = ["source", "prompt_", "source_id"]
            texts = drawn.select("source", F.col("prompt").alias("prompt_"), "source_id", "text").distinct()
            chosen = _first_distinct(drawn.withColumn("prompt_", F.col("prompt")), n, key)
            parts.append(_texts_of(chosen, texts, key, F.concat_ws("-", "source", "prompt_")))
    if not parts:
        none = F.array().cast("array<struct<text:string,label:string>>")
        return queries.select(*GROUP, "id", none.alias("negatives")).limit(0)
    return reduce(DataFrame.unionByName, parts).filter(F.size("negatives") == n)


def _lists(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(
        *GROUP,
        "id",
        F.transform("negatives", lambda s: T.collapse_newlines(s["text"])).alias(f"{prefix}_neg_contexts"),
        F.transform("negatives", lambda s: s["label"]).alias(f"{prefix}_neg_labels"),
    )


def contrastive_examples(
    datasets: list[Dataset], n_easy: int, n_hard: int, train: int, valid: int, seed: int = 42, words: int = 256
) -> DataFrame:
    """One row per query with its positive and negatives, labelled train or valid per prompt."""
    pool = materialize(rendered_pool(datasets, words, seed))
    pairs = materialize(cap_per_prompt(materialize(positive_ids(pool, seed)), train, valid, seed))
    easy = _lists(easy_negatives(pairs, pool, n_easy, seed), "easy")
    hard_rows = materialize(hard_negatives(pairs, datasets, n_hard, seed, words))
    hard = _lists(hard_rows, "hard")
    # rows without enough hard negatives get a second, independent draw of easy ones
    short = pairs.join(hard_rows, [*GROUP, "id"], "left_anti")
    backup = _lists(easy_negatives(short, pool, n_hard, seed + 1), "backup")
    key = [*GROUP, "id"]
    out = with_texts(pairs, pool).join(easy, key, "left").join(hard, key, "left").join(backup, key, "left")

    def either(name: str) -> Column:
        return F.coalesce(F.col(f"hard_neg_{name}"), F.col(f"backup_neg_{name}")).alias(f"hard_neg_{name}")

    return out.select(
        *key,
        "split",
        "query",
        T.collapse_newlines("pos_context").alias("pos_context"),
        "easy_neg_contexts",
        "easy_neg_labels",
        either("contexts"),
        either("labels"),
        F.col("hard_neg_contexts").isNull().alias("hard_fell_back"),
        F.concat_ws("-", "dataset", "prompt").alias("label"),
    )


def cap_per_prompt(df: DataFrame, train: int, valid: int, seed: int | None, key: str = "id") -> DataFrame:
    """First ``train`` rows of each (dataset, prompt) are train, the next ``valid`` are valid; ``key`` is unique there.

    Positions are running totals, so a prompt with any number of rows is cut in many tasks.
    """
    ids = df.select(*GROUP, key)
    if seed is None:
        placed = running_total(ids, "_r", [key], keys=GROUP)
    else:
        placed = shuffled_ids(ids, seed, key, "_r", keys=GROUP)
    kept = placed.filter(F.col("_r") < train + valid)
    kept = kept.withColumn("split", F.when(F.col("_r") < train, "train").otherwise("valid")).drop("_r")
    return df.join(kept, [*GROUP, key])
