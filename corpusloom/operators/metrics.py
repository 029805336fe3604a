"""Losses, answer metrics, grouped averages and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scores as X
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.ids import running_total
from corpusloom.operators.skew import skew_join
from corpusloom.session import materialize

MIN_LOSS = 0.0001


# losses --------------------------------------------------------------------------------------------


def mean_masked_loss(df: DataFrame, loss: str = "loss", mask: str = "mask", keys: list[str] | None = None) -> DataFrame:
    """Mean over rows of each row's masked mean."""
    per_row = df.select(*(keys or []), V.masked_mean(loss, mask).alias("_m"))
    return per_row.groupBy(*(keys or [])).agg(F.avg("_m").alias("loss"), F.count("_m").alias("n"))


def loss_gain(base: Column, ours: Column) -> Column:
    """Masked mean of ``ours`` minus that of ``base``; tokens with almost no base loss do not count."""
    mask = F.transform(base, lambda x: (x > MIN_LOSS).cast("double"))
    return V.masked_mean(ours, mask) - V.masked_mean(base, mask)


def loss_gain_filter(base: DataFrame, ours: DataFrame, threshold: float, key: str = "query_id", loss: str = "loss") -> DataFrame:
    """Keys whose in-context loss is lower than the base loss by more than ``threshold``."""
    both = base.select(key, F.col(loss).alias("_b")).join(ours.select(key, F.col(loss).alias("_o")), key)
    return both.select(key, loss_gain(F.col("_b"), F.col("_o")).alias("gain")).filter(F.col("gain") < -threshold)


# answers -------------------------------------------------------------------------------------------


def restrict_tasks(refs: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    return refs.join(tasks.select(key).distinct(), key, "left_semi")


def join_predictions(refs: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """References with their prediction; a missing one is the empty string and is flagged."""
    joined = refs.join(preds.select(key, "prediction"), key, "left")
    return joined.withColumn("missing", F.col("prediction").isNull().cast("int")).withColumn(
        "prediction", F.coalesce("prediction", F.lit(""))
    )


def exact_match(pred: str | Column, refs: str | Column, articles: bool = False) -> Column:
    refs = F.col(refs) if isinstance(refs, str) else refs
    return V.let(
        T.normalize_answer(pred, articles), lambda want: F.exists(refs, lambda r: T.normalize_answer(r, articles) == want)
    ).cast("int")


def answer_f1(pred: str | Column, refs: str | Column, articles: bool = True) -> Column:
    """Token-multiset F1 after normalisation, best reference; no common token scores zero."""
    refs = F.col(refs) if isinstance(refs, str) else refs

    def words(c: str | Column) -> Column:
        return F.filter(F.split(T.normalize_answer(c, articles), " ", -1), lambda w: w != "")

    return X.multiset_f1(words(pred), F.transform(refs, words))


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Size of the multiset intersection per key, from pre-aggregated counts."""
    a = left.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, [*keys, item]).groupBy(*keys).agg(F.sum(F.least("_a", "_b")).alias("n"))


def precision_at_k(pred: str | Column, ref: str | Column, k: int) -> Column:
    pred = F.col(pred) if isinstance(pred, str) else pred
    return F.size(F.array_intersect(F.slice(pred, 1, k), ref)) / F.lit(k)


def grouped_metrics(df: DataFrame, category: str, task: str, metrics: dict[str, Column]) -> DataFrame:
    """Each metric (x100, four decimals) overall, per category and per task, in one aggregation."""
    name = F.array_join(F.filter(F.split(F.lower(category), r"\s+", -1), lambda w: w != ""), "_")
    rows = df.select(name.alias("category"), F.col(task).alias("task"), *[c.alias(n) for n, c in metrics.items()])
    sums = [F.round(100 * F.avg(n), 4).alias(n) for n in metrics]
    out = rows.groupingSets([[], ["category"], ["task"]], "category", "task").agg(
        F.grouping_id().alias("_g"), *sums, F.count(F.lit(1)).alias("n")
    )
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "category").otherwise("task")
    return out.select(level.alias("level"), F.coalesce("category", "task", F.lit("")).alias("name"), *metrics, "n")


def prompt_averages(results: DataFrame) -> DataFrame:
    """Mean over metrics, then over prompts, then over datasets; every mean is unweighted."""
    per_prompt = results.groupBy("dataset", "prompt").agg(F.avg("value").alias("value"))
    per_data = per_prompt.groupBy("dataset").agg(F.avg("value").alias("value"))
    overall = per_data.agg(F.avg("value").alias("value"))
    return (
        per_prompt.select(F.lit("prompt").alias("level"), "dataset", "prompt", "value")
        .unionByName(per_data.select(F.lit("dataset").alias("level"), "dataset", F.lit("").alias("prompt"), "value"))
        .unionByName(overall.select(F.lit("all").alias("level"), F.lit("").alias("dataset"), F.lit("").alias("prompt"), "value"))
    )


def bleu(df: DataFrame, pred_tokens: str, ref_tokens: str, keys: list[str] | None = None, order: int = 4) -> DataFrame:
    """Corpus BLEU: clipped counts per row, summed, then the closed formula (four decimals)."""
    counts = df.select(*(keys or []), X.ngram_overlap(F.col(pred_tokens), F.col(ref_tokens), order).alias("c"))
    names = [f"{k}{n}" for n in range(1, order + 1) for k in ("match", "total")] + ["pred_len", "ref_len"]
    sums = counts.groupBy(*(keys or [])).agg(*[F.sum(f"c.{n}").alias(n) for n in names])
    log_sum, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, order + 1):
        match, total = F.col(f"match{n}"), F.col(f"total{n}")
        zeros = zeros + F.when(match == 0, 1).otherwise(0)
        # an order without matches counts as half, a quarter, ... of one match
        p = F.when(match == 0, F.lit(1.0) / (F.pow(F.lit(2.0), zeros) * total)).otherwise(match / total)
        log_sum = log_sum + F.log(p) / order
    brevity = F.when(F.col("pred_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("pred_len"))).otherwise(F.lit(1.0))
    empty = (F.col(f"total{order}") == 0) | (F.col("match1") == 0)
    value = F.when(empty, F.lit(0.0)).otherwise(100 * brevity * F.exp(log_sum))
    return sums.select(*(keys or []), F.round(value, 4).alias("bleu"))


def rouge_corpus(
    df: DataFrame, pred: str, target: str, id_col: str, bootstrap: int = 0, seed: int = 0
) -> DataFrame:
    """Mean F-measure (x100) per variant, or the median over bootstrap resamples.

    Resampling gives every row a Poisson(1) weight per resample from a generator keyed by (seed, id);
    a task returns one weighted sum per resample, so nothing larger than the resample count moves.
    """
    scored = df.select(id_col, X.rouge_scores(F.col(pred), F.col(target)).alias("s")).select(id_col, "s.*")
    if not bootstrap:
        return scored.agg(*[F.round(100 * F.avg(k), 4).alias(k) for k in X.ROUGE_KEYS])

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, sums = np.zeros(bootstrap), np.zeros((bootstrap, len(X.ROUGE_KEYS)))
        for pdf in batches:
            values = pdf[X.ROUGE_KEYS].to_numpy()
            for ident, row in zip(pdf[id_col], values):
                w = np.random.default_rng([seed, int(ident) & 0xFFFFFFFF, int(ident) >> 32 & 0xFFFFFFFF]).poisson(1.0, bootstrap)
                weight += w
                sums += w[:, None] * row
        out = pd.DataFrame(sums, columns=X.ROUGE_KEYS)
        yield out.assign(b=np.arange(bootstrap), w=weight)

    schema = ", ".join(f"{k} double" for k in X.ROUGE_KEYS) + ", b long, w double"
    means = scored.mapInPandas(resample, schema).groupBy("b").agg(
        *[(100 * F.sum(k) / F.sum("w")).alias(k) for k in X.ROUGE_KEYS]
    )
    return means.agg(*[F.round(F.percentile(k, 0.5), 4).alias(k) for k in X.ROUGE_KEYS])


def char_error_rate(df: DataFrame, pred: str, ref: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        (F.sum(F.levenshtein(pred, ref)) / F.sum(F.length(ref))).alias("cer")
    )


def word_error_rate(df: DataFrame, pred: str, ref: str, keys: list[str] | None = None) -> DataFrame:
    words = F.size(F.filter(F.split(ref, r"(?U)\s+", -1), lambda w: w != ""))
    edits = df.select(*(keys or []), X.word_edits(F.col(pred), F.col(ref)).alias("_e"), words.alias("_n"))
    return edits.groupBy(*(keys or [])).agg((F.sum("_e") / F.sum("_n")).alias("wer"))


def accuracy(df: DataFrame, pred: str, label: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg((100 * F.avg((F.col(pred) == F.col(label)).cast("double"))).alias("accuracy"))


def spearman(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Rank correlation with average ranks for ties; null without variation.

    Pairs of values are counted first, and ranks come from running totals over distinct values. What is
    joined are distinct pairs, salted where a value has many, so no value, however frequent, meets in one task.
    """
    keys = list(keys or [])
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    pairs = materialize(pairs.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.to_json(F.struct(*keys)) if keys else F.lit("{}")))

    def ranks(col: str, out: str) -> DataFrame:
        values = pairs.groupBy("_k", F.col(col).alias("_v")).agg(F.sum("_n").alias("_c"))
        placed = running_total(values, "_before", ["_v"], ["_k"], weight=F.col("_c"), spread="range", total="_all")
        # from the middle of all ranks, so that sums of products lose nothing
        return placed.select("_k", F.col("_v").alias(col), (F.col("_before") + F.col("_c") / 2.0 - F.col("_all") / 2.0).alias(out))

    ranked = skew_join(pairs, ranks("_a", "_ra"), ["_k", "_a"], "_b")
    ranked = skew_join(ranked, ranks("_b", "_rb"), ["_k", "_b"], "_a")
    square = lambda x: F.sum(F.col("_n") * F.col(x) * F.col(x))
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_ra") * F.col("_rb")).alias("_s"), (F.sqrt(square("_ra")) * F.sqrt(square("_rb"))).alias("_d"))
    return sums.select(*keys, F.when(F.col("_d") > 0, F.col("_s") / F.col("_d")).alias("spearman"))


TASK_METRICS = {
    "Accuracy": lambda pred, refs: (F.get(refs, F.lit(0)) == pred).cast("double"),
    "Squad EM": lambda pred, refs: exact_match(pred, refs, articles=True).cast("double"),
    "Squad F1": lambda pred, refs: answer_f1(pred, refs, articles=True),
    "Trivia QA": lambda pred, refs: exact_match(pred, refs, articles=True).cast("double"),
    "ROUGE": lambda pred, refs: X.rouge_l_max(pred, refs),
}


def task_metrics(df: DataFrame, names: list[str], pred: str = "prediction", refs: str = "references", keys: list[str] | None = None) -> DataFrame:
    """Named row-level metrics, averaged (x100) per group, one column each."""
    unknown = set(names) - set(TASK_METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    rows = df.select(*(keys or []), *[TASK_METRICS[n](F.col(pred), F.col(refs)).alias(n) for n in names])
    return rows.groupBy(*(keys or [])).agg(*[F.round(100 * F.avg(n), 4).alias(n) for n in names])


# A metric of the registry: rows with (keys, prediction, references, context) to (keys, name, value).
RegistryMetric = Callable[[DataFrame, list[str]], DataFrame]


def _stacked(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.name", "_p.value")


def _row_means(**scores: Callable[[Column, Column], Column]) -> RegistryMetric:
    def metric(rows: DataFrame, keys: list[str]) -> DataFrame:
        scored = rows.select(*keys, *[f(F.col("prediction"), F.col("references")).alias(n) for n, f in scores.items()])
        means = scored.groupBy(*keys).agg(*[(100 * F.avg(n)).alias(n) for n in scores])
        return _stacked(means, keys, list(scores))

    return metric


def _first(refs: Column) -> Column:
    return F.get(refs, F.lit(0))


def _corpus_bleu(rows: DataFrame, keys: list[str]) -> DataFrame:
    tokens = rows.select(*keys, T.regex_tokens("prediction").alias("p"), F.transform("references", T.regex_tokens).alias("r"))
    return _stacked(bleu(tokens, "p", "r", keys), keys, ["bleu"])


def _mean_rouge(rows: DataFrame, keys: list[str]) -> DataFrame:
    scored = rows.select(*keys, X.rouge_scores(F.col("prediction"), _first(F.col("references"))).alias("s"))
    names = ["rouge1", "rouge2", "rougeLsum"]
    return _stacked(scored.groupBy(*keys).agg(*[(100 * F.avg(f"s.{n}")).alias(n) for n in names]), keys, names)


def _spearman_metric(rows: DataFrame, keys: list[str]) -> DataFrame:
    numbers = rows.select(*keys, F.expr("try_cast(prediction as double)").alias("p"), F.expr("try_cast(references[0] as double)").alias("r"))
    found = spearman(numbers, "p", "r", keys)
    return found.select(*keys, F.lit("spearman_corrcoef").alias("name"), (100 * F.col("spearman")).alias("value"))


def span_text(pred: Column, context: Column) -> Column:
    """The words of ``context`` that a prediction of the form ``start: i end: j`` names; empty if it names none."""

    def words(c: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(c, r"(?U)\W", " "), r"\s+", -1), lambda w: w != "")

    number = lambda i: F.get(words(pred), F.lit(i)).try_cast("int")
    start, end = number(1), number(3)
    span = F.slice(words(context), start + 1, F.greatest(end - start + 1, F.lit(0)))
    return F.coalesce(F.array_join(F.when(start.isNotNull() & end.isNotNull(), span), " "), F.lit(""))


_squad = _row_means(em=TASK_METRICS["Squad EM"], f1=TASK_METRICS["Squad F1"])
_accuracy = _row_means(accuracy=TASK_METRICS["Accuracy"])

# The names of the registry.
REGISTRY: dict[str, RegistryMetric] = {
    "BLEU": _corpus_bleu,
    "ROUGE": _mean_rouge,
    "Span Squad": lambda rows, keys: _squad(rows.withColumn("prediction", span_text(F.col("prediction"), F.col("context"))), keys),
    "Squad": _squad,
    "Trivia QA": _squad,
    "Accuracy": _accuracy,
    "Spearman Correlation": _spearman_metric,
    "Other": _accuracy,
}

# Prediction and references to what a metric shall see; the key None holds for every metric.
Hooks = dict[str | None, Callable[[Column, Column], tuple[Column, Column]]]


def registry_metrics(
    df: DataFrame, names: list[str], keys: list[str] | None = None, hooks: Hooks | None = None, registry: dict[str, RegistryMetric] | None = None
) -> DataFrame:
    """(keys, metric, name, value) of the named metrics of the registry per group.

    ``df`` has ``prediction`` and ``references``; ``Span Squad`` also needs ``context``. Values are percentages, as
    the registry's names have them. A hook changes prediction and references for its metric alone; a
    hook under None takes the place of all others. ``registry`` adds metrics of the user's own or replaces some.
    """
    keys, hooks, known = list(keys or []), hooks or {}, REGISTRY | (registry or {})
    if unknown := set(names) - set(known):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    out = []
    for name in names:
        hook = hooks.get(None) or hooks.get(name)
        rows = df
        if hook:
            pred, refs = hook(F.col("prediction"), F.col("references"))
            rows = df.withColumns({"prediction": pred, "references": refs})
        found = known[name](rows, keys)
        out.append(found.select(*keys, F.lit(name).alias("metric"), "name", "value"))
    return reduce(DataFrame.unionByName, out)


# error logs ----------------------------------------------------------------------------------------


def count_by_error(logs: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(error, n): how often each error occurs, without the excluded ones."""
    rows = logs.join(exclude.select("error"), "error", "left_anti") if exclude is not None else logs
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def failed_tests(logs: DataFrame, counts: DataFrame) -> DataFrame:
    """The tests behind each counted error, one row each (an error may have any number of them)."""
    return logs.join(counts, "error").select("error", "n", "test", "line")


def count_by_model(logs: DataFrame) -> DataFrame:
    """(model, n, top_error, top_n): errors per group and its most frequent one (ties: smaller name)."""
    per = logs.filter(F.col("model").isNotNull()).groupBy("model", "error").agg(F.count(F.lit(1)).alias("_c"))
    return per.groupBy("model").agg(
        F.sum("_c").alias("n"),
        F.min(F.struct((-F.col("_c")).alias("c"), F.col("error").alias("e"))).alias("_t"),
    ).select("model", "n", F.col("_t.e").alias("top_error"), (-F.col("_t.c")).alias("top_n"))


def eval_report(averages: DataFrame, details: DataFrame) -> DataFrame:
    """(dataset, part, place, line): the lines of one text report per dataset, in order.

    Lines stay rows, so a dataset with any number of predictions is written by any number of tasks.
    """
    head = averages.select(
        "dataset", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"),
        F.concat_ws(" | ", F.col("value").cast("string"), F.col("loss").cast("string"), F.col("tot_loss").cast("string")).alias("line"),
    )
    body = details.select(
        "dataset", F.lit(1).alias("part"), F.col("id").cast("long").alias("place"),
        F.concat_ws("\t\t", T.strip("label"), T.strip("prediction")).alias("line"),
    )
    return head.unionByName(body)


def demo_label_balance(demos: DataFrame, keys: list[str], label: str) -> DataFrame:
    return demos.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def retriever_recall(scores: DataFrame, order: str, score: str) -> DataFrame:
    """Running mean of a per-question score in ``order``; its last row is the final mean."""
    placed = running_total(scores.select(order, score), "_sum", [order], weight=F.col(score).cast("double"))
    placed = running_total(placed, "_n", [order])
    return placed.select(order, ((F.col("_sum") + F.col(score)) / (F.col("_n") + 1)).alias("mean"))


# tables --------------------------------------------------------------------------------------------


def table_query(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Answer many table queries at once: (query_id, row, text, number).

    ``rows``: (table_id, row, cells array<string>, types array<string> of ``text``/``real``).
    ``queries``: (query_id, table_id, sel, agg, conds array<struct<col,op,value>>); ``op`` is 0 =,
    1 >, 2 <; ``agg`` is 0 none, 1 max, 2 min, 3 count, 4 sum, 5 average. Text compares by its
    lower-cased tokens, numbers by value; all conditions must hold.

    Rules: nothing found -> ``none`` (count: 0). Count -> a number. One row found, or max / min -> the
    number in the cell, or its text. None over several rows -> the texts. Sum and average need numbers.

    A question that many queries ask of a table is answered once; its summary, or its rows where the answer
    is a list, then go to each of them.
    """
    numbers = rows.withColumn("nums", F.transform("cells", T.parse_number))
    question = F.sha2(F.to_json(F.struct("table_id", "sel", "conds")), 256)
    askers = queries.select("query_id", "agg", question.alias("question"))
    distinct = queries.select(question.alias("question"), "table_id", "sel", "conds").dropDuplicates(["question"])
    asked = distinct.withColumn(
        "conds",
        F.transform(
            "conds",
            lambda c: F.struct(
                c["col"].alias("col"),
                c["op"].alias("op"),
                T.parse_number(c["value"]).alias("num"),
                T.match_tokens(c["value"]).alias("words"),
            ),
        ),
    )
    joined = numbers.join(asked, "table_id")

    def compare(op: Column, left: Column, right: Column) -> Column:
        return F.when(op == 0, left == right).when(op == 1, left > right).otherwise(left < right)

    def holds(c: Column) -> Column:
        number = compare(c["op"], F.get("nums", c["col"]), c["num"])
        word = compare(c["op"], T.match_tokens(F.get("cells", c["col"])), c["words"])
        return F.coalesce(F.when(F.get("types", c["col"]) == "real", number).otherwise(word), F.lit(False))

    hits = joined.filter(F.forall("conds", holds)).select(
        "question",
        "row",
        F.get("cells", F.col("sel")).alias("text"),
        F.get("nums", F.col("sel")).alias("number"),
        F.get("types", F.col("sel")).alias("kind"),
    )
    is_real = F.col("kind") == "real"
    order = F.struct(
        F.when(is_real, F.col("number")).otherwise(0.0).alias("a"),
        F.when(is_real, "").otherwise(F.col("text")).alias("b"),
        F.col("row").alias("c"),
    )
    picked = F.struct("text", "number", "row")
    answers = hits.groupBy("question").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("number").alias("s"),
        F.count(F.when(F.col("kind") == "real", F.col("number"))).alias("nn"),
        F.max(order).alias("most"),
        F.min(order).alias("least"),
        F.max_by(picked, order).alias("hi"),
        F.min_by(picked, order).alias("lo"),
    )
    # an id that comes with several questions has the rows of all of them
    summed = askers.join(answers, "question").groupBy("query_id", "agg").agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("nn").alias("nn"),
        F.max_by("hi", "most").alias("hi"),
        F.min_by("lo", "least").alias("lo"),
    )
    single = (F.col("n") == 1) & (F.col("agg") != 3)
    best = F.when((F.col("agg") == 1) | single, F.col("hi")).when(F.col("agg") == 2, F.col("lo"))
    number = (
        F.when(F.col("agg") == 3, F.col("n").cast("double"))
        .when(best.isNotNull(), best["number"])
        .when((F.col("agg") == 4) & (F.col("nn") == F.col("n")), F.col("s"))
        .when((F.col("agg") == 5) & (F.col("nn") == F.col("n")), F.col("s") / F.col("n"))
    )
    scalar = F.col("agg").isin(1, 2, 3) | single | (F.col("agg").isin(4, 5) & (F.col("nn") == F.col("n")))
    one = summed.filter(scalar).select(
        "query_id",
        F.coalesce(best["row"], F.lit(-1)).cast("long").alias("row"),
        F.when(F.col("agg") == 3, F.lit(None).cast("string")).otherwise(best["text"]).alias("text"),
        number.alias("number"),
    )
    many = (
        askers.join(summed.filter(~scalar).select("query_id"), "query_id", "left_semi")
        .join(hits, "question")
        .select("query_id", F.col("row").cast("long").alias("row"), "text", F.lit(None).cast("double").alias("number"))
    )
    nothing = queries.join(summed, "query_id", "left_anti").select(
        "query_id",
        F.lit(-1).cast("long").alias("row"),
        F.when(F.col("agg") == 3, F.lit(None).cast("string")).otherwise(F.lit("none")).alias("text"),
        F.when(F.col("agg") == 3, F.lit(0.0)).alias("number"),
    )
    return one.unionByName(many).unionByName(nothing)
