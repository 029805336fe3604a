"""Answer spans, entities and label scores from model outputs.

Start and end positions are cut to their best few inside the row before they are paired, so a window
never explodes into all of its position pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.arrays import fan_out
from corpusloom.functions import vectors as V
from corpusloom.ids import running_total, top_per_group
from corpusloom.session import materialize



def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _flag(arr: Column, at: Column) -> Column:
    """Whether position ``at`` of a flag array is set."""
    return F.coalesce(F.get(arr, at).cast("boolean"), F.lit(False))


def top_positions(arr: str | Column, n: int) -> Column:
    """The ``n`` best positions as structs (i, v), best first, smaller position on ties."""
    ranked = F.array_sort(F.transform(_c(arr), lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: F.struct(s["i"].alias("i"), (-s["neg"]).alias("v")))


def _pairs(starts: Column, ends: Column, keep: int, ok) -> Column:
    """Best ``keep`` admissible (start, end) pairs of two short lists, as structs."""
    every = F.flatten(
        F.transform(
            starts,
            lambda s: F.transform(
                ends,
                lambda e: F.struct(
                    (-(s["v"] + e["v"])).alias("neg"), s["i"].alias("s"), e["i"].alias("e"), s["v"].alias("sv"), e["v"].alias("ev")
                ),
            ),
        )
    )
    return F.slice(F.array_sort(F.filter(every, ok)), 1, keep)


def _in_context(offsets: Column, at: Column) -> Column:
    return F.coalesce(F.get(offsets, at)["s"].isNotNull(), F.lit(False))


def qa_candidates(
    features: DataFrame, n_best: int = 20, max_answer: int = 30, max_context: str | None = None
) -> DataFrame:
    """Best pairs of every window.

    ``features``: (example_id, feature_id, offsets array<struct<s,e>> with null outside the context,
    start_logits, end_logits); ``max_context`` names an optional array of flags.
    """

    def ok(p: Column) -> Column:
        good = _in_context(F.col("offsets"), p["s"]) & _in_context(F.col("offsets"), p["e"])
        good = good & (p["e"] >= p["s"]) & (p["e"] - p["s"] + 1 <= max_answer)
        return good & _flag(F.col(max_context), p["s"]) if max_context else good

    pairs = V.let(
        top_positions("end_logits", n_best), lambda ends: _pairs(top_positions("start_logits", n_best), ends, n_best, ok)
    )
    return _placed(fan_out(features, ["example_id", "feature_id", "offsets"], pairs, "p"))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select(
        "example_id",
        "feature_id",
        F.get("offsets", F.col("p.s"))["s"].alias("from"),
        F.get("offsets", F.col("p.e"))["e"].alias("to"),
        F.col("p.sv").alias("start_logit"),
        F.col("p.ev").alias("end_logit"),
        (-F.col("p.neg")).alias("score"),
    )


def null_scores(features: DataFrame) -> DataFrame:
    """Smallest first-position score over the windows of an example."""
    rows = features.select(
        "example_id",
        "feature_id",
        F.get("start_logits", F.lit(0)).cast("double").alias("start_logit"),
        F.get("end_logits", F.lit(0)).cast("double").alias("end_logit"),
    ).withColumn("score", F.col("start_logit") + F.col("end_logit"))
    best = F.min_by(F.struct("start_logit", "end_logit", "score"), F.struct("score", "feature_id"))
    return rows.groupBy("example_id").agg(best.alias("n")).select("example_id", "n.*")


def qa_nbest(
    features: DataFrame,
    examples: DataFrame,
    n_best: int = 20,
    max_answer: int = 30,
    with_negative: bool = False,
    max_context: str | None = None,
) -> DataFrame:
    """N-best answers per example: (example_id, rank, text, start_logit, end_logit, score, probability).

    With negatives the null answer takes part, and is added back as the last entry when its score
    did not make the list. An example without any usable answer gets the answer ``empty``.
    """
    cand = qa_candidates(features, n_best, max_answer, max_context).withColumn("is_null", F.lit(0))
    if with_negative:
        nulls = null_scores(features).select(
            "example_id", F.lit(-1).cast("long").alias("feature_id"), F.lit(0).alias("from"), F.lit(0).alias("to"),
            "start_logit", "end_logit", "score", F.lit(1).alias("is_null"),
        )
        cand = cand.withColumn("feature_id", F.col("feature_id").cast("long")).unionByName(nulls)
    order = [F.desc("score"), F.col("is_null"), F.col("feature_id"), F.col("from"), F.col("to")]
    ranked = cand.withColumn("rank", F.row_number().over(Window.partitionBy("example_id").orderBy(*order)))
    kept = ranked.filter((F.col("rank") <= n_best) | (F.col("is_null") == 1))
    joined = examples.select("example_id", "context").join(kept, "example_id", "left")
    text = F.expr("substring(context, `from` + 1, `to` - `from`)")
    rows = joined.select("example_id", "rank", "is_null", text.alias("text"), "start_logit", "end_logit", "score")
    # examples whose list is missing or is only an empty text get a stand-in of score zero
    sizes = rows.groupBy("example_id").agg(
        F.count("rank").alias("_n"), F.max(F.length(F.coalesce("text", F.lit("")))).alias("_len")
    )
    lonely = sizes.filter((F.col("_n") == 0) | ((F.col("_n") == 1) & (F.col("_len") == 0))).select("example_id")
    zero = F.lit(0.0)
    stand_in = lonely.select(
        "example_id", F.lit(0).alias("rank"), F.lit(0).alias("is_null"), F.lit("empty").alias("text"),
        zero.alias("start_logit"), zero.alias("end_logit"), zero.alias("score"),
    )
    rows = rows.filter(F.col("rank").isNotNull()).unionByName(stand_in)
    return _with_probability(rows)


def _with_probability(rows: DataFrame) -> DataFrame:
    """Softmax over the entries of an example and ranks 1..n."""
    per = Window.partitionBy("example_id")
    power = F.exp(F.col("score") - F.max("score").over(per))
    rows = rows.withColumn("_e", power)
    rows = rows.withColumn("probability", F.col("_e") / F.sum("_e").over(per)).drop("_e")
    return rows.withColumn("rank", F.row_number().over(per.orderBy("rank")))


def qa_final(nbest: DataFrame, nulls: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """The answer per example: the best one, or the empty text when the null answer wins by more than
    ``threshold`` over the best non-empty one."""
    if nulls is None:
        best = nbest.groupBy("example_id").agg(F.min_by("text", "rank").alias("answer"))
        return best
    filled = nbest.filter(F.col("text") != "").groupBy("example_id").agg(
        F.min_by(F.struct("text", "start_logit", "end_logit"), "rank").alias("b")
    )
    diff = F.col("score") - F.col("b.start_logit") - F.col("b.end_logit")
    return filled.join(nulls.select("example_id", "score"), "example_id").select(
        "example_id", F.when(diff > threshold, "").otherwise(F.col("b.text")).alias("answer"), diff.alias("null_diff")
    )


def qa_nbest_beam(features: DataFrame, examples: DataFrame, n_best: int = 20, max_answer: int = 30) -> DataFrame:
    """The same from given top starts and, per start, top ends.

    ``features`` adds start_index, start_log_prob (n) and end_index, end_log_prob (n * m, start-major).
    """
    m = (F.size("end_index") / F.size("start_index")).cast("int")
    every = F.flatten(
        F.transform(
            F.arrays_zip("start_index", "start_log_prob"),
            lambda s, i: F.transform(
                F.arrays_zip(
                    F.slice("end_index", i * m + 1, m).alias("e"), F.slice("end_log_prob", i * m + 1, m).alias("v")
                ),
                lambda e: F.struct(
                    (-(s["start_log_prob"] + e["v"])).cast("double").alias("neg"),
                    s["start_index"].alias("s"),
                    e["e"].alias("e"),
                    s["start_log_prob"].cast("double").alias("sv"),
                    e["v"].cast("double").alias("ev"),
                ),
            ),
        )
    )

    def ok(p: Column) -> Column:
        good = _in_context(F.col("offsets"), p["s"]) & _in_context(F.col("offsets"), p["e"])
        return good & (p["e"] >= p["s"]) & (p["e"] - p["s"] + 1 <= max_answer)

    best = F.slice(F.array_sort(F.filter(every, ok)), 1, n_best)
    cand = _placed(fan_out(features, ["example_id", "feature_id", "offsets"], best, "p"))
    order = [F.desc("score"), F.col("feature_id"), F.col("from"), F.col("to")]
    kept = top_per_group(cand, ["example_id"], order, n_best, out="rank")
    joined = examples.select("example_id", "context").join(kept, "example_id", "left")
    tiny = F.lit(-1e-6)
    rows = joined.select(
        "example_id",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        F.coalesce(F.expr("substring(context, `from` + 1, `to` - `from`)"), F.lit("")).alias("text"),
        F.coalesce("start_logit", tiny).alias("start_logit"),
        F.coalesce("end_logit", tiny).alias("end_logit"),
        F.coalesce("score", F.lit(-2e-6)).alias("score"),
    )
    return _with_probability(rows)


def span_decode(
    windows: DataFrame, k: int = 1, max_answer: int = 15, impossible: bool = False, key: str = "example_id", digits: int | None = None
) -> DataFrame:
    """Masked softmax, product score, top-k spans over the windows of an example.

    ``windows``: (key, window, start, end, mask) where mask is 1 for tokens that may answer. Position
    0 takes part in the softmax but not in the spans; ``impossible`` adds its smallest product as the
    empty answer (start and end -1).
    """

    def probabilities(col: str) -> Column:
        masked = F.zip_with(F.col(col), F.col("mask"), lambda x, m: F.when(m == 1, x.cast("double")).otherwise(F.lit(-10000.0)))
        return V.softmax(masked)

    graded = lambda p: p if digits is None else F.round(p, digits)
    probs = windows.select(key, "window", "mask", probabilities("start").alias("s"), probabilities("end").alias("e"))

    def from_start(i: Column) -> Column:
        ends = F.sequence(i, F.least(i + max_answer - 1, F.size("e") - 1))
        return F.transform(
            F.filter(ends, lambda j: F.get("mask", j) == 1),
            lambda j: F.struct(
                (-graded(F.get("s", i) * F.get("e", j))).alias("neg"), i.alias("s"), j.alias("e")
            ),
        )

    starts = F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("mask", i) == 1)
    best = F.slice(F.array_sort(F.flatten(F.transform(starts, from_start))), 1, k)
    usable = probs.filter(F.size("s") > 1)
    spans = fan_out(usable, [key, "window"], best, "p").select(
        key, "window", F.col("p.s").alias("start"), F.col("p.e").alias("end"), (-F.col("p.neg")).alias("score")
    )
    if impossible:
        empty = probs.groupBy(key).agg(graded(F.min(F.get("s", F.lit(0)) * F.get("e", F.lit(0)))).alias("score"))
        spans = spans.unionByName(
            empty.select(key, F.lit(-1).alias("window"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), "score")
        )
    order = [F.desc("score"), F.col("window"), F.col("start"), F.col("end")]
    return top_per_group(spans, [key], order, k, out="rank")


def best_valid_span(df: DataFrame, k: int, max_width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Best sum of a top-k start and a top-k end whose width lies in [0, max_width]."""

    def penalty(p: Column) -> Column:
        bad = (p["e"] < p["s"]) | (p["e"] - p["s"] > max_width)
        return F.when(bad, F.lit(1e8)).otherwise(F.lit(0.0))

    every = V.let(
        top_positions(end, k), lambda ends: _pairs(top_positions(start, k), ends, k * k, lambda p: F.lit(True))
    )
    scored = F.transform(every, lambda p: F.struct((p["neg"] + penalty(p)).alias("neg"), p["e"].alias("e"), p["s"].alias("s")))
    keep = [c for c in df.columns if c not in (start, end)]
    found = df.select(*keep, F.array_min(scored).alias("_b"))
    best = F.col("_b")
    return found.select(*keep, best["s"].alias("start"), best["e"].alias("end"), (-best["neg"]).alias("score"))


def entity_pairs(df: DataFrame, threshold: float = 0.7, start: str = "p_start", end: str = "p_end") -> DataFrame:
    """All start < end pairs whose product reaches the threshold, best first.

    Both values are probabilities, so only positions that reach the threshold alone can take part.
    """

    def alone(col: str) -> Column:
        placed = F.transform(F.col(col), lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v")))
        return F.filter(placed, lambda s: s["v"] >= threshold)

    every = F.flatten(
        F.transform(
            alone(start),
            lambda s: F.transform(
                F.filter(F.col("_ends"), lambda e: (e["i"] > s["i"]) & (e["v"] * s["v"] >= threshold)),
                lambda e: F.struct((s["v"] * e["v"]).alias("score"), s["i"].alias("s"), e["i"].alias("e")),
            ),
        )
    )
    keep = [c for c in df.columns if c not in (start, end)]
    out = fan_out(df.withColumn("_ends", alone(end)), keep, every, "p")
    return out.select(*keep, F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.col("p.score").alias("score"))


# entities ------------------------------------------------------------------------------------------


def token_labels(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """Each token with its best label and score (no grouping)."""
    names = F.array(*[F.lit(x) for x in labels])
    at = V.argmax("scores")
    return tokens.withColumn("entity", F.element_at(names, at + 1)).withColumn("score", F.array_max("scores"))


def words_from_subwords(tokens: DataFrame, labels: list[str], strategy: str, sent: str = "sent_id", pos: str = "index") -> DataFrame:
    """One row per word: label by its FIRST piece, its MAX piece or the AVERAGE of its pieces.

    ``tokens``: (sent, index, word, start, end, is_subword, scores). A word starts at every piece that
    is no sub-word; islands are numbered by a running sum inside the sentence.
    """
    names = F.array(*[F.lit(x) for x in labels])
    order = Window.partitionBy(sent).orderBy(pos)
    fresh = F.when(F.col("is_subword") & (F.row_number().over(order) > 1), 0).otherwise(1)
    marked = tokens.withColumn("_f", fresh).withColumn(
        "_w", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    if strategy == "FIRST":
        vector = F.min_by("scores", pos)
    elif strategy == "MAX":
        vector = F.min_by("scores", F.struct((-F.array_max("scores")).alias("a"), F.col(pos).alias("b")))
    elif strategy == "AVERAGE":
        vector = F.array(*[F.avg(F.element_at("scores", i + 1).cast("double")) for i in range(len(labels))])
    else:
        raise ValueError("strategy is FIRST, MAX or AVERAGE")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(pos, "word"))), lambda s: F.regexp_replace(s["word"], "^##", ""))
    words = marked.groupBy(sent, "_w").agg(
        vector.alias("_v"),
        F.min(pos).alias(pos),
        F.array_join(pieces, "").alias("word"),
        F.min_by("start", pos).alias("start"),
        F.max_by("end", pos).alias("end"),
    )
    return words.select(
        sent, pos, "word", "start", "end",
        F.element_at(names, V.argmax("_v") + 1).alias("entity"),
        F.array_max("_v").cast("double").alias("score"),
    )


def group_entities(entities: DataFrame, sent: str = "sent_id", pos: str = "index", joiner: str = " ") -> DataFrame:
    """Adjacent rows of the same tag become one entity unless the later one is ``B-``.

    Mean score, start of the first, end of the last; pieces marked ``##`` are glued on.
    """
    order = Window.partitionBy(sent).orderBy(pos)
    inner = F.regexp_replace("entity", "^[BI]-", "")
    tagged = entities.withColumn("_tag", inner).withColumn("_b", F.startswith(F.col("entity"), F.lit("B-")))
    joins = (F.lag("_tag").over(order) == F.col("_tag")) & ~F.col("_b")
    tagged = tagged.withColumn("_new", F.when(joins, 0).otherwise(1))
    tagged = tagged.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.transform(F.array_sort(F.collect_list(F.struct(pos, "word"))), lambda s: s["word"])
    text = F.replace(F.array_join(words, joiner), F.lit(joiner + "##"), F.lit(""))
    return (
        tagged.groupBy(sent, "_g")
        .agg(
            F.element_at(F.split(F.min_by("entity", pos), "-", -1), -1).alias("entity_group"),
            F.avg("score").alias("score"),
            text.alias("word"),
            F.min_by("start", pos).alias("start"),
            F.max_by("end", pos).alias("end"),
        )
        .withColumnRenamed("_g", "group")
    )


# label scores --------------------------------------------------------------------------------------


def label_scores(df: DataFrame, labels: list[str], fn: str = "softmax", k: int | None = 1, logits: str = "logits") -> DataFrame:
    """The best ``k`` labels (all when None), one row each: (..., rank, label, score)."""
    scored = {"softmax": V.softmax(logits), "sigmoid": V.sigmoid(logits), "none": F.transform(logits, lambda x: x.cast("double"))}[fn]
    names = F.array(*[F.lit(x) for x in labels])
    ranked = F.array_sort(F.transform(scored, lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))
    ranked = F.slice(ranked, 1, k) if k else ranked
    keep = [c for c in df.columns if c != logits]
    out = fan_out(df, keep, ranked, "_s", "rank")
    return out.select(*keep, (F.col("rank") + 1).alias("rank"), F.element_at(names, F.col("_s.i") + 1).alias("label"), (-F.col("_s.neg")).alias("score"))


def zero_shot_scores(
    pairs: DataFrame, multi_label: bool, text_id: str = "text_id", temperature: float = 1.0
) -> DataFrame:
    """(text_id, label, score, rank) from (text_id, label_id, label, entail, contradict) logits.

    One label: softmax of entailment over the labels of a text. Several: entailment against
    contradiction per label. A text has as many rows as candidate labels.
    """
    e, c = F.col("entail").cast("double") / temperature, F.col("contradict").cast("double") / temperature
    per = Window.partitionBy(text_id)
    if multi_label:
        scored = pairs.withColumn("score", 1.0 / (1.0 + F.exp(c - e)))
    else:
        shifted = pairs.withColumn("_x", F.exp(e - F.max(e).over(per)))
        scored = shifted.withColumn("score", F.col("_x") / F.sum("_x").over(per)).drop("_x")
    rank = F.row_number().over(per.orderBy(F.desc("score"), "label_id"))
    return scored.withColumn("rank", rank).select(text_id, "label_id", "label", "score", "rank")


def score_options(losses: DataFrame, samples: DataFrame, normalize: bool = False) -> DataFrame:
    """Prediction and losses per sample from token losses of its options.

    ``losses``: (sample_id, option, pos, loss); ``samples``: (sample_id, gold, prefix_loss, input_len).
    The option of least loss wins, the lower number on ties. ``gold_tot_loss`` adds the prefix; with
    ``normalize`` it uses the mean option loss as it stands.
    """
    per = losses.groupBy("sample_id", "option").agg(F.sum("loss").alias("sum"), F.count(F.lit(1)).alias("len"))
    per = per.withColumn("mean", F.col("sum") / F.col("len"))
    used = F.col("mean") if normalize else F.col("sum")
    joined = per.withColumn("used", used).join(samples, "sample_id")
    is_gold = F.col("option") == F.col("gold")
    return joined.groupBy("sample_id").agg(
        F.min_by("option", F.struct("used", "option")).alias("pred"),
        F.min("used").alias("min_loss"),
        F.max("gold").alias("gold"),
        F.max(F.when(is_gold, F.col("mean"))).alias("gold_loss"),
        F.max(F.when(is_gold, (F.col("prefix_loss") + F.col("used")) / (F.col("input_len") + F.col("len")))).alias("gold_tot_loss"),
    )


def fill_top_k(probs: DataFrame, k: int, targets: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Best ``k`` tokens per masked position from (keys, token, logit); softmax over all tokens first.

    Sums and maxima are partial aggregates; the position's rows are ranked under a group limit.
    """
    keys = keys or ["text_id", "pos"]
    tops = probs.groupBy(*keys).agg(F.max("logit").alias("_m"))
    shifted = probs.join(tops, keys).withColumn("_e", F.exp(F.col("logit") - F.col("_m")))
    sums = shifted.groupBy(*keys).agg(F.sum("_e").alias("_s"))
    scored = shifted.join(sums, keys).select(*keys, "token", (F.col("_e") / F.col("_s")).alias("score"))
    if targets is not None:
        scored = scored.join(targets.select("token").distinct(), "token", "left_semi")
    return top_per_group(scored, keys, [F.desc("score"), F.col("token")], k, out="rank")


def merge_overlaps(
    chunks: DataFrame, key: str, order: str = "ord", tokens: str = "tokens", special: list[int] | None = None
) -> DataFrame:
    """(key, order, offset, tokens): what each chunk adds to its item, and where in the merged item it stands.

    A chunk adds what follows its overlap with its neighbour before it. The overlap is the length, from 1 to
    the shorter of both, with the largest share of positions where the neighbour's end and the chunk's
    beginning agree, plus a ten-thousandth per position; at least two must agree, and the shorter wins ties.

    All borders are compared at once, each with its own neighbour, and offsets are running totals: no
    item is ever in one task. :func:`merged_items` puts the pieces of an item together.
    """
    clean = F.filter(tokens, lambda t: ~t.isin(special)) if special else F.col(tokens)
    rows = chunks.select(key, order, F.coalesce(clean.cast("array<long>"), F.array().cast("array<long>")).alias("_t"))
    placed = materialize(running_total(rows, "_at", [order], keys=[key]))
    before = placed.select(key, (F.col("_at") + 1).alias("_at"), F.col("_t").alias("_b"))
    pairs = placed.join(before, [key, "_at"], "left")
    own = F.expr("slice(_t, _o + 1, size(_t))")
    added = pairs.withColumn("_o", F.coalesce(_overlap("_b", "_t"), F.lit(0))).select(key, order, own.alias(tokens))
    return running_total(materialize(added), "offset", [order], keys=[key], weight=F.size(tokens).cast("long")).select(key, order, "offset", tokens)


@F.arrow_udf(T.IntegerType())
def _overlap(before: pa.Array, after: pa.Array) -> pa.Array:
    """Length of the best overlap per pair. Equal tokens at places i and j agree in the one overlap of length j + (size - i)."""
    out = []
    for left, right in zip(before, after):
        if not left.is_valid or not len(left.values) or not len(right.values):
            out.append(0)
            continue
        a, b = left.values.to_numpy(zero_copy_only=False), right.values.to_numpy(zero_copy_only=False)
        most = min(len(a), len(b))
        at, to = np.nonzero(a[len(a) - most :, None] == b[None, :most])
        lengths = to + most - at
        agree = np.bincount(lengths[lengths <= most], minlength=most + 1)[1:]
        n = np.arange(1, most + 1)
        value = np.where(agree > 1, agree / n + n / 10000.0, 0.0)
        out.append(int(np.argmax(value)) + 1 if value.any() else 0)
    return pa.array(out, pa.int32())


def merged_items(pieces: DataFrame, key: str, order: str = "ord", tokens: str = "tokens") -> DataFrame:
    """(key, tokens): whole items from the pieces of :func:`merge_overlaps`, for items that fit one row."""
    lists = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, tokens))).alias("_l"))
    return lists.select(key, F.flatten(F.transform("_l", lambda s: s[tokens])).alias(tokens))


def evidence_positions(blocks: DataFrame, answers: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, block_id, answer, has, starts, ends): where each answer's tokens occur in each block.

    ``blocks``: (key, block_id, tokens); ``answers``: (key, answer array). A question has a fixed
    number of retrieved blocks and of accepted answers.
    """
    joined = blocks.join(answers, key)
    n, m = F.size("tokens"), F.size("answer")
    first = F.sequence(F.lit(1), n - m + 1)
    hits = F.filter(first, lambda i: F.slice("tokens", i, F.size("answer")) == F.col("answer"))
    hits = F.when((n >= m) & (m > 0), hits).otherwise(F.array().cast("array<int>"))
    out = joined.withColumn("_h", hits)
    return out.select(
        key, "block_id", "answer",
        (F.size("_h") > 0).alias("has"),
        F.transform("_h", lambda i: i - 1).alias("starts"),
        F.transform("_h", lambda i: i + F.size("answer") - 2).alias("ends"),
    )


def evidence_table(positions: DataFrame, key: str = "question_id") -> DataFrame:
    """Per block: whether any answer occurs and all positions, padded with -1 to the longest list."""
    per = positions.groupBy(key, "block_id").agg(
        F.max("has").alias("has"),
        F.flatten(F.collect_list("starts")).alias("_s"),
        F.flatten(F.collect_list("ends")).alias("_e"),
    )
    longest = per.groupBy(key).agg(F.max(F.size("_s")).alias("_n"))
    fill = lambda c: F.concat(F.array_sort(c), F.array_repeat(F.lit(-1), F.col("_n") - F.size(c)))
    return per.join(longest, key).select(key, "block_id", "has", fill(F.col("_s")).alias("starts"), fill(F.col("_e")).alias("ends"))
