"""Records to prompts: rendering, catalogs, conversions and few-shot texts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from corpusloom.functions.arrays import fan_out
from pyspark.sql import types as S

from corpusloom.functions import arrays as A
from corpusloom.functions import prompt_columns as P
from corpusloom.functions import text as T
from corpusloom.ids import running_total

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
Hook = Callable[[Column, Column, Column], tuple[Column, Column, Column]]


def render(df: DataFrame, template: str, choices: str | None = None, key: str | None = None, seed: int = 0) -> DataFrame:
    """Add ``context``, ``target`` and ``options`` for one template."""
    row_key = F.col(key) if key else None
    parts = P.render(template, df.schema, choices, seed, row_key)
    options = P.answer_choices(choices, df.schema, seed, row_key)
    out = df.withColumn("_p", parts).withColumn("options", options)
    return (
        out.withColumn("n_parts", F.size("_p"))
        .withColumn("context", F.get("_p", F.lit(0)))
        .withColumn("target", F.get("_p", F.lit(1)))
        .drop("_p")
    )


def render_all(
    df: DataFrame,
    templates: list[dict],
    key: str,
    keep: list[str] | None = None,
    seed: int = 0,
    hooks: dict[str, Hook] | None = None,
    rejects: bool = False,
) -> DataFrame:
    """Every record with every template in one pass over the records.

    The templates become an array of structs that is exploded, so the input is scanned once no
    matter how many templates there are. ``templates`` holds dicts with name, jinja and
    answer_choices; ``hooks`` may rewrite (context, target, options) of a prompt. A record whose text
    has not exactly two parts gives no prompt; ``rejects`` returns those instead, with their n_parts.
    """
    rendered = []
    for t in templates:
        parts = P.render(t["jinja"], df.schema, t.get("answer_choices"), seed, F.col(key))
        options = P.answer_choices(t.get("answer_choices"), df.schema, seed, F.col(key))
        context, target = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        hook = (hooks or {}).get(t["name"])
        if hook:
            context, target, options = hook(context, target, options)
        rendered.append(
            F.struct(
                F.lit(t["name"]).alias("prompt"),
                F.size(parts).alias("n_parts"),
                context.alias("context"),
                target.alias("target"),
                options.alias("options"),
            )
        )
    out = fan_out(df, [key, *(keep or [])], F.array(*rendered), "_r")
    valid = F.col("_r.n_parts") == 2
    if rejects:
        return out.filter(~valid).select(key, *(keep or []), "_r.prompt", "_r.n_parts")
    return out.filter(valid).select(key, *(keep or []), "_r.prompt", "_r.context", "_r.target", "_r.options")


def allowed_prompts(prompts: DataFrame, allow: DataFrame | None, ban: DataFrame | None) -> DataFrame:
    """(dataset, prompt) pairs on the allow list of their dataset, when it has one, and not banned."""
    out = prompts
    if allow is not None:
        listed = allow.select("dataset").distinct()
        free = out.join(listed, "dataset", "left_anti")
        out = out.join(allow, ["dataset", "prompt"], "left_semi").unionByName(free)
    if ban is not None:
        out = out.join(ban, ["dataset", "prompt"], "left_anti")
    return out


def template_stats(templates: DataFrame) -> DataFrame:
    return templates.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def validate_templates(templates: DataFrame, fields: dict[str, set[str]] | None = None) -> DataFrame:
    """One row per finding: (dataset, subset, name, problem)."""
    key = ["dataset", "subset", "name"]

    def repeated(cols: list[str], problem: str) -> DataFrame:
        again = templates.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        return templates.join(again.drop("_n"), cols).select(*key, F.lit(problem).alias("problem"))

    def where(cond: Column, problem: str) -> DataFrame:
        return templates.filter(cond).select(*key, F.lit(problem).alias("problem"))

    out = (
        repeated(["id"], "duplicate id")
        .unionByName(repeated(["dataset", "subset", "name"], "duplicate name"))
        .unionByName(repeated(["dataset", "subset", "jinja"], "duplicate body"))
        .unionByName(where(~F.contains("jinja", F.lit(P.SEPARATOR)), "no separator"))
        .unionByName(where(~F.lower("id").rlike(UUID), "malformed id"))
    )
    if fields:
        @F.pandas_udf("array<string>")
        def names_read(jinja: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else sorted(P.variables(t)) for t in jinja], dtype=object)

        known = F.create_map(*[x for d, f in fields.items() for x in (F.lit(d), F.array(*[F.lit(n) for n in sorted(f)]))])
        unknown = F.array_except(names_read("jinja"), F.try_element_at(known, F.col("dataset")))
        listed = templates.filter(F.col("dataset").isin(sorted(fields)))
        out = out.unionByName(listed.filter(F.size(unknown) > 0).select(*key, F.lit("unknown field").alias("problem")))
    return out


LITERAL_LIST = re.compile(r"L\((.*)\)", re.S)
STANDARD = ["context", "question", "options", "label", "answer"]


def to_standard(df: DataFrame, rules: list[tuple[str, str]]) -> Column:
    """The standard record of a row by rules (expression, field).

    ``L(a;b)`` is a literal list. Labels also come from answers found among the options, and answers
    from labels that point at an option; both are made distinct.
    """
    lists: dict[str, list[Column]] = {k: [] for k in STANDARD}
    for expression, field in rules:
        literal = LITERAL_LIST.match(expression)
        if literal:
            lists[field] += [F.lit(x) for x in literal.group(1).split(";")]
        else:
            lists[field].append(P.render_text(expression, df.schema))
    arr = {k: F.array(*v) if v else F.array().cast("array<string>") for k, v in lists.items()}
    options = arr["options"]
    labels = F.transform(arr["label"], lambda x: x.cast("int"))
    pointed = F.filter(F.transform(labels, lambda i: F.get(options, i)), lambda x: x.isNotNull())
    answers = F.concat(arr["answer"], pointed)
    found = F.transform(
        F.filter(answers, lambda a: F.array_contains(options, a)),
        lambda a: (F.array_position(options, a) - 1).cast("int"),
    )
    return F.struct(
        arr["context"].alias("context"),
        arr["question"].alias("question"),
        options.alias("options"),
        F.array_sort(F.array_distinct(F.concat(labels, found))).alias("label"),
        F.array_sort(F.array_distinct(answers)).alias("answer"),
    )


STANDARD_TYPE = S.StructType(
    [
        S.StructField("context", S.ArrayType(S.StringType())),
        S.StructField("question", S.ArrayType(S.StringType())),
        S.StructField("options", S.ArrayType(S.StringType())),
        S.StructField("label", S.ArrayType(S.IntegerType())),
        S.StructField("answer", S.ArrayType(S.StringType())),
    ]
)


def from_standard(
    std: str, rules: list[tuple[str, str | list[str]]], key: Column, seed: int = 0, casts: dict[str, str] | None = None
) -> Column:
    """A record of another dataset from a standard record; ``a.b`` nests, lists stay lists."""
    names = {
        f.name: P.Value(F.col(std).getField(f.name), f.dataType) for f in STANDARD_TYPE.fields
    }
    casts = casts or {}

    def one(field: str, rule: str) -> Column:
        col = P.render_text(rule, S.StructType([]), seed, F.concat_ws(":", key, F.lit(field)), names)
        return col.try_cast(casts[field]) if field in casts else col

    flat: list[Column] = []
    nested: dict[str, list[Column]] = {}
    for field, rule in rules:
        col = F.array(*[one(field, r) for r in rule]) if isinstance(rule, list) else one(field, rule)
        outer, _, inner = field.partition(".")
        if inner:
            nested.setdefault(outer, []).append(col.alias(inner))
        else:
            flat.append(col.alias(field))
    return F.struct(*flat, *[F.struct(*cols).alias(name) for name, cols in nested.items()])


def convertible(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(target, source) pairs where the source's field counts satisfy the target's needs.

    ``targets``: (target, need_context, need_question, need_options); ``sources``: (source, context,
    question, options). Both have one row per dataset, so the theta join is small on both sides.
    """
    enough = (
        (F.col("target") != F.col("source"))
        & (F.col("context") >= F.col("need_context"))
        & (F.col("question") >= F.col("need_question"))
        & (F.col("options") >= F.col("need_options"))
    )
    return targets.join(sources, enough).select("target", "source")


def _one_line(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "\n+", "\n"), F.lit("\n"), F.lit(" "))


def few_shot_prompt(
    definition: Column, examples: Column, source: Column, target: Column, most: int | None = 3
) -> tuple[Column, Column]:
    """Definition, the first ``most`` worked examples (structs with input and output; None: all), then the instance."""
    shown = examples if most is None else F.slice(examples, F.lit(1), F.lit(most))
    lines = F.transform(
        shown,
        lambda e, i: F.concat(
            F.lit("Positive Example "),
            (i + 1).cast("string"),
            F.lit("- input: "),
            _one_line(e["input"]),
            F.lit(" output: "),
            _one_line(e["output"]),
            F.lit("\n"),
        ),
    )
    context = F.concat(
        F.lit("Definition: "),
        _one_line(definition),
        F.lit("\n"),
        F.array_join(lines, ""),
        F.lit("Now complete the following example- input: "),
        _one_line(source),
        F.lit(" output:"),
    )
    return context, F.concat(F.lit(" "), _one_line(target), F.lit("\n"))


def hypothesis_pairs(texts: DataFrame, labels: list[str], template: str, text: str = "text") -> DataFrame:
    """Every text with every candidate label; the labels travel as a literal array, not a join."""
    arr = F.array(*[F.lit(x) for x in labels])
    out = texts.select("*", F.posexplode(arr).alias("label_id", "label"))
    before, _, after = template.partition("{}")
    return out.withColumn("hypothesis", F.concat(F.lit(before), F.col("label"), F.lit(after)))


def context_prompt(
    question: Column, title: Column, text: Column, prefix: str = "", title_sep: str = " / ", doc_sep: str = " // "
) -> Column:
    joined = F.concat(F.lit(prefix), T.strip_quotes(title), F.lit(title_sep), text, F.lit(doc_sep), question)
    return F.replace(joined, F.lit("  "), F.lit(" "))


def support_document(hits: DataFrame, text: str = "text") -> DataFrame:
    """``<P> p1 <P> p2 ...`` in rank order (at most k rows per query)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda s: s[text])
    return hits.groupBy("query_id").agg(F.concat(F.lit("<P> "), F.array_join(ordered, " <P> ")).alias("support"))


def conversation_context(
    turns: DataFrame, max_len: int, end_token: str, conv: str = "conv_id", turn: str = "turn", tokens: str = "tokens"
) -> DataFrame:
    """Turns in order, each closed by ``end_token``, cut to the last ``max_len`` tokens.

    A running total from the last turn backwards drops turns that cannot reach the output before
    anything is collected, so a conversation of any length brings at most ``max_len`` tokens (plus
    one turn) to its group.
    """
    closed = turns.select(conv, turn, F.concat(F.col(tokens), F.array(F.lit(end_token))).alias("_t"))
    placed = running_total(
        closed, "_after", [turn], keys=[conv], weight=F.size("_t"), descending=True, slab=4096
    ).filter(F.col("_after") < max_len)
    merged = placed.groupBy(conv).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(turn, "_t"))), lambda s: s["_t"])).alias("_a")
    )
    return merged.select(conv, A.last_n("_a", max_len).alias("tokens"))
