"""Documents to paragraph units, passages, windows and chunks.

All of these are narrow: one document row fans out to its pieces in the same task, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fan_out
from corpusloom.functions import text as T

TokenCount = Callable[[Column], Column]


def drop_short_docs(docs: DataFrame, text: str = "text", min_chars: int = 20) -> DataFrame:
    return docs.filter(F.length(text) >= min_chars)


def segment_paragraphs(
    docs: DataFrame,
    max_length: int,
    id_col: str = "doc_id",
    text: str = "text",
    token_count: TokenCount = T.n_tokens,
) -> DataFrame:
    """Greedy fold of a document's lines into units below a token budget.

    A line joins the open unit while ``count + line < max_length``. A line that does not fit closes
    the unit, except when the unit is empty or its last line ends in a colon or question mark; then
    the line is glued on and the unit may pass the budget. Blank lines are skipped.

    The fold keeps only the index of each unit's first line, so its state stays small for documents
    of any length; the unit texts are cut out of the line array afterwards.
    """
    counted = docs.withColumn(
        "_lines",
        F.filter(F.transform(F.split(F.col(text), "\n", -1), T.strip), lambda x: x != ""),
    ).withColumn(
        "_marks",
        F.transform(
            F.col("_lines"),
            lambda x: F.struct(
                token_count(x).cast("long").alias("n"),
                F.substring(x, -1, 1).isin(T.GLUE_ENDINGS).alias("glue"),
            ),
        ),
    )
    state = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).cast("long").alias("count"),
        F.lit(True).alias("glue"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, mark: Column) -> Column:
        joins = (acc["i"] > 0) & ((acc["count"] + mark["n"] < max_length) | acc["glue"])
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(joins, acc["count"] + mark["n"]).otherwise(mark["n"]).alias("count"),
            mark["glue"].alias("glue"),
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"] + 1))).alias("starts"),
        )

    folded = counted.withColumn("_starts", F.aggregate("_marks", state, step)["starts"])
    units = F.transform(
        F.col("_starts"),
        lambda s, i: F.array_join(
            F.slice(
                F.col("_lines"),
                s,
                F.coalesce(F.get(F.col("_starts"), i + 1), F.size("_lines") + 1) - s,
            ),
            "\n",
        ),
    )
    keep = [c for c in docs.columns if c != text]
    return fan_out(folded, keep, units, "text", "ord")


def segment_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every line is its own unit, stripped; empty lines are kept."""
    keep = [c for c in docs.columns if c != text]
    lines = F.transform(F.split(F.col(text), "\n", -1), T.strip)
    return fan_out(docs, keep, lines, "text", "ord")


def passages(docs: DataFrame, words: int = 100, text: str = "text", delimiter: str = " ") -> DataFrame:
    """Every ``words`` words become one passage; other columns (title, id) are repeated."""
    keep = [c for c in docs.columns if c != text]
    parts = docs.withColumn("_w", F.split(F.col(text), delimiter, -1))
    cut = F.transform(
        F.sequence(F.lit(1), F.size("_w"), F.lit(words)),
        lambda i: T.strip(F.array_join(F.slice("_w", i, words), delimiter)),
    )
    return fan_out(parts, keep, cut, "text", "ord")


def chunk_long(seqs: DataFrame, length: int, tokens: str = "tokens") -> DataFrame:
    """Sequences longer than ``length`` are cut into pieces that own both boundary tokens.

    The first and the last token of a sequence are its boundary tokens. Pieces are cut every
    ``length - 2`` tokens; a piece that lacks the leading or closing boundary gets it back, so the
    first and last pieces differ in length from the others.
    """
    arr = F.col(tokens)
    size = F.size(arr)
    lead, tail = F.element_at(arr, 1), F.element_at(arr, -1)
    starts = F.sequence(F.lit(1), size, F.lit(length - 2))

    def piece(s: Column) -> Column:
        body = F.slice(arr, s, length - 2)
        left = F.when(F.element_at(body, 1) == lead, body).otherwise(F.concat(F.array(lead), body))
        return F.when(F.element_at(left, -1) == tail, left).otherwise(F.concat(left, F.array(tail)))

    pieces = F.when(size > length, F.transform(starts, piece)).otherwise(F.array(arr))
    keep = [c for c in seqs.columns if c != tokens]
    return fan_out(seqs, keep, pieces, tokens, "ord")


def windows(
    seqs: DataFrame,
    max_length: int,
    overlap: int,
    question: str = "question",
    tokens: str = "tokens",
    start: str = "start",
    end: str = "end",
    compat: bool = False,
) -> DataFrame:
    """Overlapping windows, each led by the question; the answer span is re-based per window.

    ``start`` and ``end`` are inclusive positions in ``tokens``. A window holds
    ``max_length - |question|`` context tokens and the next one starts ``max_length - overlap``
    later, until one reaches the end. A span not fully inside a window gets -100 for both ends.
    By default every window tests the original span. With ``compat`` a window tests the span as the
    window before left it, so that nothing is labelled after the first miss.
    """
    q, size = F.size(question), F.size(tokens)
    width = F.lit(max_length) - q
    step = max_length - overlap
    begin = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(step))
    begin = F.filter(begin, lambda b: (b == 0) | (b - step + width < size))
    miss = F.lit(-100)

    def place(s: Column, e: Column, b: Column) -> Column:
        # positions in question + context coordinates
        hit = (s >= b + q) & (e <= b + F.lit(max_length) - 1)
        return F.struct(
            b.alias("b"),
            F.when(hit, s - b).otherwise(miss).alias("s"),
            F.when(hit, e - b).otherwise(miss).alias("e"),
        )

    s0, e0 = (F.col(start) + q).cast("int"), (F.col(end) + q).cast("int")
    if compat:
        empty = F.array().cast("array<struct<b:int,s:int,e:int>>")
        spans = F.aggregate(
            begin,
            F.struct(s0.alias("s"), e0.alias("e"), empty.alias("out")),
            lambda acc, b: F.struct(
                place(acc["s"], acc["e"], b)["s"].alias("s"),
                place(acc["s"], acc["e"], b)["e"].alias("e"),
                F.concat(acc["out"], F.array(place(acc["s"], acc["e"], b))).alias("out"),
            ),
        )["out"]
    else:
        spans = F.transform(begin, lambda b: place(s0, e0, b))
    keep = [c for c in seqs.columns if c not in (tokens, question, start, end)]
    return fan_out(seqs, [*keep, question, tokens], spans, "_w", "ord").select(
        *keep,
        "ord",
        F.concat(
            F.col(question), F.slice(F.col(tokens), F.col("_w.b") + 1, F.lit(max_length) - F.size(question))
        ).alias("input_ids"),
        F.col("_w.s").alias("start"),
        F.col("_w.e").alias("end"),
    )


def chunk_stride(seqs: DataFrame, chunk: int, left: int, right: int, tokens: str = "tokens") -> DataFrame:
    """Strided chunks with (length, left, right) overlap sizes and a flag on the last one."""
    step = chunk - left - right
    size = F.size(tokens)
    keep = [c for c in seqs.columns if c != tokens]
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = fan_out(seqs, [*keep, tokens], starts, "_s", "ord")
    body = F.slice(F.col(tokens), F.col("_s") + 1, F.lit(chunk))
    last = F.col("_s") + step + left >= F.size(tokens)
    own_left = F.when(F.col("_s") == 0, 0).otherwise(left)
    out = out.select(
        *keep,
        "ord",
        body.alias("chunk"),
        F.size(body).alias("n"),
        own_left.alias("left"),
        F.when(last, 0).otherwise(right).alias("right"),
        last.cast("int").alias("is_last"),
    )
    return out.filter(F.col("n") > F.col("left"))


def rescale_stride(df: DataFrame, ratio: float) -> DataFrame:
    """Stride sizes from input units to output units."""
    n = F.bround(F.col("n") * ratio)
    return df.select(
        *[c for c in df.columns if c not in ("n", "left", "right")],
        n.cast("int").alias("n"),
        F.bround(F.col("left") / F.col("n") * n).cast("int").alias("left"),
        F.bround(F.col("right") / F.col("n") * n).cast("int").alias("right"),
    )


def split_long_sentences(sents: DataFrame, limit: int, pieces: str = "pieces") -> DataFrame:
    """Start a new sentence before the word whose pieces would pass ``limit``.

    ``pieces`` holds the number of sub-word pieces of each word; words of zero pieces are dropped.
    Output is one row per kept word: (sentence columns, word position, part number).
    """
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        fresh = (acc["sum"] + n > limit) & (n > 0)
        return F.struct(
            F.when(fresh, n).otherwise(acc["sum"] + n).alias("sum"),
            (acc["i"] + 1).alias("i"),
            F.when(fresh, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    keep = [c for c in sents.columns if c != pieces]
    counts = sents.withColumn("_n", F.transform(pieces, lambda n: n.cast("int")))
    folded = counts.withColumn("_starts", F.aggregate("_n", state, step)["starts"])
    begins = F.concat(F.array(F.lit(0)), F.col("_starts"))
    ends = F.concat(F.col("_starts"), F.array(F.size("_n")))
    sized = F.zip_with(begins, ends, lambda b, e: e - b)
    parts = F.flatten(F.transform(sized, lambda n, k: F.array_repeat(k, n)))
    pairs = folded.select(*keep, F.arrays_zip(F.col("_n").alias("n"), parts.alias("part")).alias("_z"))
    words = fan_out(pairs, keep, "_z", "_k", "word").filter(F.col("_k.n") > 0)
    return words.select(*keep, "word", F.col("_k.part").alias("part"))


def bin_demos(df: DataFrame, length: int, demos: str = "demos") -> DataFrame:
    """Greedy bins of demonstrations, each at most ``length - 1`` tokens; the last of several is dropped."""
    state = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("sum"), F.lit(0).alias("i"))

    def step(acc: Column, demo: Column) -> Column:
        n = F.size(demo)
        joins = (acc["i"] > 0) & (acc["sum"] + n + 1 <= length)
        return F.struct(
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"] + 1))).alias("starts"),
            F.when(joins, acc["sum"] + n).otherwise(n).alias("sum"),
            (acc["i"] + 1).alias("i"),
        )

    folded = df.withColumn("_starts", F.aggregate(demos, state, step)["starts"])
    arr = F.col(demos)
    bins = F.transform(
        F.col("_starts"),
        lambda s, i: F.flatten(
            F.slice(arr, s, F.coalesce(F.get(F.col("_starts"), i + 1), F.size(arr) + 1) - s)
        ),
    )
    bins = F.when(F.size(bins) > 1, F.slice(bins, F.lit(1), F.size(bins) - 1)).otherwise(bins)
    keep = [c for c in df.columns if c != demos]
    return fan_out(folded, keep, bins, "tokens", "bin")


def drop_flagged_tokens(df: DataFrame, tokens: str = "tokens", flags: str = "is_html", start: str = "start") -> DataFrame:
    """Delete flagged tokens; ``start`` (0-based) moves left by the deletions before it."""
    before = F.size(F.filter(F.slice(F.col(flags), F.lit(1), F.col(start)), lambda x: x))
    kept = F.transform(
        F.filter(F.arrays_zip(F.col(tokens).alias("t"), F.col(flags).alias("f")), lambda z: ~z["f"]), lambda z: z["t"]
    )
    return df.withColumn(start, F.col(start) - before).withColumn(tokens, kept).drop(flags)


def pick_single_answer(df: DataFrame) -> DataFrame:
    """Yes/no before short before long answers; unusable rows are flagged.

    Columns: yes_no (array of -1, 0, 1), short (array of start/end structs), long (one struct). A row
    is unusable when its answer has no start (yes/no), several starts, or equal start and end.
    """
    yes, no = F.array_contains("yes_no", 1), F.array_contains("yes_no", 0)
    has_short = F.size("short") > 0
    category = F.when(yes, "yes").when(no, "no").when(has_short, "short").otherwise("long")
    picked = F.when(yes | no, F.slice("short", 1, 0)).when(has_short, F.col("short")).otherwise(F.array("long"))
    out = df.withColumn("category", category).withColumn("answer", picked)
    same = F.transform("answer", lambda a: a["start"]) == F.transform("answer", lambda a: a["end"])
    return out.withColumn("remove", (F.size("answer") > 1) | same)
