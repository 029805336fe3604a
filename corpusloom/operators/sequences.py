"""Token sequences: tokenizing, vocabulary ids, packing, demonstrations and training rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import fan_out
from corpusloom.functions import arrays as A
from corpusloom.functions import text as T
from corpusloom.ids import running_total, seeded_key, top_per_group
from corpusloom.operators.folds import greedy_groups
from corpusloom.operators.skew import skew_join

# One sequence in so many tells which tokens are frequent.
SHARE = 64


def tokenize(
    df: DataFrame, text: str = "text", max_len: int | None = None, tokenizer: Callable[[Column], Column] = T.regex_tokens
) -> DataFrame:
    """Add ``tokens`` (cut to ``max_len``) and ``n_tokens``."""
    toks = tokenizer(F.col(text))
    toks = A.first_n(toks, max_len) if max_len else toks
    return df.withColumn("tokens", toks).withColumn("n_tokens", F.size("tokens"))


def encode(df: DataFrame, vocab: DataFrame, seq_id: str, unknown: int, tokens: str = "tokens", hot_rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``ids``: token to id by a vocabulary frame (token, id) of any size; missing tokens get ``unknown``.

    Each sequence asks for its distinct tokens once; these meet the vocabulary by hash, frequent tokens
    salted, and come back as the sequence's own dictionary, in which its tokens are looked up in place. The
    vocabulary is never in one task or on the driver. An empty or null sequence has no ids; of a token
    named twice the smallest id counts. ``seq_id`` is unique.
    """
    none = F.array().cast("array<string>")

    def distinct_tokens(rows: DataFrame) -> DataFrame:
        return fan_out(rows, [F.col(seq_id).alias("_s")], F.array_distinct(F.coalesce(F.col(tokens), none)), "token")

    asked = distinct_tokens(df)
    # which tokens are frequent is seen in some of the sequences, as tokens may be costly to compute
    some = distinct_tokens(df.filter(F.pmod(F.xxhash64(seq_id), F.lit(SHARE)) == 0))
    known = vocab.groupBy(F.col("token").cast("string").alias("token")).agg(F.min(F.col("id").cast("int")).alias("id"))
    found = skew_join(asked, known, ["token"], "_s", hot_rows=hot_rows, seen=some, share=SHARE)
    own = found.groupBy("_s").agg(F.collect_list(F.struct("token", "id")).alias("_d"))

    @F.arrow_udf("array<int>")
    def look_up(col: pa.Array, words: pa.Array, ids: pa.Array) -> pa.Array:
        out, ends = [], [0]
        for i in range(len(col)):
            row = col[i].values if col[i].is_valid else None
            n = 0 if row is None else len(row)
            if n and words[i].is_valid:
                at = pc.index_in(row, value_set=words[i].values)
                out.append(pc.fill_null(pc.take(ids[i].values, at), unknown).to_numpy(zero_copy_only=False))
            else:
                out.append(np.full(n, unknown, np.int32))
            ends.append(ends[-1] + n)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out or [np.empty(0)]).astype(np.int32)))

    joined = df.join(own, F.col(seq_id) == F.col("_s"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], look_up(F.col(tokens), F.col("_d.token"), F.col("_d.id")).alias("ids"))


def pack(
    seqs: DataFrame, length: int, order: str, tokens: str = "tokens", end_token: Column | None = None, spread: str = "dense"
) -> DataFrame:
    """Concatenate sequences in ``order`` and cut into blocks of exactly ``length``; the tail is dropped.

    Each sequence learns its global offset from a two-level prefix sum, splits itself at the block
    borders in place, and only the pieces of one block (at most ``length`` tokens) meet in a group.
    """
    body = F.col(tokens) if end_token is None else F.concat(F.col(tokens), F.array(end_token))
    sized = seqs.select(F.col(order).alias("_o"), body.alias("_t"))
    placed = running_total(sized, "_at", ["_o"], weight=F.size("_t"), spread=spread).filter(F.size("_t") > 0)
    first, last = F.floor(F.col("_at") / length), F.floor((F.col("_at") + F.size("_t") - 1) / length)
    pieces = placed.select("_t", "_at", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * length - F.col("_at"), F.lit(0))
    stop = F.least(F.col("block") * length + length - F.col("_at"), F.size("_t").cast("long"))
    pieces = pieces.select(
        "block",
        F.col("_at").alias("_k"),
        F.slice("_t", (begin + 1).cast("int"), (stop - begin).cast("int")).alias("_p"),
    )
    blocks = pieces.groupBy("block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_p"))), lambda s: s["_p"])).alias("tokens")
    )
    return blocks.filter(F.size("tokens") == length)


def assemble_demos(
    pieces: DataFrame,
    max_length: int,
    per_piece: int,
    shot: int,
    delimiter: Column,
    seed: int | None = None,
    tokens: str = "tokens",
) -> DataFrame:
    """(query_id, demos, test): neighbours cut to ``per_piece - 1`` tokens plus a delimiter.

    ``pieces`` has (query_id, rank, tokens); rank 0 is the query itself. Neighbours are dropped from
    the end while the whole is at least ``max_length``; then the first ``shot`` are kept, in a
    reproducible random order when a seed is given. What is kept is a prefix of at most ``shot``
    neighbours, so only the first ``shot + 1`` rows of a query are ever grouped.
    """
    first = top_per_group(pieces, ["query_id"], [F.col("rank")], shot + 1)
    cut = first.withColumn("_t", F.concat(A.first_n(tokens, per_piece - 1), F.array(delimiter)))
    lists = cut.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_t"))).alias("_l"))
    query = F.filter("_l", lambda s: s["rank"] == 0)
    demos = F.filter("_l", lambda s: s["rank"] > 0)
    lists = lists.select("query_id", F.get(query, F.lit(0))["_t"].alias("test"), demos.alias("_d")).filter("test is not null")
    kept = F.aggregate(
        "_d",
        F.struct(F.size("test").alias("sum"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            (acc["sum"] + F.size(s["_t"])).alias("sum"),
            F.when(acc["sum"] + F.size(s["_t"]) < max_length, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
        ),
    )["n"]
    chosen = F.slice("_d", F.lit(1), F.least(kept, F.lit(shot)))
    if seed is not None:
        keyed = F.transform(
            chosen, lambda s: F.struct(seeded_key(seed, F.col("query_id"), s["rank"]).alias("h"), s["_t"].alias("_t"))
        )
        chosen = F.array_sort(keyed)
    return lists.select("query_id", F.transform(chosen, lambda s: s["_t"]).alias("demos"), "test")


def training_rows(df: DataFrame, length: int, pad_id: int, mode: str = "all_target", demos: str = "demos", test: str = "test") -> DataFrame:
    """Add input_ids, labels, loss_mask, position_ids and segment (the piece number, for attention).

    * ``all_target``: every next token is a label;
    * ``test_target``: only the test piece is (with its first token when there are demonstrations);
    * ``zero_shot``: every piece stands alone: positions restart and no label crosses a border.
    """
    whole = F.concat(F.flatten(demos), F.col(test))
    n = F.size(whole) - 1
    has_demos = (F.size(demos) > 0).cast("int")
    ignore = F.lit(A.IGNORE_LABEL)
    pieces = F.concat(F.col(demos), F.array(F.col(test)))
    ones = lambda c: F.array_repeat(F.lit(1), F.greatest(c, F.lit(0)).cast("int"))
    if mode == "all_target":
        labels, mask = F.slice(whole, F.lit(2), n), ones(n)
        positions = F.sequence(F.lit(0), n - 1)
        segment = F.array_repeat(F.lit(1), n)
    elif mode == "test_target":
        lead = n - (F.size(test) - 1 + has_demos)
        tail = F.slice(F.col(test), F.lit(2) - has_demos, F.size(test) - 1 + has_demos)
        labels = F.concat(F.array_repeat(ignore, lead), tail)
        mask = F.concat(F.array_repeat(F.lit(0), lead), ones(F.size(tail)))
        positions = F.sequence(F.lit(0), n - 1)
        segment = F.array_repeat(F.lit(1), n)
    elif mode == "zero_shot":
        labels = F.flatten(
            F.transform(pieces, lambda p: F.concat(F.slice(p, F.lit(2), F.size(p) - 1), F.array(ignore)))
        )
        mask = F.transform(labels, lambda x: (x != ignore).cast("int"))
        positions = F.flatten(
            F.transform(
                pieces,
                lambda p: F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, i).otherwise(F.lit(0)).cast("int")),
            )
        )
        segment = F.flatten(
            F.transform(
                pieces,
                lambda p, k: F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, k + 1).otherwise(F.lit(0)).cast("int")),
            )
        )
        labels, mask = F.slice(labels, F.lit(1), n), F.slice(mask, F.lit(1), n)
        positions, segment = F.slice(positions, F.lit(1), n), F.slice(segment, F.lit(1), n)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.select(
        "*",
        A.pad(F.slice(whole, F.lit(1), n), length, pad_id).alias("input_ids"),
        A.pad(labels, length, A.IGNORE_LABEL).alias("labels"),
        A.pad(mask, length, 0).alias("loss_mask"),
        A.pad(positions, length, 0).alias("position_ids"),
        A.pad(segment, length, 0).alias("segment"),
    )


def option_rows(df: DataFrame, sample_id: str, prefix: str = "prefix", options: str = "options") -> DataFrame:
    """One row per answer option: the last prefix token leads the option and leaves the prefix."""
    out = fan_out(df, [sample_id, prefix], options, "_o", "option")
    size = F.size(prefix) - 1
    return out.select(
        sample_id,
        "option",
        F.slice(F.col(prefix), F.lit(1), size).alias("prefix_ids"),
        F.concat(F.array(F.element_at(prefix, -1)), F.slice("_o", F.lit(1), F.size("_o") - 1)).alias("option_ids"),
        F.col("_o").alias("labels"),
        F.sequence(size, size + F.size("_o") - 1).alias("position_ids"),
    )


def trim_pad(df: DataFrame, batch: str, pad_id: int, tokens: str = "tokens") -> DataFrame:
    """Cut every row of a batch to the longest non-pad length in it (padding on the right).

    Only (batch, length) is aggregated; the rows themselves move once, in the join.
    """
    used = F.size(F.col(tokens)) - F.coalesce(
        F.array_position(F.transform(F.reverse(F.col(tokens)), lambda x: (x != pad_id).cast("int")), 1) - 1, F.lit(0)
    ).cast("int")
    used = F.when(F.forall(tokens, lambda x: x == pad_id), F.lit(0)).otherwise(used)
    longest = df.groupBy(batch).agg(F.max(used).alias("_n"))
    return df.join(longest, batch).withColumn(tokens, A.first_n(tokens, F.col("_n"))).drop("_n")


def pack_pairs(pairs: DataFrame, limit: int, order: str = "id", unit: int = 10_000, joiner: str = " ") -> DataFrame:
    """Join consecutive pairs until either side would exceed ``limit`` tokens.

    The packs are those of one pass over all pairs in order of the unique ``order``; ``unit`` bounds the
    pairs that one task holds (see :mod:`corpusloom.operators.folds`). Only numbers go through the fold; the
    texts move once, to their pack. Columns: id, src, tgt, src_tokens, tgt_tokens.
    """
    a, b = F.col("src_tokens").cast("long"), F.col("tgt_tokens").cast("long")
    placed = running_total(pairs.select(order, "src_tokens", "tgt_tokens"), "_at", [order])
    packs = greedy_groups(placed, (a, b), (limit - a, limit - b), F.floor(F.col("_at") / unit), [F.col("_at")], F.col(order))
    rows = pairs.join(packs.select(F.col("place").alias(order), "start"), order)
    one = F.struct(F.col(order).alias("o"), "src", "tgt")
    lists = rows.groupBy("start").agg(F.array_sort(F.collect_list(one)).alias("_l"), F.sum("src_tokens").alias("a"), F.sum("tgt_tokens").alias("b"))
    side = lambda name: F.array_join(F.transform("_l", lambda r: r[name]), joiner)
    return lists.select(
        F.col("start").alias("id"), side("src").alias("src"), side("tgt").alias("tgt"), F.col("a").alias("src_tokens"), F.col("b").alias("tgt_tokens")
    )


def save_lengths(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.withColumn("length", F.greatest(F.size(source), F.size(target)))
