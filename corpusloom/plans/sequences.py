"""Queries: token sequences (documents, conversations, orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as T
from corpusloom.ids import dense_ids, running_total, seeded_key
from corpusloom.operators import segment as S
from corpusloom.operators import sequences as Q
from corpusloom.plans.registry import hashed, query, strip, table, toks, wide
from corpusloom.session import materialize


def token_docs(spark: SparkSession, sf: str) -> DataFrame:
    return Q.tokenize(wide(spark, sf, "documents", "doc_id", "text")).select("doc_id", "tokens", "n_tokens")


def id_docs(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Documents as integer sequences: each token by its length (a stand-in vocabulary)."""
    rows = wide(spark, sf, "documents", "doc_id", "text", *extra)
    return rows.select("doc_id", *extra, F.transform(T.regex_tokens("text"), lambda t: F.length(t)).alias("tokens"))


IDS = f"list_transform({toks('text')}, lambda t: length(t))"


def joined(col: str):
    return F.array_join(F.col(col).cast("array<string>"), ",")


@query("i01_tokenize", f"select doc_id, md5(array_to_string({toks('text')}, chr(31))) as digest, len({toks('text')})::bigint as n_tokens from documents")
def tokenize(spark, sf):
    rows = Q.tokenize(wide(spark, sf, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.md5(F.array_join("tokens", "\x1f")).alias("digest"), F.col("n_tokens").cast("long").alias("n_tokens"))


VOCAB_SQL = f"""with t as (select doc_id, unnest({toks('text')}) as token from documents),
 v as (select token, (row_number() over (order by n desc, {hashed(0, 'token')}, token))::bigint as id from (select token, count(*) as n from t group by token having token not like 'z%'))"""


# ids by count, equal counts in hash order; words with z stand for unknown ones
@query(
    "i02_encode",
    VOCAB_SQL + f""", e as (select doc_id, count(*)::bigint as n, sum(coalesce(id, 0))::bigint as id_sum, count(id)::bigint as n_known from t left join v using (token) group by doc_id)
    select doc_id, coalesce(n, 0) as n, coalesce(id_sum, 0) as id_sum, coalesce(n_known, 0) as n_known from documents left join e using (doc_id)""",
)
def encode(spark, sf):
    docs = token_docs(spark, sf)
    counts = A.fan_out(docs, [], "tokens", "token").groupBy("token").agg((-F.count(F.lit(1))).alias("n")).filter(~F.col("token").like("z%"))
    # the ranking reads the counts several times: without a copy every reading would split all texts again
    counts = materialize(counts.withColumn("key", seeded_key(0, "token")))
    ranked = running_total(counts, "id", ["n", "key", "token"], spread="range").select("token", F.col("id") + 1).toDF("token", "id")
    out = Q.encode(docs, ranked, "doc_id", 0)
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    known = F.size(F.filter("ids", lambda x: x > 0)).cast("long")
    return out.select("doc_id", F.size("ids").cast("long").alias("n"), total.alias("id_sum"), known.alias("n_known"))


@query(
    "i03_pack",
    f"""with s as (select doc_id, list_append({IDS}, 0) as t from documents),
    o as (select doc_id, t, sum(len(t)) over (order by doc_id) - len(t) as off from s),
    x as (select off + generate_subscripts(t, 1) - 1 as pos, unnest(t) as v from o),
    b as (select pos // 1024 as block, count(*) as n, string_agg(v::varchar, ',' order by pos) as tokens from x group by 1)
    select block::bigint as block, md5(tokens) as digest from b where n = 1024""",
)
def pack(spark, sf):
    blocks = Q.pack(id_docs(spark, sf), 1024, "doc_id", end_token=F.lit(0))
    return blocks.select("block", F.md5(joined("tokens")).alias("digest"))


@query(
    "i04_chunk_long",
    f"""with s as (select doc_id, list_concat([-1], list_concat({IDS}, [-2])) as t from documents),
    g as (select doc_id, t, unnest(case when len(t) > 512 then generate_series(1, len(t), 510) else [1] end) as st from s),
    p as (select doc_id, (st - 1) // 510 as ord, case when len(t) > 512 then list_slice(t, st, st + 509) else t end as b from g),
    q as (select doc_id, ord, case when b[1] = -1 then b else list_concat([-1], b) end as b from p)
    select doc_id, ord::bigint as ord, md5(array_to_string(case when b[len(b)] = -2 then b else list_concat(b, [-2]) end, ',')) as digest from q""",
)
def chunk_long(spark, sf):
    rows = id_docs(spark, sf).select("doc_id", F.concat(F.array(F.lit(-1)), "tokens", F.array(F.lit(-2))).alias("tokens"))
    out = S.chunk_long(rows, 512)
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5(joined("tokens")).alias("digest"))


@query(
    "i05_passages",
    r"""with w as (select doc_id, string_split(text, ' ') as w from documents),
    g as (select doc_id, w, unnest(generate_series(1, len(w), 100)) as st from w)
    select doc_id, ((st - 1) // 100)::bigint as ord, md5(regexp_replace(array_to_string(list_slice(w, st, st + 99), ' '), '^\s+|\s+$', '', 'g')) as digest from g""",
)
def passages(spark, sf):
    out = S.passages(wide(spark, sf, "documents", "doc_id", "text"))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


def _window_input(spark, sf):
    rows = id_docs(spark, sf)
    start = F.pmod(F.col("doc_id") * 37, F.greatest(F.size("tokens").cast("long") - 3, F.lit(1))).cast("int")
    return rows.select("doc_id", F.array(F.lit(-7), F.lit(-8)).alias("question"), "tokens", start.alias("start"), (start + 2).alias("end"))


@query(
    "i06_windows",
    f"""with s as (select doc_id, {IDS} as t from documents),
    a as (select doc_id, t, (doc_id * 37) % greatest(len(t) - 3, 1) as st, len(t) as n from s),
    g as (select *, unnest(generate_series(0, n - 1, 192)) as b from a),
    k as (select * from g where b = 0 or b - 192 + 254 < n)
    select doc_id, (b // 192)::bigint as ord, md5('-7,-8,' || array_to_string(list_slice(t, b + 1, b + 254), ',')) as digest,
      (case when st >= b and st + 2 <= b + 253 then st + 2 - b else -100 end)::bigint as "start",
      (case when st >= b and st + 2 <= b + 253 then st + 4 - b else -100 end)::bigint as "end" from k""",
)
def windows(spark, sf):
    out = S.windows(_window_input(spark, sf), 256, 64)
    return out.select(
        "doc_id", F.col("ord").cast("long").alias("ord"), F.md5(joined("input_ids")).alias("digest"),
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
    )


@query(
    "i07_chunk_stride",
    f"""with s as (select doc_id, {IDS} as t, len({toks('text')}) as n from documents where len({toks('text')}) > 0),
    g as (select *, unnest(generate_series(0, n - 1, 64)) as s from s),
    c as (select doc_id, s // 64 as ord, len(list_slice(t, s + 1, s + 96)) as m, case when s = 0 then 0 else 16 end as l, (s + 64 + 16 >= n) as is_last from g)
    select doc_id, ord::bigint as ord, m::bigint as n, l::bigint as "left", (case when is_last then 0 else 16 end)::bigint as "right", is_last::int as is_last from c where m > l""",
)
def stride(spark, sf):
    out = S.chunk_stride(id_docs(spark, sf), 96, 16, 16)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("ord", "n", "left", "right")], "is_last")


@query(
    "i08_assemble_demos",
    f"""with s as (select conv_id as q, turn as rank, list_append(list_slice({IDS}, 1, 63), 0) as t from conversations),
    c as (select q, rank, t, sum(len(t)) over (partition by q order by rank) as tot from s where q in (select q from s where rank = 0)),
    k as (select * from c where rank = 0 or (tot < 256 and rank <= 4))
    select q as query_id, count(*)::bigint - 1 as n_demos, md5(string_agg(array_to_string(t, ','), '|' order by rank)) as digest from k group by q""",
)
def assemble(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.transform(T.regex_tokens("text"), lambda t: F.length(t)).alias("tokens")
    )
    out = Q.assemble_demos(rows, 256, 64, 4, F.lit(0))
    parts = F.concat(F.array("test"), "demos")
    text = F.array_join(F.transform(parts, lambda p: F.array_join(p.cast("array<string>"), ",")), "|")
    return out.select("query_id", F.size("demos").cast("long").alias("n_demos"), F.md5(text).alias("digest"))


def _demo_rows(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.transform(T.regex_tokens("text"), lambda t: F.length(t)).alias("tokens")
    )
    return Q.assemble_demos(rows, 256, 64, 4, F.lit(0), seed=5)


def _training(mode: str):
    def run(spark, sf):
        out = Q.training_rows(_demo_rows(spark, sf), 256, 0, mode)
        names = ["input_ids", "labels", "loss_mask", "position_ids", "segment"]
        return out.select("query_id", *[F.md5(joined(n)).alias(n) for n in names], F.size(F.filter("loss_mask", lambda x: x == 1)).cast("long").alias("n_loss"))

    return run


for _mode in ("all_target", "test_target", "zero_shot"):
    query(f"i09_training_rows_{_mode}")(_training(_mode))


@query(
    "i10_option_rows",
    f"""with s as (select doc_id, {IDS} as p from documents where len({toks('text')}) > 0),
    o as (select doc_id, p, [[1, 2, 3], [4, 5], [6]] as opts from s),
    e as (select doc_id, p, unnest([0, 1, 2]) as option, unnest(opts) as o from o)
    select doc_id, option::bigint as option, md5(array_to_string(list_slice(p, 1, len(p) - 1), ',')) as prefix_ids,
      array_to_string(list_concat([p[len(p)]], list_slice(o, 1, len(o) - 1)), ',') as option_ids, array_to_string(o, ',') as labels,
      array_to_string(generate_series(len(p) - 1, len(p) + len(o) - 2), ',') as position_ids from e""",
)
def options(spark, sf):
    rows = id_docs(spark, sf).filter(F.size("tokens") > 0).select(
        "doc_id", F.col("tokens").alias("prefix"),
        F.array(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(4), F.lit(5)), F.array(F.lit(6))).alias("options"),
    )
    out = Q.option_rows(rows, "doc_id")
    return out.select("doc_id", F.col("option").cast("long").alias("option"), F.md5(joined("prefix_ids")).alias("prefix_ids"),
                      joined("option_ids").alias("option_ids"), joined("labels").alias("labels"), joined("position_ids").alias("position_ids"))


@query(
    "i11_pad",
    f"""with s as (select doc_id, {IDS} as t from documents)
    select doc_id, md5(array_to_string(list_concat(t, list_transform(generate_series(1, 512 - len(t)), lambda x: 0)), ',')) as right_pad,
      md5(array_to_string(list_concat(list_transform(generate_series(1, 512 - len(t)), lambda x: 0), t), ',')) as left_pad from s""",
)
def pad(spark, sf):
    rows = id_docs(spark, sf).select("doc_id", F.col("tokens").alias("t"))
    return rows.select("doc_id", F.md5(F.array_join(A.pad("t", 512, 0).cast("array<string>"), ",")).alias("right_pad"),
                       F.md5(F.array_join(A.pad("t", 512, 0, "left").cast("array<string>"), ",")).alias("left_pad"))


@query(
    "i11_trim_pad",
    f"""with s as (select doc_id, doc_id // 16 as batch, len({toks('text')}) as n from documents)
    select doc_id, batch::bigint as batch, max(n) over (partition by batch)::bigint as width from s""",
)
def trim(spark, sf):
    # rows arrive padded to the longest of 64 documents and are trimmed in batches of 16
    docs = id_docs(spark, sf).withColumn("big", F.floor(F.col("doc_id") / 64))
    widest = docs.groupBy("big").agg(F.max(F.size("tokens")).alias("w"))
    padded = docs.join(widest, "big").select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), A.pad("tokens", F.col("w"), 0).alias("tokens"))
    out = Q.trim_pad(padded, "batch", 0)
    return out.select("doc_id", "batch", F.size("tokens").cast("long").alias("width"))


@query(
    "i12_bin_demos",
    f"""with recursive l as materialized (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: list_transform({toks('x')}, lambda t: length(t))), lambda x: len(x) > 0) as d from documents),
    z as materialized (select doc_id, list_transform(d, lambda x: len(x)) as n from l where len(d) > 0),
    f(doc_id, i, bin, s) as (select doc_id, 1, 0, n[1] from z
      union all select f.doc_id, i + 1, case when s + n[i + 1] + 1 <= 1024 then bin else bin + 1 end, case when s + n[i + 1] + 1 <= 1024 then s else 0 end + n[i + 1] from f join z using (doc_id) where i < len(n)),
    b as (select doc_id, bin, flatten(list(d[i] order by i)) as t from f join l using (doc_id) group by 1, 2), m as (select *, max(bin) over (partition by doc_id) as most from b)
    select doc_id, bin::bigint as bin, len(t)::bigint as n, md5(array_to_string(t, ',')) as digest from m where most = 0 or bin < most""",
)
def bins(spark, sf):
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.transform(T.regex_tokens(x), lambda t: F.length(t)))
    rows = wide(spark, sf, "documents", "doc_id", "text").select("doc_id", F.filter(lines, lambda x: F.size(x) > 0).alias("demos"))
    out = S.bin_demos(rows, 1024)
    return out.select("doc_id", F.col("bin").cast("long").alias("bin"), F.size("tokens").cast("long").alias("n"), F.md5(joined("tokens")).alias("digest"))


@query(
    "i13_pack_pairs",
    rf"""with recursive p as (select doc_id as id, {strip("replace(text, chr(10), ' ')")} as src, source as tgt from documents),
    n as materialized (select *, len({toks('src')}) as a, len({toks('tgt')}) as b, row_number() over (order by id) as r from p),
    f(r, start, a, b) as (select r, id, a, b from n where r = 1
      union all select n.r, case when f.a + n.a <= 1024 and f.b + n.b <= 1024 then f.start else n.id end,
        n.a + case when f.a + n.a <= 1024 and f.b + n.b <= 1024 then f.a else 0 end, n.b + case when f.a + n.a <= 1024 and f.b + n.b <= 1024 then f.b else 0 end
      from f join n on n.r = f.r + 1)
    select start as id, md5(string_agg(src, ' ' order by n.r)) as src, md5(string_agg(tgt, ' ' order by n.r)) as tgt, sum(n.a)::bigint as src_tokens, sum(n.b)::bigint as tgt_tokens
    from f join n using (r) group by start""",
)
def pairs(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text", "source")
    rows = rows.select(F.col("doc_id").alias("id"), T.flatten_whitespace("text").alias("src"), F.col("source").alias("tgt"))
    rows = rows.withColumn("src_tokens", T.n_tokens("src")).withColumn("tgt_tokens", T.n_tokens("tgt"))
    out = Q.pack_pairs(rows, 1024)
    return out.select("id", F.md5("src").alias("src"), F.md5("tgt").alias("tgt"), "src_tokens", "tgt_tokens")


@query(
    "i14_align_labels",
    f"""with w as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from documents),
    l as (select doc_id, list_concat([-100], list_concat(list_slice(flatten(list_transform(w, lambda x: case when len({toks('x')}) > 0 then list_concat([length(x)], list_transform(generate_series(2, len({toks('x')})), lambda y: -100)) else [] end)), 1, 62), [-100])) as a from w)
    select doc_id, md5(array_to_string(list_concat(a, list_transform(generate_series(1, 64 - len(a)), lambda x: -100)), ',')) as digest from l""",
)
def align(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text")
    words = F.filter(F.split("text", " ", -1), lambda x: x != "")
    rows = rows.select("doc_id", words.alias("w"))
    n = F.transform("w", lambda x: T.n_tokens(x))
    lab = F.transform("w", lambda x: F.length(x))
    return rows.select("doc_id", F.md5(F.array_join(A.align_labels(n, lab, 64).cast("array<string>"), ",")).alias("digest"))


@query(
    "i15_split_long_sentences",
    f"""with recursive w as (select doc_id, string_split(text, ' ') as w from documents), x as (select doc_id, generate_subscripts(w, 1) - 1 as i, unnest(w) as t from w),
    n as (select doc_id, i, len({toks('t')}) as n from x), u as materialized (select *, sum(n) over (partition by doc_id order by i) as total from n where n > 0),
    f(doc_id, part, st, base) as (select doc_id, 0, -1, 0::hugeint from documents
      union all select f.doc_id, any_value(part) + 1, min(i), arg_min(total - n, i)::hugeint from f join u on u.doc_id = f.doc_id and i > f.st and total > base + 128 group by f.doc_id)
    select u.doc_id, part::bigint as part, count(*)::bigint as n_words, min(i)::bigint as first_word from u asof join f on u.doc_id = f.doc_id and u.i >= f.st group by 1, 2""",
)
def split_long(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text")
    n = F.transform(F.split("text", " ", -1), lambda x: T.n_tokens(x))
    out = S.split_long_sentences(rows.select("doc_id", n.alias("pieces")), 128)
    return out.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n_words"), F.min("word").cast("long").alias("first_word")).withColumn("part", F.col("part").cast("long"))


FLAGS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "i16_multi_hot",
    "select o_custkey, array_to_string([" + ", ".join(f"max((o_orderpriority = '{p}')::int)" for p in FLAGS) + "], '') as vector from orders group by o_custkey",
)
def multi_hot(spark, sf):
    # at most as many distinct labels as there are classes meet in a group
    sets = table(spark, sf, "orders", "o_custkey", "o_orderpriority").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("labels"))
    return sets.select("o_custkey", F.array_join(A.multi_hot("labels", FLAGS).cast("array<string>"), "").alias("vector"))


@query("i17_dense_ids", "select p_partkey * 3 as oid, (row_number() over (order by p_partkey) - 1)::bigint as nid from part")
def dense(spark, sf):
    rows = table(spark, sf, "part", "p_partkey").select((F.col("p_partkey") * 3).alias("oid"))
    return dense_ids(rows, "oid")


@query("i19_save_lengths", f"select conv_id, turn, greatest(len({toks('text')}), len({toks('role')}))::bigint as length from conversations")
def lengths(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.regex_tokens("text").alias("a"), T.regex_tokens("role").alias("b"))
    return Q.save_lengths(rows, "a", "b").select("conv_id", "turn", F.col("length").cast("long").alias("length"))


@query(
    "i20_segment_ids",
    f"""with w as (select doc_id, generate_subscripts(t, 1) as i, unnest(t) as w from (select doc_id, {toks('text')} as t from documents)),
    n as (select doc_id, i, sum((w = '.')::int) over (partition by doc_id order by i) as seen from w),
    s as (select doc_id, string_agg((abs(seen - 1) % 2)::varchar, '' order by i) as g from n group by doc_id)
    select doc_id, md5(coalesce(g, '')) as segments from documents left join s using (doc_id)""",
)
def segments(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text").select("doc_id", T.regex_tokens("text").alias("t"))
    return rows.select("doc_id", F.md5(F.array_join(A.segment_ids("t", F.lit(".")).cast("array<string>"), "")).alias("segments"))
