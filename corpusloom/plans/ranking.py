"""Queries: nearest neighbours, retrieval, spans, entities and label scores.

Embedding components stand in for model outputs (logits, probabilities, losses).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import corpus as C
from corpusloom.operators import knn as K
from corpusloom.operators import sampling as G
from corpusloom.operators import spans as X
from corpusloom.plans.joins import KNN_SQL, neighbors
from corpusloom.plans.registry import query, table, toks, wide


def vectors(spark, sf, *more):
    return table(spark, sf, "embeddings", "vec_id", *more, "embedding")


def _hits(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", F.round("score", 6).alias("score"))


@query("f01_knn_l2", f"with {KNN_SQL} select query_id, rank::bigint as rank, neighbor_id, round(score, 6) as score from n where rank <= 20")
def knn_l2(spark, sf):
    return _hits(neighbors(spark, sf, 20))


IP_SQL = """v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
  d as (select a.vec_id as query_id, b.vec_id as neighbor_id, list_dot_product(a.e, b.e) as score from v a join v b on {0}),
  n as (select *, row_number() over (partition by query_id order by score desc, neighbor_id) as rank from d)"""


@query("f01_knn_ip", f"with {IP_SQL.format('a.vec_id <> b.vec_id')} select query_id, rank::bigint as rank, neighbor_id, round(score, 6) as score from n where rank <= 20")
def knn_ip(spark, sf):
    return _hits(neighbors(spark, sf, 20, "IP"))


@query("f01_knn_approximate")
def knn_lsh(spark, sf):
    v = vectors(spark, sf)
    out, _ = K.knn_approximate(v.withColumnRenamed("vec_id", "query_id"), v, 20)
    return _hits(out)


@query(
    "f02_max_inner_product_as_l2",
    """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), m as (select max(list_dot_product(e, e)) as phi from v)
    select vec_id, round(list_dot_product(e, e) + (phi - list_dot_product(e, e)), 6) as corpus_norm, round(list_dot_product(e, e), 6) as query_norm, 65::bigint as n from v, m""",
)
def as_l2(spark, sf):
    v = vectors(spark, sf)
    phi = v.agg(F.max(V.squared_norm("embedding")).alias("phi"))
    aux = F.sqrt(F.greatest(F.col("phi") - V.squared_norm("embedding"), F.lit(0.0)))
    out = v.crossJoin(F.broadcast(phi)).select("vec_id", V.zero_augmented("embedding", aux).alias("c"), V.zero_augmented("embedding").alias("q"))
    return out.select("vec_id", F.round(V.squared_norm("c"), 6).alias("corpus_norm"), F.round(V.squared_norm("q"), 6).alias("query_norm"), F.size("c").cast("long").alias("n"))


@query(
    "f03_retrieve",
    f"with {IP_SQL.format('true')} select query_id, rank::bigint as rank, neighbor_id, round(score, 6) as score, round(v.e[1], 6) as first from n join v on v.vec_id = neighbor_id where rank <= 5",
)
def retrieve(spark, sf):
    v = vectors(spark, sf)
    out = K.retrieve(v, v, 5, 64, "vec_id", "vec_id", "embedding")
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", F.round("score", 6).alias("score"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query(
    "f04_retrieve_filtered",
    f"""with {IP_SQL.format('a.vec_id <> b.vec_id').replace('join v b', 'join (select v.* from v join documents on doc_id = vec_id) b')},
    t as (select query_id, neighbor_id, score from n join documents on doc_id = neighbor_id where rank <= 20 and len(string_split(text, ' ')) > 60),
    r as (select *, row_number() over (partition by query_id order by score desc, neighbor_id) as rank from t) select query_id, rank::bigint as rank, neighbor_id, score from r where rank <= 10""",
)
def retrieve_filtered(spark, sf):
    v = vectors(spark, sf)
    passages = v.join(table(spark, sf, "documents", "doc_id", "text").withColumnRenamed("doc_id", "vec_id"), "vec_id")
    out = K.retrieve_filtered(v.withColumnRenamed("vec_id", "query_id"), passages, 10, "text", 60)
    return _hits(out)


def _bm25_sql() -> str:
    parts = []
    for name, field, boost in (("t", "text", 1.0), ("s", "source", 2.0)):
        parts.append(
            f"""{name}x as (select doc_id, {toks('lower(' + field + ')')} as w from documents), {name}s as (select count(*) as n, avg(len(w)) as av from {name}x),
            {name}p as (select term, doc_id, len, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as term from {name}x) group by 1, 2, 3),
            {name}d as (select term, count(*) as df from {name}p group by 1),
            {name}r as (select q.item_id as query_id, p.doc_id as passage_id, sum({boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) order by term) as score
              from q join {name}p p using (term) join {name}d using (term) cross join {name}s group by 1, 2)"""
        )
    return f"""with q as (select item_id, unnest(list_distinct({toks('lower(text)')})) as term from benchmark), {', '.join(parts)},
      b as (select query_id, passage_id, max(score) as score from (select * from tr union all select * from sr) group by 1, 2),
      k as (select *, row_number() over (partition by query_id order by score desc, passage_id) as rank from b)
      select query_id, rank::bigint as rank, passage_id from k where rank <= 10"""


@query("f05_lexical_search", _bm25_sql())
def lexical(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    passages = wide(spark, sf, "documents", "doc_id", "text", "source").withColumnRenamed("doc_id", "passage_id")
    out = K.lexical_search(queries, passages, 10, {"text": 1.0, "source": 2.0})
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "passage_id")


# spans ---------------------------------------------------------------------------------------------


def features(spark, sf):
    """Each vector as one window: its components as start logits, in reverse as end logits; the first
    four positions are the question. Two consecutive vectors are windows of one example."""
    v = vectors(spark, sf)
    up = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    offsets = F.transform(
        F.sequence(F.lit(0), F.size("embedding") - 1),
        lambda i: F.when(i >= 4, F.struct((i * 3).alias("s"), (i * 3 + 2).alias("e"))),
    )
    return v.select(
        F.floor(F.col("vec_id") / 2).alias("example_id"), F.col("vec_id").alias("feature_id"), offsets.alias("offsets"),
        up.alias("start_logits"), F.reverse(up).alias("end_logits"),
    )


def examples(spark, sf):
    base = table(spark, sf, "embeddings", "vec_id").select(F.floor(F.col("vec_id") / 2).alias("example_id")).distinct()
    return base.select("example_id", F.lpad(F.col("example_id").cast("string"), 300, "abcdefghijklmnopqrstuvwxyz").alias("context"))


QA_SQL = """x as (select vec_id, vec_id // 2 as ex, generate_subscripts(embedding, 1) - 1 as i, round(unnest(embedding)::double, 6) as v from embeddings),
  n as (select vec_id, max(i) as last from x group by 1),
  st as (select * from (select *, row_number() over (partition by vec_id order by v desc, i) as r from x) where r <= 20),
  y as (select x.vec_id, x.ex, last - i as i, v from x join n using (vec_id)),
  en as (select * from (select *, row_number() over (partition by vec_id order by v desc, i) as r from y) where r <= 20),
  pr as (select s.ex, s.vec_id, s.i as s, e.i as e, s.v as sv, e.v as ev, s.v + e.v as score from st s join en e using (vec_id) where s.i >= 4 and e.i >= 4 and e.i >= s.i and e.i - s.i + 1 <= 30),
  nu as (select ex, min(sn + en) as score, arg_min(sn, (sn + en, vec_id)) as sv, arg_min(en, (sn + en, vec_id)) as ev from (select a.ex, a.vec_id, a.v as sn, b.v as en from x a join y b on a.vec_id = b.vec_id and a.i = 0 and b.i = 0) group by 1)"""


@query(
    "f06_qa_nbest",
    f"""with {QA_SQL}, al as (select ex, 0 as nul, vec_id as f, s * 3 as fr, e * 3 + 2 as t, sv, ev, score from pr union all select ex, 1, -1, 0, 0, sv, ev, score from nu),
    rk as (select *, row_number() over (partition by ex order by score desc, nul, f, fr, t) as r from al),
    kp as (select *, row_number() over (partition by ex order by r) as rank, exp(score - max(score) over (partition by ex)) as w from rk where r <= 20 or nul = 1)
    select ex as example_id, rank::bigint as rank, substr(lpad(ex::varchar, 300, 'abcdefghijklmnopqrstuvwxyz'), fr + 1, t - fr) as text, round(score, 6) as score,
      round(w / sum(w) over (partition by ex), 6) as probability from kp""",
)
def qa_nbest(spark, sf):
    out = X.qa_nbest(features(spark, sf), examples(spark, sf), with_negative=True)
    return out.select("example_id", F.col("rank").cast("long").alias("rank"), "text", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


@query(
    "f06_qa_final",
    f"""with {QA_SQL}, b as (select ex, arg_max(s, (score, -vec_id, -s, -e)) as s, arg_max(e, (score, -vec_id, -s, -e)) as e, arg_max(sv, (score, -vec_id, -s, -e)) as sv, arg_max(ev, (score, -vec_id, -s, -e)) as ev from pr group by 1)
    select b.ex as example_id, round(nu.score - b.sv - b.ev, 6) as null_diff,
      case when nu.score - b.sv - b.ev > -0.6 then '' else substr(lpad(b.ex::varchar, 300, 'abcdefghijklmnopqrstuvwxyz'), s * 3 + 1, e * 3 + 2 - s * 3) end as answer from b join nu using (ex)""",
)
def qa_final(spark, sf):
    f = features(spark, sf)
    nbest = X.qa_nbest(f, examples(spark, sf), with_negative=True)
    out = X.qa_final(nbest, X.null_scores(f), -0.6)
    return out.withColumn("null_diff", F.round("null_diff", 6))


@query(
    "f07_qa_nbest_beam",
    f"""with {QA_SQL}, s5 as (select * from st where r <= 5), e5 as (select * from en where r <= 5),
    bp as (select s.ex, s.vec_id, s.i as s, e.i as e, s.v + e.v as score from s5 s join e5 e using (vec_id) where s.i >= 4 and e.i >= 4 and e.i >= s.i and e.i - s.i + 1 <= 30),
    rk as (select *, row_number() over (partition by ex order by score desc, vec_id, s * 3, e * 3 + 2) as rank from bp)
    select ex as example_id, rank::bigint as rank, substr(lpad(ex::varchar, 300, 'abcdefghijklmnopqrstuvwxyz'), s * 3 + 1, e * 3 + 2 - s * 3) as text, round(score, 6) as score from rk where rank <= 20
    union all select ex, 1, '', round(-2e-6, 6) from (select distinct ex from x) where ex not in (select ex from bp)""",
)
def qa_beam(spark, sf):
    f = features(spark, sf)
    f = f.withColumn("_s", X.top_positions("start_logits", 5)).withColumn("_e", X.top_positions("end_logits", 5))
    f = f.select(
        "example_id", "feature_id", "offsets",
        F.transform("_s", lambda x: x["i"]).alias("start_index"), F.transform("_s", lambda x: x["v"]).alias("start_log_prob"),
        F.flatten(F.transform("_s", lambda s: F.transform("_e", lambda x: x["i"]))).alias("end_index"),
        F.flatten(F.transform("_s", lambda s: F.transform("_e", lambda x: x["v"]))).alias("end_log_prob"),
    )
    out = X.qa_nbest_beam(f, examples(spark, sf))
    return out.select("example_id", F.col("rank").cast("long").alias("rank"), "text", F.round("score", 6).alias("score"))


SPAN_SQL = """x as (select vec_id, vec_id // 2 as ex, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v, len(embedding) as n from embeddings),
  m as (select vec_id, ex, i, case when i >= 4 or i = 0 then v else -10000 end as s, case when (n - 1 - i) is null then 0 end as z from x),
  r as (select a.vec_id, a.ex, a.i, case when a.i >= 4 or a.i = 0 then b.v else -10000 end as e from x a join x b on a.vec_id = b.vec_id and b.i = a.n - 1 - a.i),
  ps as (select vec_id, ex, i, exp(s - max(s) over w) / sum(exp(s)) over w * exp(max(s) over w) as p from m window w as (partition by vec_id)),
  pe as (select vec_id, ex, i, exp(e - max(e) over w) / sum(exp(e)) over w * exp(max(e) over w) as p from r window w as (partition by vec_id))"""


@query(
    "f08_span_decode",
    f"""with {SPAN_SQL}, c as (select a.ex, a.vec_id, a.i as s, b.i as e, round(a.p * b.p, 12) as score from ps a join pe b using (vec_id) where a.i >= 4 and b.i >= a.i and b.i - a.i < 15
      union all select ex, -1, -1, -1, round(min(q), 12) from (select a.ex, a.p * b.p as q from ps a join pe b using (vec_id) where a.i = 0 and b.i = 0) group by ex),
    k as (select *, row_number() over (partition by ex order by score desc, vec_id, s, e) as rank from c)
    select ex as example_id, rank::bigint as rank, vec_id::bigint as window, s::bigint as "start", e::bigint as "end", round(score, 9) as score from k where rank <= 5""",
)
def span_decode(spark, sf):
    v = vectors(spark, sf)
    mask = F.transform("embedding", lambda x, i: F.when((i >= 4) | (i == 0), 1).otherwise(0))
    rows = v.select(F.floor(F.col("vec_id") / 2).alias("example_id"), F.col("vec_id").alias("window"), F.col("embedding").alias("start"), F.reverse("embedding").alias("end"), mask.alias("mask"))
    # ends mirror starts here, so every product comes twice: twelve digits make these ties exact
    out = X.span_decode(rows, 5, 15, impossible=True, digits=12)
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("example_id", long("rank"), long("window"), long("start"), long("end"), F.round("score", 9).alias("score"))


@query(
    "f09_best_valid_span",
    f"""with {QA_SQL}, c as (select s.vec_id, s.i as s, e.i as e, s.v + e.v - case when e.i < s.i or e.i - s.i > 20 then 1e8 else 0 end as score from st s join en e using (vec_id) where s.r <= 4 and e.r <= 4),
    k as (select *, row_number() over (partition by vec_id order by score desc, e, s) as r from c) select vec_id, s::bigint as "start", e::bigint as "end", (score > -1000)::int as valid from k where r = 1""",
)
def best_span(spark, sf):
    f = features(spark, sf).select(F.col("feature_id").alias("vec_id"), F.col("start_logits").alias("start"), F.col("end_logits").alias("end"))
    out = X.best_valid_span(f, 4, 20)
    return out.select("vec_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("score") > -1000).cast("int").alias("valid"))


@query(
    "f10_entity_pairs",
    """with x as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, 1 / (1 + exp(-6 * unnest(embedding)::double)) as p from embeddings)
    select a.vec_id, a.i::bigint as "start", b.i::bigint as "end", round(a.p * b.p, 6) as score from x a join x b on a.vec_id = b.vec_id and a.i < b.i where a.p * b.p >= 0.55""",
)
def entity_pairs(spark, sf):
    p = F.transform("embedding", lambda x: 1.0 / (1.0 + F.exp(-6 * x.cast("double"))))
    out = X.entity_pairs(vectors(spark, sf).select("vec_id", p.alias("p_start"), p.alias("p_end")), 0.55)
    return out.select("vec_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.round("score", 6).alias("score"))


LABELS = ["O", "B-MISC", "I-MISC", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]


def pieces(spark, sf):
    """Order lines as sub-word pieces of a sentence (the order); scores are spread over nine labels."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("l_quantity"))
    scores = F.array(*[((F.col("l_partkey") * (k + 3) + F.col("l_suppkey") * (k + 1)) % 89 / 89.0) for k in range(9)])
    return li.select(
        F.col("l_orderkey").alias("sent_id"), F.col("l_linenumber").alias("index"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("word"),
        (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 8).alias("end"),
        (F.col("l_quantity") > 30).alias("is_subword"), scores.alias("scores"),
    )


SCORES_SQL = ", ".join(f"((pk * {k + 3} + sk * {k + 1}) % 89) / 89.0" for k in range(9))
PIECES_SQL = f"""p as (select l_orderkey as q, l_linenumber as ix, min(l_partkey) as pk, min(l_suppkey) as sk, min(l_quantity) as qt from lineitem group by 1, 2),
  sc as (select q, ix, pk, qt > 30 as sub, [{SCORES_SQL}] as v from p)"""
NAMES_SQL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


def _words_sql(strategy: str) -> str:
    vector = {
        "FIRST": "arg_min(v, ix)",
        "MAX": "arg_min(v, (-list_max(v), ix))",
        "AVERAGE": "[" + ", ".join(f"avg(v[{k + 1}])" for k in range(9)) + "]",
    }[strategy]
    return f"""with {PIECES_SQL}, f as (select *, sum(case when sub and r > 1 then 0 else 1 end) over (partition by q order by ix) as w from (select *, row_number() over (partition by q order by ix) as r from sc)),
    g as (select q, w, {vector} as v, min(ix) as ix, string_agg('w' || pk, '' order by ix) as word, min(ix) * 10 as s, max(ix) * 10 + 8 as e from f group by 1, 2)"""


def _register_words(strategy: str) -> None:
    @query(
        f"f11_words_{strategy.lower()}",
        _words_sql(strategy) + f""" select q as sent_id, ix::bigint as "index", word, s::bigint as "start", e::bigint as "end", {NAMES_SQL}[list_position(v, list_max(v))] as entity, round(list_max(v), 6) as score from g""",
    )
    def words(spark, sf):
        out = X.words_from_subwords(pieces(spark, sf), LABELS, strategy)
        long = lambda c: F.col(c).cast("long").alias(c)
        return out.select("sent_id", long("index"), "word", long("start"), long("end"), "entity", F.round("score", 6).alias("score"))


for _s in ("FIRST", "MAX", "AVERAGE"):
    _register_words(_s)


@query(
    "f12_group_entities",
    _words_sql("FIRST") + f""", l as (select q, ix, word, s, e, {NAMES_SQL}[list_position(v, list_max(v))] as en, list_max(v) as sc from g),
    t as (select *, regexp_replace(en, '^[BI]-', '') as tag, lag(regexp_replace(en, '^[BI]-', '')) over (partition by q order by ix) as before from l),
    n as (select *, sum(case when before = tag and en not like 'B-%' then 0 else 1 end) over (partition by q order by ix) as grp from t)
    select q as sent_id, grp::bigint as "group", arg_min(tag, ix) as entity_group, round(avg(sc), 6) as score, string_agg(word, ' ' order by ix) as word, min(s)::bigint as "start", max(e)::bigint as "end" from n group by 1, 2""",
)
def group(spark, sf):
    out = X.group_entities(X.words_from_subwords(pieces(spark, sf), LABELS, "FIRST"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("sent_id", long("group"), "entity_group", F.round("score", 6).alias("score"), "word", long("start"), long("end"))


@query(
    "f13_top_labels",
    """with x as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings),
    s as (select vec_id, i, v, exp(v) / sum(exp(v)) over (partition by vec_id) as p from x), r as (select *, row_number() over (partition by vec_id order by v desc, i) as rank from s)
    select vec_id, rank::bigint as rank, 'label_' || i as label, round(p, 6) as score from r where rank <= 5""",
)
def top_labels(spark, sf):
    out = X.label_scores(vectors(spark, sf), [f"label_{i}" for i in range(1, 65)], "softmax", 5, "embedding")
    return out.select("vec_id", F.col("rank").cast("long").alias("rank"), "label", F.round("score", 6).alias("score"))


def _pairs(spark, sf):
    v = vectors(spark, sf)
    # every pair of components is a label: its entailment and its contradiction
    at = F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1)
    value = lambda i: F.get("embedding", i).cast("double")
    one = lambda i: F.struct(i.alias("label_id"), F.concat(F.lit("label "), i.cast("string")).alias("label"), value(2 * i).alias("entail"), value(2 * i + 1).alias("contradict"))
    return v.select(F.col("vec_id").alias("text_id"), F.explode(F.transform(at, one)).alias("p")).select("text_id", "p.*")


ZERO_SQL = "p as (select vec_id, l, 'label ' || l as label, embedding[2 * l + 1]::double as e, embedding[2 * l + 2]::double as c from (select vec_id, embedding, unnest(generate_series(0, len(embedding) // 2 - 1)) as l from embeddings))"


@query("f14_zero_shot_single", f"with {ZERO_SQL}, s as (select vec_id, l, label, exp(e) / sum(exp(e)) over (partition by vec_id) as score from p) select vec_id as text_id, label, round(score, 6) as score, (row_number() over (partition by vec_id order by score desc, l))::bigint as rank from s")
def zero_single(spark, sf):
    out = X.zero_shot_scores(_pairs(spark, sf), False)
    return out.select("text_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("f14_zero_shot_multi", f"with {ZERO_SQL}, s as (select vec_id, l, label, exp(e / 2) / (exp(e / 2) + exp(c / 2)) as score from p) select vec_id as text_id, label, round(score, 6) as score, (row_number() over (partition by vec_id order by score desc, l))::bigint as rank from s")
def zero_multi(spark, sf):
    out = X.zero_shot_scores(_pairs(spark, sf), True, temperature=2.0)
    return out.select("text_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _options(spark, sf):
    v = vectors(spark, sf, "label")
    rows = v.select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    losses = rows.select(F.col("vec_id").alias("sample_id"), F.floor(F.sqrt(F.col("pos") / 4)).cast("int").alias("option"), "pos", F.abs(F.col("x").cast("double")).alias("loss"))
    samples = v.select(F.col("vec_id").alias("sample_id"), (F.col("label") % 4).alias("gold"), F.lit(5.0).alias("prefix_loss"), F.lit(20).alias("input_len"))
    return losses, samples


def _options_sql(norm: bool) -> str:
    used = "m" if norm else "s"
    return f"""with x as (select vec_id, label % 4 as gold, generate_subscripts(embedding, 1) - 1 as i, abs(unnest(embedding)::double) as l from embeddings),
    o as (select vec_id, gold, floor(sqrt(i / 4))::int as opt, sum(l) as s, count(*) as n, sum(l) / count(*) as m from x group by 1, 2, 3)
    select vec_id as sample_id, arg_min(opt, (round({used}, 6), opt))::bigint as pred, round(min({used}), 6) as min_loss, round(max(case when opt = gold then m end), 6) as gold_loss,
      round(max(case when opt = gold then (5.0 + {used}) / (20 + n) end), 6) as gold_tot_loss from o group by 1"""


def _register_options(name: str, norm: bool) -> None:
    @query(name, _options_sql(norm))
    def options(spark, sf):
        out = X.score_options(*_options(spark, sf), normalize=norm)
        return out.select("sample_id", F.col("pred").cast("long").alias("pred"), *[F.round(c, 6).alias(c) for c in ("min_loss", "gold_loss", "gold_tot_loss")])


_register_options("f15_score_options", False)
_register_options("f15_score_options_normalized", True)


@query(
    "f16_first_copy",
    r"select doc_id from documents where doc_id in (select min(doc_id) from documents group by md5(regexp_replace(text, '\s+', '', 'g')))",
)
def first_copy(spark, sf):
    return C.first_copy(wide(spark, sf, "documents", "doc_id", "text"), T.content_hash("text"), "doc_id").select("doc_id")


@query(
    "f17_select_confident",
    """with s as (select o_orderkey, o_orderstatus, (o_totalprice % 1000) / 1000 as p from orders), f as (select *, row_number() over (order by p desc, o_orderkey) as r, count(*) over () as n from s where p > 0.5)
    select o_orderkey, o_orderstatus as label from f where r <= floor(0.3 * n)""",
)
def confident(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    rows = o.select("o_orderkey", F.col("o_orderstatus").alias("prediction"), (F.col("o_totalprice") % 1000 / 1000).alias("probability"))
    return G.select_confident(rows, 0.5, 0.3, "o_orderkey", shuffle_seed=1).select("o_orderkey", "label")


@query(
    "f18_merge_overlaps",
    f"""with s as (select doc_id, list_transform({toks('text')}, lambda t: length(t)) as t from documents),
    g as (select *, unnest(generate_series(0, len(t) - 1, 64)) as s from s where len(t) > 0),
    c as (select doc_id, s // 64 as ord, list_slice(t, s + 1, s + 96) as t from g where len(list_slice(t, s + 1, s + 96)) > case when s = 0 then 0 else 16 end),
    p as (select doc_id, ord, t, coalesce(lag(t) over (partition by doc_id order by ord), []) as b from c),
    o as (select *, list_transform(generate_series(1, least(len(t), len(b))), lambda n: len(list_filter(generate_series(1, n), lambda i: b[len(b) - n + i] = t[i]))) as e from p),
    v as (select *, list_transform(e, lambda x, n: case when x > 1 then x / n + n / 10000.0::double else 0.0::double end) as v from o),
    k as (select *, case when coalesce(list_max(v), 0) > 0 then list_position(v, list_max(v)) else 0 end as n from v)
    select doc_id, ord::bigint as ord, (coalesce(sum(len(t) - n) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0))::bigint as "offset",
      md5(array_to_string(list_slice(t, n + 1, len(t)), ',')) as digest from k""",
)
def merge(spark, sf):
    from corpusloom.operators import segment as S
    from corpusloom.plans.sequences import id_docs

    chunks = S.chunk_stride(id_docs(spark, sf), 96, 16, 16).select("doc_id", "ord", F.col("chunk").alias("tokens"))
    out = X.merge_overlaps(chunks, "doc_id")
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "offset", F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@query(
    "f19_fill_top_k",
    """with x as (select vec_id, generate_subscripts(embedding, 1) - 1 as t, unnest(embedding)::double as v from embeddings),
    s as (select vec_id, t, exp(v) / sum(exp(v)) over (partition by vec_id) as p, v from x), r as (select *, row_number() over (partition by vec_id order by v desc, t) as rank from s where t in (select distinct label from embeddings))
    select vec_id, rank::bigint as rank, t::bigint as token, round(p, 6) as score from r where rank <= 3""",
)
def fill(spark, sf):
    v = vectors(spark, sf, "label")
    rows = v.select("vec_id", F.posexplode("embedding").alias("token", "x")).withColumn("logit", F.col("x").cast("double"))
    targets = v.select(F.col("label").alias("token"))
    out = X.fill_top_k(rows, 3, targets, ["vec_id"])
    return out.select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("token").cast("long").alias("token"), F.round("score", 6).alias("score"))
