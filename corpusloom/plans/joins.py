"""Queries: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as T
from corpusloom.ids import dense_ids
from corpusloom.operators import corpus as C
from corpusloom.operators import knn as K
from corpusloom.operators import metrics as M
from corpusloom.operators import neardup as N
from corpusloom.operators import spans as X
from corpusloom.plans.registry import query, table, toks, wide

KNN_SQL = """v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
  d as (select a.vec_id as query_id, b.vec_id as neighbor_id,
     list_sum(list_transform(generate_series(1, len(a.e)), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) as score
     from v a join v b on a.vec_id <> b.vec_id),
  n as (select *, row_number() over (partition by query_id order by score, neighbor_id) as rank from d)"""


def neighbors(spark, sf, k=5, metric="L2", exclude=True):
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    return K.knn(v.withColumnRenamed("vec_id", "query_id"), v, k, metric, exclude_self=exclude)


@query("d01_hydrate", f"with {KNN_SQL} select query_id, string_agg(v.label::varchar || ':' || v.vec_id, ',' order by rank) as found from n join v on v.vec_id = neighbor_id where rank <= 5 group by 1")
def hydrate(spark, sf):
    seqs = table(spark, sf, "embeddings", "vec_id", "label").select("vec_id", F.concat_ws(":", "label", "vec_id").alias("value"))
    return K.hydrate(neighbors(spark, sf), seqs, "vec_id", "value").select("query_id", F.array_join("value", ",").alias("found"))


@query(
    "d02_remap_ids",
    """with m as (select o_orderkey as oid, row_number() over (order by o_orderkey) - 1 as nid from orders)
    select nid::bigint as nid, count(*)::bigint as n, max(l_linenumber)::bigint as last_line from lineitem join m on oid = l_orderkey group by 1""",
)
def remap(spark, sf):
    ids = dense_ids(table(spark, sf, "orders", "o_orderkey"), "o_orderkey")
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").withColumnRenamed("l_orderkey", "o_orderkey")
    return lines.join(ids, "o_orderkey").groupBy("nid").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").cast("long").alias("last_line"))


@query("d04_exclude_self", f"with {KNN_SQL} select query_id, rank::bigint as rank, neighbor_id, round(score, 6) as score from n where rank <= 5")
def exclude_self(spark, sf):
    hits = K.exclude_self(neighbors(spark, sf, 6, exclude=False), 5)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", F.round("score", 6).alias("score"))


PRED_SQL = "refs as (select doc_id as id, lang as task_id, source as task_category, [text] as refs, quality, d.text from documents d join labels using (doc_id)), preds as (select doc_id as id, text as prediction from documents where n_chars > 500)"


def references(spark, sf):
    """Labelled documents as references; the task is the language, the category the source."""
    return wide(spark, sf, "documents", "doc_id", "text", "lang", "source").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("task_id"), F.col("source").alias("task_category"), F.array("text").alias("references"), "quality"
    )


def predictions(spark, sf):
    d = wide(spark, sf, "documents", "doc_id", "text", "n_chars").filter("n_chars > 500")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("prediction"))


@query("d05_join_predictions", f"with {PRED_SQL} select id, (prediction is null)::int as missing, md5(coalesce(prediction, '')) as digest from refs left join preds using (id)")
def join_predictions(spark, sf):
    out = M.join_predictions(references(spark, sf), predictions(spark, sf))
    return out.select("id", "missing", F.md5("prediction").alias("digest"))


@query("d06_restrict_tasks", f"with {PRED_SQL} select id from refs where task_id in (select lang from documents group by lang having count(*) > (select count(*) / 8 from documents))")
def restrict(spark, sf):
    langs = table(spark, sf, "documents", "lang").groupBy(F.col("lang").alias("task_id")).agg(F.count(F.lit(1)).alias("n"))
    total = table(spark, sf, "documents", "lang").agg((F.count(F.lit(1)) / 8).alias("limit"))
    tasks = langs.crossJoin(F.broadcast(total)).filter(F.col("n") > F.col("limit"))
    return M.restrict_tasks(references(spark, sf), tasks).select("id")


@query("d07_zip_columns", "select vec_id as id, label, n_chars from embeddings join documents on doc_id = vec_id")
def zip_columns(spark, sf):
    a = table(spark, sf, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "id")
    b = table(spark, sf, "documents", "doc_id", "n_chars").withColumnRenamed("doc_id", "id")
    return a.join(b, "id")


@query("d08_remove_rows", "select doc_id, n_chars from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def remove(spark, sf):
    return N.remove_rows(table(spark, sf, "documents", "doc_id", "n_chars"), table(spark, sf, "labels").filter("toxic = 1"), "doc_id")


@query("d10_attach_documents", f"with {KNN_SQL} select query_id, rank::bigint as rank, neighbor_id, lang, n_chars from n left join documents on doc_id = neighbor_id where rank <= 5")
def attach(spark, sf):
    passages = table(spark, sf, "documents", "doc_id", "lang", "n_chars")
    out = K.attach_documents(neighbors(spark, sf), passages, "doc_id")
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "lang", "n_chars")


@query(
    "d11_evidence_has_answer",
    f"""with b as (select item_id as q, {toks('text')} as t from benchmark),
    a as (select item_id as q, list_slice({toks('text')}, 3, 5) as ans from benchmark),
    g as (select b.q, b.t, a.ans, a.q as aq from b join a on a.q // 8 = b.q // 8),
    p as (select q, aq, t, ans, unnest(generate_series(1, len(t) - len(ans) + 1)) as i from g),
    h as (select q, aq, i from p where len(ans) > 0 and list_slice(t, i, i + len(ans) - 1) = ans)
    select aq as question_id, q as block_id, count(*)::bigint as n, min(i - 1)::bigint as first_start, max(i + 1)::bigint as last_end from h group by 1, 2""",
)
def evidence(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", T.regex_tokens("text").alias("tokens"))
    answers = rows.select(F.col("item_id").alias("question_id"), F.slice("tokens", 3, 3).alias("answer"))
    # a question's blocks are the benchmark items of its group of eight
    blocks = rows.select(F.col("item_id").alias("block_id"), "tokens", F.explode(F.sequence(F.floor(F.col("item_id") / 8) * 8, F.floor(F.col("item_id") / 8) * 8 + 7)).alias("question_id"))
    found = X.evidence_positions(blocks, answers).filter("has")
    return found.select("question_id", "block_id", F.size("starts").cast("long").alias("n"), F.array_min("starts").cast("long").alias("first_start"), F.array_max("ends").cast("long").alias("last_end"))


@query("d12_enrich_optional", "select event_id, user_id, c_mktsegment from events left join customer on c_custkey = user_id and c_acctbal > 0")
def enrich(spark, sf):
    lookup = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return table(spark, sf, "events", "event_id", "user_id").join(lookup, "user_id", "left")


# set operations ------------------------------------------------------------------------------------


@query("h01_concatenate", "select 'd' as kind, doc_id as id, length(text)::bigint as n from documents union all select 'b', item_id, length(text)::bigint from benchmark")
def concatenate(spark, sf):
    a = table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    b = table(spark, sf, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(b)


@query(
    "h02_expand_groups",
    """with names as (select p_partkey, unnest(string_split(p_name || ' ' || p_brand, ' ')) as name from part),
    groups as (select distinct p_brand as name, p_type as member from part)
    select p_partkey, coalesce(member, name) as name from names left join groups using (name)""",
)
def expand(spark, sf):
    p = table(spark, sf, "part")
    groups = p.select(F.col("p_brand").alias("group"), F.col("p_type").alias("member")).distinct()
    named = p.select("p_partkey", F.replace(F.concat_ws("-", "p_name", "p_brand"), F.lit(" "), F.lit("-")).alias("names"))
    return expand_names(named, groups, "names")


def expand_names(df, groups, names):
    """Names joined by ``-``; a group name stands for its members."""
    single = df.withColumn("name", F.explode(F.split(names, "-", -1))).drop(names)
    members = groups.select(F.col("group").alias("name"), "member")
    joined = single.join(members, "name", "left")
    return joined.select(*[c for c in single.columns if c != "name"], F.coalesce("member", "name").alias("name"))


WORD_SET = r"list_distinct(list_filter(regexp_split_to_array({}, '[^A-Za-z_0-9]+'), lambda x: x <> ''))"


@query(
    "h03_jaccard",
    f"""with s as (select doc_id, {WORD_SET.format('text')} as s from documents)
    select a.doc_id, case when len(a.s) + len(b.s) = 0 then 1 else round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) end as jaccard
    from s a join s b on b.doc_id = a.doc_id + 1""",
)
def jaccard(spark, sf):
    s = wide(spark, sf, "documents", "doc_id", "text").select("doc_id", F.array_distinct(N.code_tokens("text")).alias("s"))
    after = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("b"))
    return s.join(after, "doc_id").select("doc_id", F.round(A.jaccard("s", "b"), 6).alias("jaccard"))


@query("h04_id_difference", "select doc_id from documents where doc_id not in (select min(doc_id) from documents group by text)")
def id_difference(spark, sf):
    docs = wide(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id").join(C.dedup_exact(docs, "text", "doc_id"), "doc_id", "left_anti")


@query(
    "h05_multiset_intersection",
    f"""with a as (select l.quality, unnest({toks('text')}) as w from documents join labels l using (doc_id)),
    c as (select w, sum((quality = 1)::int) as x, sum((quality = 0)::int) as y from a group by w)
    select sum(least(x, y))::bigint as n from c""",
)
def multiset(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    words = A.fan_out(rows, ["quality"], T.regex_tokens("text"), "w")
    # the merge key is a constant, so counts meet per word and only their sums per key
    one = words.withColumn("k", F.lit(0))
    return M.multiset_overlap(one.filter("quality = 1"), one.filter("quality = 0"), ["k"], "w").select("n")


@query("h07_distinct_label_lists", f"select distinct source as dataset, array_to_string({toks('lang')}, ' ') as label from documents")
def label_lists(spark, sf):
    d = table(spark, sf, "documents", "source", "lang")
    return d.select(F.col("source").alias("dataset"), F.array_join(T.regex_tokens("lang"), " ").alias("label")).distinct()
