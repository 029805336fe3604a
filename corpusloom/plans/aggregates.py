"""Queries: aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import corpus as C
from corpusloom.operators import knn as K
from corpusloom.operators import metrics as M
from corpusloom.operators import sampling as G
from corpusloom.plans.joins import PRED_SQL, predictions, references
from corpusloom.plans.registry import query, table, toks, wide
from corpusloom.plans.text import normal_sql


@query("e01_dedup_exact", "select min(doc_id) as doc_id from documents group by text")
def dedup(spark, sf):
    return C.dedup_exact(wide(spark, sf, "documents", "doc_id", "text"), "text", "doc_id")


@query(
    "e02_duplicate_fraction",
    r"""with h as (select md5(regexp_replace(text, '\s+', '', 'g')) as h from documents)
    select count(*)::bigint as n_rows, count(distinct h)::bigint as n_distinct, round(1 - count(distinct h) / count(*), 6) as fraction from h""",
)
def duplicates(spark, sf):
    out = C.duplicate_fraction(wide(spark, sf, "documents", "text"), T.content_hash("text"))
    return out.withColumn("fraction", F.round("fraction", 6))


LEN_IDS = f"select doc_id, unnest(list_transform({toks('text')}, lambda t: length(t)))::bigint as token from documents"
COUNTS_SQL = f"t as ({LEN_IDS}), c as (select r.i::bigint as token, coalesce(k.n, 0)::bigint as n from range(64) r(i) left join (select token, count(*) as n from t group by 1) k on k.token = r.i)"


def counts(spark, sf):
    rows = wide(spark, sf, "documents", "text").select(F.transform(T.regex_tokens("text"), lambda t: F.length(t)).alias("tokens"))
    return C.token_counts(rows, 64)


@query("e03_token_counts", f"with {COUNTS_SQL} select token, n from c")
def token_counts(spark, sf):
    return counts(spark, sf)


@query("e04_masking_weights", f"with {COUNTS_SQL} select token, n, case when token in (0, 1) then 0.0 else round(pow(greatest(n, 1)::double, -0.7), 9) end as weight from c")
def weights(spark, sf):
    return C.masking_weights(counts(spark, sf), 0.7, [0, 1]).withColumn("weight", F.round("weight", 9))


@query("e05_label_frequencies", "with l as (select unnest(string_split(p_name || ' ' || lower(p_type), ' ')) as label from part) select label, count(*)::bigint as n from l group by 1")
def label_frequencies(spark, sf):
    labels = table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ", -1)).alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e06_ids_by_label",
    """with p as (select l_returnflag as label, l_shipmode as dataset, id from (select l_returnflag, l_linestatus as l_shipmode, l_orderkey * 8 + l_linenumber as id from lineitem) where l_returnflag <> 'N'),
    n as (select *, (row_number() over (partition by dataset, label order by id) - 1) // 1000 as part from p)
    select dataset, label, part::bigint as part, count(*)::bigint as n, md5(string_agg(id::varchar, ',' order by id)) as digest from n group by 1, 2, 3""",
)
def by_label(spark, sf):
    rows = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber").select(
        F.col("l_linestatus").alias("dataset"), F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    )
    out = G.ids_by_label(rows, ["dataset"], "label", "id", 1000, skip=F.col("label") == "N")
    return out.select("dataset", "label", "part", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


@query(
    "e07_length_bounds",
    f"""select source as dataset, lang as prompt, max(100 + len({toks('text')}) + len({toks('lang')}))::bigint as max_length,
    max(len({toks('text')}) + len({toks('lang')}))::bigint as max_length_per_sample, max(100 + len({toks('text')}))::bigint as max_context_length from documents group by 1, 2""",
)
def bounds(spark, sf):
    rows = wide(spark, sf, "documents", "text", "lang", "source").select(F.col("source").alias("dataset"), F.col("lang").alias("prompt"), T.n_tokens("text").alias("c"), T.n_tokens("lang").alias("t"))
    return G.length_bounds(rows, ["dataset", "prompt"], F.col("c"), F.col("t"), F.lit(100))


# embeddings serve as per-token losses: the absolute value of a component
def losses(spark, sf, shift: int = 0):
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    loss = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    mask = F.transform("embedding", lambda x, i: (F.pmod(i + F.col("vec_id") + shift, F.lit(4)) != 0).cast("double"))
    return v.select(F.col("vec_id").alias("query_id"), loss.alias("loss"), mask.alias("mask"))


@query(
    "e08_masked_mean_loss",
    """with x as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings),
    r as (select vec_id, sum(abs(v)) / count(*) as m from x where (i + vec_id) % 4 <> 0 group by 1) select round(avg(m), 6) as loss, count(*)::bigint as n from r""",
)
def masked_mean(spark, sf):
    return M.mean_masked_loss(losses(spark, sf)).select(F.round("loss", 6).alias("loss"), "n")


def _ours(spark, sf):
    """In-context losses: the base loss scaled down or up by the vector's label."""
    v = table(spark, sf, "embeddings", "vec_id", "label", "embedding")
    scale = F.when(F.col("label") % 2 == 0, 0.8).otherwise(1.1)
    return v.select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * scale).alias("loss"))


@query(
    "e09_loss_gain_filter",
    """with x as (select vec_id, label, unnest(embedding)::double as v from embeddings),
    g as (select vec_id, avg(abs(v) * case when label % 2 = 0 then 0.8 else 1.1 end) - avg(abs(v)) as gain from x where abs(v) > 0.0001 group by 1)
    select vec_id as query_id, round(gain, 6) as gain from g where gain < -0.01""",
)
def gain(spark, sf):
    out = M.loss_gain_filter(losses(spark, sf), _ours(spark, sf), 0.01)
    return out.withColumn("gain", F.round("gain", 6))


EVAL_SQL = f"""{PRED_SQL}, j as (select id, task_id, task_category, refs[1] as ref, case when quality = 1 then coalesce(prediction, '') else lower(coalesce(prediction, '')) || '!' end as pred from refs left join preds using (id)),
 s as (select *, ({normal_sql('pred')} = {normal_sql('ref')})::int as em from j)"""


def evaluated(spark, sf):
    rows = M.join_predictions(references(spark, sf), predictions(spark, sf))
    return rows.withColumn("prediction", F.when(F.col("quality") == 1, F.col("prediction")).otherwise(F.concat(F.lower("prediction"), F.lit("!"))))


@query("e10_exact_match", f"with {EVAL_SQL} select round(100 * avg(em), 4) as exact_match, count(*)::bigint as n from s")
def exact(spark, sf):
    rows = evaluated(spark, sf).select(M.exact_match("prediction", "references").alias("em"))
    return rows.agg(F.round(100 * F.avg("em"), 4).alias("exact_match"), F.count(F.lit(1)).alias("n"))


@query("e11_rouge_l")
def rouge_l(spark, sf):
    from corpusloom.functions.scores import rouge_l_max

    rows = evaluated(spark, sf).select("task_id", rouge_l_max("prediction", "references").alias("r"))
    return rows.groupBy("task_id").agg(F.round(100 * F.avg("r"), 4).alias("rouge_l"))


@query(
    "e12_grouped_metrics",
    f"""with {EVAL_SQL} select 'all' as level, '' as name, round(100 * avg(em), 4) as exact_match, count(*)::bigint as n from s
    union all select 'category', lower(task_category), round(100 * avg(em), 4), count(*)::bigint from s group by 2
    union all select 'task', task_id, round(100 * avg(em), 4), count(*)::bigint from s group by 2""",
)
def grouped(spark, sf):
    return M.grouped_metrics(evaluated(spark, sf), "task_category", "task_id", {"exact_match": M.exact_match("prediction", "references")})


@query(
    "e13_prompt_averages",
    """with r as (select l_returnflag as dataset, l_linestatus as prompt, l_linenumber as metric, avg(l_quantity) as value from lineitem group by 1, 2, 3),
    p as (select dataset, prompt, avg(value) as value from r group by 1, 2), d as (select dataset, avg(value) as value from p group by 1)
    select 'prompt' as level, dataset, prompt, round(value, 6) as value from p union all select 'dataset', dataset, '', round(value, 6) from d
    union all select 'all', '', '', round(avg(value), 6) from d""",
)
def averages(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    results = li.groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("prompt"), "l_linenumber").agg(F.avg("l_quantity").alias("value"))
    return M.prompt_averages(results).withColumn("value", F.round("value", 6))


@query(
    "e14_rank_metrics",
    """with x as (select vec_id as q, generate_subscripts(embedding, 1) - 1 as item, round(unnest(embedding)::double, 6) as s from embeddings),
    g as (select q, s as gs, item as gi from x where item = q % 64),
    r as (select x.q, 1 + sum((s > gs or (s = gs and item < gi))::int) as rank from x join g using (q) group by 1)
    select round(avg(rank), 6) as mean_rank, round(avg(1.0 / rank), 6) as mrr, round(avg((rank <= 1)::int), 6) as acc_1, round(avg((rank <= 5)::int), 6) as acc_5, round(avg((rank <= 10)::int), 6) as acc_10 from r""",
)
def rank_metrics(spark, sf):
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    rows = v.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 64).alias("gold"), F.posexplode("embedding").alias("item", "s"))
    rows = rows.withColumn("score", F.round(F.col("s").cast("double"), 6))
    return K.rank_metrics(K.rank_of_gold(rows))


@query(
    "e15_precision_at_k",
    """with l as (select o_custkey as c, o_orderkey as o, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as q from orders)
    select round(100 * avg(hits / 5), 4) as precision from (select c, sum((r <= 5 and q <= 3)::int) as hits from l group by c)""",
)
def precision(spark, sf):
    from corpusloom.ids import top_per_group

    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    top = top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5, out="r")
    ref = top_per_group(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 3, out="r")
    lists = lambda df, n: df.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "o_orderkey"))), lambda s: s["o_orderkey"]).alias(n))
    both = lists(top, "pred").join(lists(ref, "ref"), "o_custkey")
    return both.agg(F.round(100 * F.avg(M.precision_at_k("pred", "ref", 5)), 4).alias("precision"))


@query(
    "e16_answer_f1",
    f"""with n as (select conv_id, turn, list_filter(string_split({normal_sql('text', True)}, ' '), lambda x: x <> '') as w from conversations),
    p as (select a.conv_id, a.turn, a.w as x, b.w as y from n a join n b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
    s as (select conv_id, turn, len(x) as nx, len(y) as ny,
      coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0)::double as same from p)
    select conv_id, turn, round(case when same = 0 then 0 else 2 * (same / nx) * (same / ny) / (same / nx + same / ny) end, 6) as f1 from s""",
)
def answer_f1(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.array("text").alias("refs"))
    pairs = c.join(after, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(M.answer_f1("text", "refs"), 6).alias("f1"))


def _grams(n: int) -> str:
    parts = " || ' ' || ".join(f"lead(w, {i}) over (partition by {{k}} order by i)" if i else "w" for i in range(n))
    return parts


def _bleu_sql() -> str:
    words = f"select conv_id, turn, generate_subscripts(t, 1) as i, unnest(t) as w from (select conv_id, turn, {toks('text')} as t from conversations)"
    out = [f"with w as ({words}), pairs as (select a.conv_id, a.turn from (select conv_id, turn from conversations) a join (select conv_id, turn from conversations) b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"]
    for n in range(1, 5):
        gram = _grams(n).replace("{k}", "conv_id, turn")
        out.append(f"g{n} as (select conv_id, turn, g, count(*) as c from (select conv_id, turn, {gram} as g from w) where g is not null group by 1, 2, 3)")
        out.append(
            f"m{n} as (select sum(least(a.c, coalesce(b.c, 0))) as m, sum(a.c) as t from g{n} a join pairs p on a.conv_id = p.conv_id and a.turn = p.turn "
            f"left join g{n} b on b.conv_id = a.conv_id and b.turn = a.turn + 1 and b.g = a.g)"
        )
    out.append("l as (select sum(len_a) as pl, sum(len_b) as rl from (select (select count(*) from w where w.conv_id = p.conv_id and w.turn = p.turn) as len_a, (select count(*) from w where w.conv_id = p.conv_id and w.turn = p.turn + 1) as len_b from pairs p))")
    logs = " + ".join(f"ln(m{n}.m / m{n}.t) / 4" for n in range(1, 5))
    return ", ".join(out) + f" select round(100 * (case when pl < rl then exp(1 - rl / pl) else 1 end) * exp({logs}), 4) as bleu from m1, m2, m3, m4, l"


def turn_pairs(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return c.join(after, ["conv_id", "turn"])


@query("e17_bleu", _bleu_sql())
def bleu(spark, sf):
    rows = turn_pairs(spark, sf).select(T.regex_tokens("text").alias("p"), F.array(T.regex_tokens("ref")).alias("r"))
    return M.bleu(rows, "p", "r")


@query("e18_rouge_corpus")
def rouge(spark, sf):
    rows = turn_pairs(spark, sf).withColumn("id", F.col("conv_id") * 10_000 + F.col("turn"))
    return M.rouge_corpus(rows, "text", "ref", "id")


@query("e18_rouge_bootstrap")
def rouge_bootstrap(spark, sf):
    rows = turn_pairs(spark, sf).withColumn("id", F.col("conv_id") * 10_000 + F.col("turn"))
    return M.rouge_corpus(rows, "text", "ref", "id", bootstrap=200, seed=3)


@query("e19_char_error_rate", "select c_nationkey, round(sum(levenshtein(c_name, c_mktsegment)) / sum(length(c_mktsegment)), 6) as cer from customer group by 1")
def cer(spark, sf):
    return M.char_error_rate(table(spark, sf, "customer"), "c_name", "c_mktsegment", ["c_nationkey"]).withColumn("cer", F.round("cer", 6))


@query("e19_word_error_rate")
def wer(spark, sf):
    return M.word_error_rate(turn_pairs(spark, sf), "text", "ref").withColumn("wer", F.round("wer", 6))


@query("e20_accuracy", "select o_orderpriority, round(100 * avg((o_orderstatus = case when o_totalprice > 200000 then 'O' else 'F' end)::int), 6) as accuracy from orders group by 1")
def accuracy(spark, sf):
    o = table(spark, sf, "orders").withColumn("pred", F.when(F.col("o_totalprice") > 200000, "O").otherwise("F"))
    return M.accuracy(o, "pred", "o_orderstatus", ["o_orderpriority"]).withColumn("accuracy", F.round("accuracy", 6))


RANK_SQL = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"


@query("e20_spearman", f"with r as (select {RANK_SQL.format('l_quantity')} as a, {RANK_SQL.format('l_extendedprice')} as b from lineitem) select round(corr(a, b), 6) as spearman from r")
def spearman(spark, sf):
    return M.spearman(table(spark, sf, "lineitem", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").withColumn("spearman", F.round("spearman", 6))


@query(
    "e20_task_metrics",
    f"""with {EVAL_SQL} select task_id, round(100 * avg((pred = ref)::int), 4) as "Accuracy", round(100 * avg(({normal_sql('pred', True)} = {normal_sql('ref', True)})::int), 4) as "Squad EM" from s group by 1""",
)
def task_metrics(spark, sf):
    return M.task_metrics(evaluated(spark, sf), ["Accuracy", "Squad EM"], keys=["task_id"])


LONG_SQL = "select task_id, metric, name, round(value, 4) as value from m"


def long_metrics(out):
    return out.withColumn("value", F.round("value", 4))


@query(
    "e20_registry",
    f"""with {EVAL_SQL}, w as (select task_id, pred, ref, list_filter(string_split({normal_sql('pred', True)}, ' '), lambda x: x <> '') as x, list_filter(string_split({normal_sql('ref', True)}, ' '), lambda x: x <> '') as y from s),
    c as (select *, coalesce(list_sum(list_transform(list_distinct(x), lambda v: least(len(list_filter(x, lambda u: u = v)), len(list_filter(y, lambda u: u = v))))), 0)::double as same from w),
    q as (select task_id, (pred = ref)::int as acc, (array_to_string(x, ' ') = array_to_string(y, ' '))::int as em,
      case when same = 0 then 0 else 2 * (same / len(x)) * (same / len(y)) / (same / len(x) + same / len(y)) end as f1, length(pred) as a, length(ref) as b from c),
    r as (select task_id, rank() over (partition by task_id order by a) + (count(*) over (partition by task_id, a) - 1) / 2.0 as a, rank() over (partition by task_id order by b) + (count(*) over (partition by task_id, b) - 1) / 2.0 as b from q),
    m as (select task_id, 'Accuracy' as metric, 'accuracy' as name, 100 * avg(acc) as value from q group by 1 union all select task_id, 'Other', 'accuracy', 100 * avg(acc) from q group by 1
      union all select task_id, 'Squad', 'em', 100 * avg(em) from q group by 1 union all select task_id, 'Squad', 'f1', 100 * avg(f1) from q group by 1
      union all select task_id, 'Trivia QA', 'em', 100 * avg(em) from q group by 1 union all select task_id, 'Trivia QA', 'f1', 100 * avg(f1) from q group by 1
      union all select task_id, 'Spearman Correlation', 'spearman_corrcoef', case when stddev_pop(a) * stddev_pop(b) > 0 then 100 * corr(a, b) end from r group by 1) {LONG_SQL}""",
)
def registry(spark, sf):
    lengths = lambda p, r: (F.char_length(p).cast("string"), F.transform(r, lambda x: F.char_length(x).cast("string")))
    names = ["Accuracy", "Other", "Squad", "Trivia QA", "Spearman Correlation"]
    return long_metrics(M.registry_metrics(evaluated(spark, sf), names, ["task_id"], {"Spearman Correlation": lengths}))


@query(
    "l02_metric_hooks",
    f"""with {EVAL_SQL}, q as (select task_id, (pred = ref)::int as plain, (regexp_replace(lower(pred), '[^a-z]', '', 'g') = regexp_replace(lower(ref), '[^a-z]', '', 'g'))::int as hooked from s),
    m as (select task_id, 'Accuracy' as metric, 'accuracy' as name, 100 * avg(hooked) as value from q group by 1 union all select task_id, 'Other', 'accuracy', 100 * avg(plain) from q group by 1) {LONG_SQL}""",
)
def metric_hooks(spark, sf):
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    hook = lambda p, r: (letters(p), F.transform(r, letters))
    return long_metrics(M.registry_metrics(evaluated(spark, sf), ["Accuracy", "Other"], ["task_id"], {"Accuracy": hook}))


@query(
    "l07_user_metric",
    f"""with {EVAL_SQL}, g as (select task_id, abs(length(pred) - length(ref)) as gap from s),
    m as (select task_id, 'length gap' as metric, 'median' as name, median(gap)::double as value from g group by 1 union all select task_id, 'length gap', 'distinct', count(distinct gap)::double from g group by 1) {LONG_SQL}""",
)
def user_metric(spark, sf):
    from collections import Counter

    from corpusloom.operators.aggregates import Metric, user_metrics

    def update(state: Counter, rows) -> Counter:
        return state + Counter((rows["prediction"].str.len() - rows["reference"].str.len()).abs().tolist())

    def finish(state: Counter) -> dict[str, float]:
        import statistics

        return {"median": statistics.median(state.elements()), "distinct": len(state)}

    gap = Metric(Counter, update, lambda a, b: a + b, finish)
    rows = evaluated(spark, sf).select("task_id", "prediction", F.get("references", F.lit(0)).alias("reference"))
    return long_metrics(user_metrics(rows, {"length gap": gap}, ["prediction", "reference"], ["task_id"]))


def logs(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    return e.select(
        F.get_json_object("props", "$.k").alias("error"), F.col("event_id").cast("string").alias("line"), F.col("user_id").alias("test"),
        F.when(F.col("user_id") % 10 > 0, F.concat(F.lit("m"), F.col("user_id") % 10)).alias("model"),
    )


LOGS = "l as (select json_extract_string(props, '$.k') as error, event_id::varchar as line, user_id as test, case when user_id % 10 > 0 then 'm' || (user_id % 10) end as model from events)"


@query(
    "e21_count_by_error",
    f"with {LOGS}, x as (select error from l where test < 3), c as (select error, count(*)::bigint as n from l where error not in (select error from x) group by 1) select error, n, test, line from c join l using (error)",
)
def by_error(spark, sf):
    rows = logs(spark, sf)
    counted = M.count_by_error(rows, rows.filter("test < 3").select("error").distinct())
    return M.failed_tests(rows, counted)


@query(
    "e22_count_by_model",
    f"""with {LOGS}, c as (select model, error, count(*) as n from l where model is not null group by 1, 2), r as (select *, row_number() over (partition by model order by n desc, error) as r, sum(n) over (partition by model) as t from c)
    select model, t::bigint as n, error as top_error, n::bigint as top_n from r where r = 1""",
)
def by_model(spark, sf):
    return M.count_by_model(logs(spark, sf))


@query(
    "e23_table_query",
    """with q as (select s_suppkey as query_id, s_nationkey, s_suppkey % 6 as agg from supplier),
    h as (select q.query_id, q.agg, c_custkey as row, c_acctbal as v from q join customer c on c.c_nationkey = q.s_nationkey and c.c_mktsegment = 'BUILDING' and c_acctbal > 1000),
    a as (select query_id, agg, count(*) as n, sum(v) as s, max(v) as hi, min(v) as lo, arg_max(row, (v, row)) as hr, arg_min(row, (v, row)) as lr, any_value(row) as r1, any_value(v) as v1 from h group by 1, 2)
    select query_id, -1::bigint as row, case when agg = 3 then null else 'none' end as text, case when agg = 3 then 0.0 end as number from q where query_id not in (select query_id from a)
    union all select query_id, -1, null, n from a where agg = 3
    union all select query_id, hr, null, hi from a where agg = 1
    union all select query_id, lr, null, lo from a where agg = 2
    union all select query_id, case when n = 1 then r1 else -1 end, null, round(case when agg = 4 then s else s / n end, 4) from a where agg in (4, 5)
    union all select query_id, r1, null, v1 from a where agg = 0 and n = 1
    union all select query_id, row, null, null from h where agg = 0 and query_id in (select query_id from a where n > 1)""",
)
def table_query(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.select(
        F.col("c_nationkey").alias("table_id"), F.col("c_custkey").alias("row"),
        F.array(F.lower("c_mktsegment"), F.col("c_acctbal").cast("string")).alias("cells"), F.array(F.lit("text"), F.lit("real")).alias("types"),
    )
    cond = lambda col, op, value: F.struct(F.lit(col).alias("col"), F.lit(op).alias("op"), F.lit(value).alias("value"))
    q = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.col("s_nationkey").alias("table_id"), F.lit(1).alias("sel"), (F.col("s_suppkey") % 6).cast("int").alias("agg"),
        F.array(cond(0, 0, "Building"), cond(1, 1, "1,000")).alias("conds"),
    )
    out = M.table_query(rows, q)
    shown = F.when(F.col("text") == "none", F.col("text"))
    return out.select("query_id", "row", shown.alias("text"), F.round("number", 4).alias("number"))


@query("e24_zscore", "select o_orderkey, round((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 6) as z from orders")
def zscore(spark, sf):
    out = C.zscore(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_totalprice")
    return out.select("o_orderkey", F.round("z", 6).alias("z"))


@query("e25_length_histogram", f"select bin::bigint as bin, count(*)::bigint as n from (select len(list_filter([10, 50, 100, 500, 1000], lambda b: b <= len({toks('text')}))) as bin from documents) group by 1")
def histogram(spark, sf):
    out = C.length_histogram(wide(spark, sf, "documents", "text"), [10, 50, 100, 500, 1000], T.n_tokens("text"))
    return out.withColumn("bin", F.col("bin").cast("long"))


@query("e26_retriever_recall", "select o_orderkey, round(avg(round(o_totalprice % 1, 6)) over w + 1e-9, 6) as mean from orders window w as (order by o_orderkey)")
def recall(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", F.round(F.col("o_totalprice") % 1, 6).alias("score"))
    return M.retriever_recall(o, "o_orderkey", "score").withColumn("mean", F.round(F.col("mean") + 1e-9, 6))


@query(
    "e27_demo_label_balance",
    """with r as (select *, row_number() over (partition by lang order by doc_id) as r from documents join labels using (doc_id))
    select lang, quality, count(*)::bigint as n from r where r <= 40 group by 1, 2""",
)
def balance(spark, sf):
    rows = table(spark, sf, "documents", "doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return M.demo_label_balance(G.take_pool(rows, 40, ["lang"], "doc_id"), ["lang"], "quality")


@query("e00_vector_functions", """select vec_id, round(list_dot_product(e, e), 6) as sq, (list_position(e, list_max(e)) - 1)::bigint as top, round(list_sum(list_transform(e, lambda x: 1 / (1 + exp(-x)))), 6) as sig
  from (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)""")
def vector_functions(spark, sf):
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    return v.select("vec_id", F.round(V.squared_norm("embedding"), 6).alias("sq"), V.argmax("embedding").cast("long").alias("top"), F.round(V.total(V.sigmoid("embedding")), 6).alias("sig"))
