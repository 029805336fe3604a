"""Queries: records to prompts (part, orders, customer, conversations, documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as T
from corpusloom.operators import contrastive as K
from corpusloom.operators import prompts as P
from corpusloom.operators.corpus import most_frequent_value
from corpusloom.plans.registry import hashed, query, strip, table, toks, wide
from corpusloom.session import dealt, materialize

SIZE = {
    "name": "size_class",
    "jinja": "How large is {{ p_name }} by {{ p_brand | lower }}?{% if p_size > 25 %} It is over 25.{% elif p_size == 3 %} It is three.{% else %} It is small.{% endif %} ||| {{ answer_choices[p_size % 3] }}",
    "answer_choices": "low ||| middle ||| high",
}
KIND = {
    "name": "kind",
    "jinja": "{{ p_brand }}: what type is the {{ p_name | upper }}?\n{{ ['ECONOMY', 'PROMO'] | join(' or ') }} ||| {{ p_type }}",
    "answer_choices": "{{ p_type }} ||| none of these",
}
PRICE = {
    "name": "price",
    "jinja": "Price of {{ p_name | capitalize }} ({{ p_size + 1 }})? ||| {% if p_retailprice >= 1000 %}high{% else %}low{% endif %}",
    "answer_choices": "low ||| high",
}
SEGMENT = {"name": "segment", "jinja": "Which segment is {{ c_name }} in? ||| {{ c_mktsegment | lower }}"}
STATUS = {"name": "status", "jinja": "Order {{ o_orderkey }} of customer {{ o_custkey }} ||| {{ o_orderstatus }}"}
URGENCY = {"name": "urgency", "jinja": "Priority of order {{ o_orderkey }}? ||| {{ o_orderpriority }}"}

SIZE_CONTEXT = "'How large is ' || p_name || ' by ' || lower(p_brand) || '?' || case when p_size > 25 then ' It is over 25.' when p_size = 3 then ' It is three.' else ' It is small.' end"
SIZE_TARGET = "['low', 'middle', 'high'][p_size % 3 + 1]"
KIND_CONTEXT = "p_brand || ': what type is the ' || upper(p_name) || '?' || chr(10) || 'ECONOMY or PROMO'"
PRICE_CONTEXT = "'Price of ' || upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) || ' (' || (p_size + 1) || ')?'"
PRICE_TARGET = "case when p_retailprice >= 1000 then 'high' else 'low' end"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


@query("c01_render", f"select p_partkey, {SIZE_CONTEXT} as context, {SIZE_TARGET} as target from part")
def render(spark, sf):
    return P.render(parts(spark, sf), SIZE["jinja"], SIZE["answer_choices"]).select("p_partkey", "context", "target")


@query(
    "c01_render_long_values",
    f"""with d as (select doc_id, lang, text, replace(text, chr(10), ' | ') as body from documents),
    s as (select doc_id, lang, case when length(body) <= 2053 then body else
       (case when contains(substr(body, 1, 2045), ' ') then regexp_replace(substr(body, 1, 2045), ' [^ ]*$', '') else substr(body, 1, 2045) end) || '...' end as cut from d)
    select doc_id, md5({strip("'Text: ' || cut")}) as context, lang as target from s""",
)
def render_long(spark, sf):
    docs = wide(spark, sf, "documents", "doc_id", "text", "lang").select("doc_id", "lang", F.replace("text", F.lit("\n"), F.lit(" | ")).alias("body"))
    return P.render(docs, "Text: {{ body }} ||| {{ lang }}").select("doc_id", F.md5("context").alias("context"), "target")


@query("c02_answer_choices", "select p_partkey, p_type || '/none of these' as choices from part")
def choices(spark, sf):
    out = P.render(parts(spark, sf), KIND["jinja"], KIND["answer_choices"])
    return out.select("p_partkey", F.array_join("options", "/").alias("choices"))


RENDER_ALL_SQL = f"""select p_partkey, 'size_class' as prompt, {SIZE_CONTEXT} as context, {SIZE_TARGET} as target from part
  union all select p_partkey, 'kind', {KIND_CONTEXT}, p_type from part
  union all select p_partkey, 'price', {PRICE_CONTEXT}, {PRICE_TARGET} from part"""


@query("c03_render_all", RENDER_ALL_SQL)
def render_all(spark, sf):
    return P.render_all(parts(spark, sf), [SIZE, KIND, PRICE], "p_partkey").drop("options")


def prompt_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset, prompt) pairs as the orders table has them: priority class and status."""
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus")
    return o.select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("prompt")).distinct()


@query(
    "c04_allowed_prompts",
    """with p as (select distinct o_orderpriority as dataset, o_orderstatus as prompt from orders),
    allow as (select o_orderpriority as dataset, min(o_orderstatus) as prompt from orders where o_orderpriority < '3' group by 1),
    ban as (select max(o_orderpriority) as dataset, 'O' as prompt from orders)
    select * from p where (dataset not in (select dataset from allow) or (dataset, prompt) in (select dataset, prompt from allow))
      and (dataset, prompt) not in (select dataset, prompt from ban)""",
)
def allowed(spark, sf):
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus")
    allow = o.filter("o_orderpriority < '3'").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.min("o_orderstatus").alias("prompt"))
    ban = o.agg(F.max("o_orderpriority").alias("dataset")).select("dataset", F.lit("O").alias("prompt"))
    return P.allowed_prompts(prompt_pairs(spark, sf), allow, ban)


@query(
    "c05_most_frequent",
    f"""with t as (select doc_id, unnest({toks('text')}) as word from documents),
    c as (select doc_id, word, count(*)::bigint as n from t group by 1, 2),
    m as (select *, max(n) over (partition by doc_id) as top from c)
    select doc_id, word, n from m where n = top""",
)
def most_frequent(spark, sf):
    rows = A.fan_out(wide(spark, sf, "documents", "doc_id", "text"), ["doc_id"], T.regex_tokens("text"), "word")
    return most_frequent_value(rows, ["doc_id"], "word")


def template_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Part rows in the shape of a template catalog: brand as dataset, type as subset."""
    h = F.md5(F.col("p_partkey").cast("string"))
    uuid = F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)), F.substr(h, F.lit(13), F.lit(4)), F.substr(h, F.lit(17), F.lit(4)), F.substr(h, F.lit(21), F.lit(12)))
    return parts(spark, sf).select(
        F.when(F.col("p_partkey") % 50 == 0, F.lit("broken")).otherwise(uuid).alias("id"),
        F.col("p_brand").alias("dataset"), F.col("p_type").alias("subset"), F.col("p_name").alias("name"),
        F.concat(F.lit("About {{ name }} "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 40 == 1, F.lit(" no end")).otherwise(F.lit(" ||| {{ label }}"))).alias("jinja"),
    )


@query("c06_template_stats", "select p_brand as dataset, count(*)::bigint as n from part group by 1")
def stats(spark, sf):
    return P.template_stats(template_rows(spark, sf))


@query(
    "c07_validate_templates",
    """with t as (select case when p_partkey % 50 = 0 then 'broken' else 'id' || p_partkey end as id, p_brand as dataset, p_type as subset, p_name as name,
       p_size || case when p_partkey % 40 = 1 then ' no end' else ' |||' end as jinja from part),
    f as (select dataset, subset, name, 'duplicate id' as problem from t where id in (select id from t group by id having count(*) > 1)
      union all select dataset, subset, name, 'duplicate name' from t where (dataset, subset, name) in (select dataset, subset, name from t group by 1, 2, 3 having count(*) > 1)
      union all select dataset, subset, name, 'duplicate body' from t where (dataset, subset, jinja) in (select dataset, subset, jinja from t group by 1, 2, 3 having count(*) > 1)
      union all select dataset, subset, name, 'no separator' from t where jinja not like '%|||%'
      union all select dataset, subset, name, 'malformed id' from t where id = 'broken')
    select dataset, subset, name, problem, count(*)::bigint as n from f group by all""",
)
def validate(spark, sf):
    found = P.validate_templates(template_rows(spark, sf))
    return found.groupBy("dataset", "subset", "name", "problem").agg(F.count(F.lit(1)).alias("n"))


PART_RULES = [("{{ p_name }}", "context"), ("{{ p_brand }}", "question"), ("L(ECONOMY;LARGE;MEDIUM;PROMO;SMALL;STANDARD)", "options"), ("{{ p_type }}", "answer"), ("{{ p_size % 6 }}", "label")]


@query(
    "c08_to_standard",
    """with r as (select p_partkey, p_name, p_brand, p_type, p_size % 6 as l, ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'] as o from part)
    select p_partkey, p_name as context, p_brand as question, len(o)::bigint as n_options,
      array_to_string(list_sort(list_distinct(list_concat([l], list_filter(list_transform([p_type, o[l + 1]], lambda a: list_position(o, a) - 1), lambda x: x >= 0)))), ',') as label,
      array_to_string(list_sort(list_distinct([p_type, o[l + 1]])), ',') as answer from r""",
)
def to_standard(spark, sf):
    p = parts(spark, sf)
    out = p.select("p_partkey", P.to_standard(p, PART_RULES).alias("s"))
    return out.select(
        "p_partkey", F.array_join("s.context", "|").alias("context"), F.array_join("s.question", "|").alias("question"),
        F.size("s.options").cast("long").alias("n_options"),
        F.array_join(F.col("s.label").cast("array<string>"), ",").alias("label"), F.array_join("s.answer", ",").alias("answer"),
    )


@query(
    "c09_from_standard",
    f"""select p_partkey, p_name as title, p_brand || '?' as body, 'ECONOMY' as first_choice, 'PROMO' as other_choice,
      ({hashed(3, "(p_partkey || ':label')")} % 4)::bigint as label from part""",
)
def from_standard(spark, sf):
    p = parts(spark, sf)
    std = p.select("p_partkey", P.to_standard(p, PART_RULES).alias("std"))
    rules = [("title", "{{ context[0] }}"), ("body", "{{ question[0] }}?"), ("choices.text", ["{{ options[0] }}", "{{ options[3] }}"]), ("label", "{{ range(0, 4) | random }}")]
    rec = P.from_standard("std", rules, F.col("p_partkey").cast("string"), 3, {"label": "bigint"})
    out = std.select("p_partkey", rec.alias("r"))
    return out.select("p_partkey", "r.title", "r.body", F.get("r.choices.text", F.lit(0)).alias("first_choice"), F.get("r.choices.text", F.lit(1)).alias("other_choice"), "r.label")


@query(
    "c10_few_shot_prompt",
    """with b as (select max(case when item_id = 0 then text end) as def, max(case when item_id = 1 then text end) as x1, max(case when item_id = 2 then text end) as x2 from benchmark)
    select conv_id, turn, md5('Definition: ' || replace(regexp_replace(def, chr(10) || '+', chr(10), 'g'), chr(10), ' ') || chr(10)
       || 'Positive Example 1- input: ' || replace(regexp_replace(x1, chr(10) || '+', chr(10), 'g'), chr(10), ' ') || ' output: one' || chr(10)
       || 'Positive Example 2- input: ' || replace(regexp_replace(x2, chr(10) || '+', chr(10), 'g'), chr(10), ' ') || ' output: two' || chr(10)
       || 'Now complete the following example- input: ' || replace(regexp_replace(text, chr(10) || '+', chr(10), 'g'), chr(10), ' ') || ' output:') as context,
       ' ' || role || chr(10) as target from conversations cross join b""",
)
def few_shot(spark, sf):
    pick = lambda i: F.max(F.when(F.col("item_id") == i, F.col("text")))
    task = table(spark, sf, "benchmark").agg(pick(0).alias("def"), pick(1).alias("x1"), pick(2).alias("x2"))
    rows = table(spark, sf, "conversations").crossJoin(F.broadcast(task))
    shown = F.array(*[F.struct(F.col(c).alias("input"), F.lit(o).alias("output")) for c, o in (("x1", "one"), ("x2", "two"))])
    context, target = P.few_shot_prompt(F.col("def"), shown, F.col("text"), F.col("role"))
    return rows.select("conv_id", "turn", F.md5(context).alias("context"), target.alias("target"))


@query(
    "c11_truncate_left",
    f"""with t as (select conv_id, turn, {toks('text')} as a, {toks('role')} as b from conversations)
    select conv_id, turn, md5(array_to_string(case when len(a) + len(b) <= 40 then a else list_slice(a, len(a) - (40 - len(b)) + 1, len(a)) end, ' ')) as digest from t""",
)
def truncate(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.regex_tokens("text").alias("a"), T.regex_tokens("role").alias("b"))
    return rows.select("conv_id", "turn", F.md5(F.array_join(A.truncate_left("a", "b", 40), " ")).alias("digest"))


@query(
    "c12_hypothesis_pairs",
    """select conv_id, turn, l.i::bigint as label_id, md5(text) as text, 'This text is about ' || l.label || '.' as hypothesis
    from conversations cross join (select unnest([0, 1, 2]) as i, unnest(['work', 'travel', 'food']) as label) l""",
)
def hypotheses(spark, sf):
    out = P.hypothesis_pairs(table(spark, sf, "conversations"), ["work", "travel", "food"], "This text is about {}.")
    return out.select("conv_id", "turn", F.col("label_id").cast("long").alias("label_id"), F.md5("text").alias("text"), "hypothesis")


@query(
    "c13_context_prompt",
    """select l_orderkey, l_linenumber, replace('ask: ' || p_name || ' / ' || p_brand || ' // ' || l_returnflag || ' part?', '  ', ' ') as prompt
    from lineitem join part on p_partkey = l_partkey""",
)
def context_prompt(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    rows = li.join(parts(spark, sf).withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    quoted = F.concat(F.lit('"'), "p_name", F.lit('"'))
    text = P.context_prompt(F.concat("l_returnflag", F.lit(" part?")), quoted, F.col("p_brand"), "ask: ")
    return rows.select("l_orderkey", "l_linenumber", text.alias("prompt"))


@query(
    "c14_support_document",
    "select conv_id as query_id, md5('<P> ' || string_agg(text, ' <P> ' order by turn)) as digest from conversations group by 1",
)
def support(spark, sf):
    hits = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return P.support_document(hits).select("query_id", F.md5("support").alias("digest"))


@query(
    "c15_post_process_prompt",
    f"""select p_partkey, 'price' as prompt, {PRICE_CONTEXT} || ' Answer:' as context, 'the ' || {PRICE_TARGET} as target, 'low,high,free' as options from part
    union all select p_partkey, 'size_class', {SIZE_CONTEXT}, {SIZE_TARGET}, 'low,middle,high' from part""",
)
def hooks(spark, sf):
    def price(context, target, options):
        return F.concat(context, F.lit(" Answer:")), F.concat(F.lit("the "), target), F.concat(options, F.array(F.lit("free")))

    out = P.render_all(parts(spark, sf), [PRICE, SIZE], "p_partkey", hooks={"price": price})
    return out.withColumn("options", F.array_join("options", ","))


@query(
    "c16_conversation_context",
    f"""with t as (select conv_id, turn, list_append({toks('text')}, '<end>') as t from conversations),
    w as (select conv_id, turn, generate_subscripts(t, 1) as i, unnest(t) as w from t),
    n as (select *, row_number() over (partition by conv_id order by turn desc, i desc) as back from w)
    select conv_id, count(*)::bigint as n, md5(string_agg(w, ' ' order by turn, i)) as digest from n where back <= 200 group by 1""",
)
def conversation(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", T.regex_tokens("text").alias("tokens"))
    out = P.conversation_context(turns, 200, "<end>")
    return out.select("conv_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


# contrastive examples ------------------------------------------------------------------------------


def datasets(spark: SparkSession, sf: str) -> list[K.Dataset]:
    part = K.Dataset(
        "part", dealt(parts(spark, sf), "p_partkey"), "p_partkey", [SIZE, KIND, PRICE], PART_RULES,
        [("p_name", "{{ context[0] }}"), ("p_brand", "{{ answer[0] if answer else 'unknown' }}"), ("p_type", "{{ options[0] if options else 'none' }}"), ("p_size", "{{ range(0, 50) | random }}"), ("p_retailprice", "{{ range(900, 2000) | random }}")],
        {"context": 1, "question": 1, "options": 6}, {"context": 1}, {"p_size": "int", "p_retailprice": "double"},
    )
    customer = K.Dataset(
        "customer", dealt(table(spark, sf, "customer"), "c_custkey"), "c_custkey", [SEGMENT], [("{{ c_name }}", "context"), ("{{ c_mktsegment }}", "answer")],
        [("c_name", "{{ context[0] }}"), ("c_mktsegment", "{{ options[0] if options else 'none' }}")],
        {"context": 1, "question": 0, "options": 0}, {"context": 1, "question": 1},
    )
    orders = K.Dataset("orders", dealt(table(spark, sf, "orders"), "o_orderkey"), "o_orderkey", [STATUS, URGENCY])
    return [part, customer, orders]


RING_SQL = f"""with r as ({RENDER_ALL_SQL}), p as (select 'part' as dataset, prompt, p_partkey as id, context || ' ' || target as text from r),
 h as (select *, row_number() over (partition by dataset, prompt order by {hashed(11, 'id')}, id) - 1 as pos, count(*) over (partition by dataset, prompt) as n from p)"""


@query(
    "d03_pair_positive",
    RING_SQL + " select a.dataset, a.prompt, a.id, b.id as pos_id, a.text as query, b.text as pos_context from h a join h b on a.dataset = b.dataset and a.prompt = b.prompt and b.pos = (a.pos + 1) % a.n",
)
def pair_positive(spark, sf):
    # the pool is read for its ids and twice for its texts
    pool = materialize(K.rendered_pool(datasets(spark, sf)[:1]).drop("hash"))
    return K.pair_positive(pool, 11)


@query(
    "d09_convertible",
    """with t as (select p_brand as target, max(p_size) % 3 as nc, min(p_size) % 2 as nq, count(*) % 4 as no from part group by 1),
    s as (select p_brand as source, count(distinct p_type) % 4 as c, max(p_size) % 2 as q, min(p_size) % 5 as o from part group by 1)
    select target, source from t join s on target <> source and c >= nc and q >= nq and o >= no""",
)
def convertible(spark, sf):
    p = parts(spark, sf)
    targets = p.groupBy(F.col("p_brand").alias("target")).agg((F.max("p_size") % 3).alias("need_context"), (F.min("p_size") % 2).alias("need_question"), (F.count(F.lit(1)) % 4).alias("need_options"))
    sources = p.groupBy(F.col("p_brand").alias("source")).agg((F.count_distinct("p_type") % 4).alias("context"), (F.max("p_size") % 2).alias("question"), (F.min("p_size") % 5).alias("options"))
    return P.convertible(targets, sources)


def _drawn(out):
    size = F.size("negatives").alias("n")
    distinct = F.size(F.array_distinct(F.transform("negatives", lambda x: x["text"]))).alias("n_distinct")
    own = F.exists("negatives", lambda x: F.startswith(x["label"], F.concat("dataset", F.lit("-")))).cast("int").alias("own")
    return out.select("dataset", "prompt", "id", size, distinct, own)


@query("g08_easy_negatives")
def easy(spark, sf):
    pool = materialize(K.rendered_pool(datasets(spark, sf)).drop("hash"))
    return _drawn(K.easy_negatives(pool, pool, 4, 42))


@query("g09_hard_negatives")
def hard(spark, sf):
    sets = datasets(spark, sf)
    pool = materialize(K.rendered_pool(sets))
    return _drawn(K.hard_negatives(pool, sets, 3, 42))


@query("g10_contrastive_examples")
def contrastive(spark, sf):
    out = K.contrastive_examples(datasets(spark, sf), 4, 2, 200, 50)
    size = lambda c: F.size(c).cast("long").alias(c)
    return out.select("dataset", "prompt", "id", "split", F.md5("query").alias("query"), F.md5("pos_context").alias("positive"), size("easy_neg_contexts"), size("hard_neg_contexts"), F.col("hard_fell_back").cast("int").alias("fell_back"))


@query(
    "g04_cap_per_prompt",
    f"""with r as ({RENDER_ALL_SQL}), h as (select prompt, p_partkey as id, row_number() over (partition by prompt order by {hashed(9, 'p_partkey')}, p_partkey) as r from r)
    select 'part' as dataset, prompt, id, case when r <= 100 then 'train' else 'valid' end as split from h where r <= 130""",
)
def cap(spark, sf):
    pool = materialize(K.rendered_pool(datasets(spark, sf)[:1]).select("dataset", "prompt", "id"))
    return K.cap_per_prompt(pool, 100, 30, 9)


@query(
    "h06_merge_prompts",
    f"""with r as ({RENDER_ALL_SQL}) select case when p_partkey % 10 = 0 then 'valid' else 'train' end as split, prompt, count(*)::bigint as n from r group by all""",
)
def merge_prompts(spark, sf):
    import uuid

    from corpusloom.session import checkpoint_root
    from corpusloom.sources.writers import write_records

    out = P.render_all(parts(spark, sf), [SIZE, KIND, PRICE], "p_partkey").drop("options")
    split = F.when(F.col("p_partkey") % 10 == 0, "valid").otherwise("train")
    path = f"{checkpoint_root(spark)}/prompts-{uuid.uuid4().hex}"
    write_records(out.withColumn("dataset", F.lit("part")).withColumn("split", split), path)
    back = spark.read.schema("p_partkey long, context string, target string, dataset string, prompt string, split string").json(path)
    return back.groupBy("split", "prompt").agg(F.count(F.lit(1)).alias("n"))


@query("g01_shuffle", f"select item_id, md5(text) as digest, (row_number() over (order by {hashed(4, 'item_id')}, item_id))::bigint as place from benchmark")
def shuffled(spark, sf):
    from corpusloom.ids import shuffled_ids

    rows = table(spark, sf, "benchmark").select("item_id", F.md5("text").alias("digest"))
    return shuffled_ids(rows, 4, "item_id", "place").withColumn("place", F.col("place") + 1)

