"""Queries: readers and sinks. Each writes what it reads under the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import metrics as M
from corpusloom.plans.registry import query, strip, table, toks, wide
from corpusloom.session import checkpoint_root
from corpusloom.sources import catalog, readers, writers


def fresh(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "a01_read_blankline_docs",
    f"select md5(replace({strip('text')}, chr(10), '<@x(x!>')) as digest, count(*)::bigint as n from (select regexp_replace(text, chr(10) || chr(10) || '+', chr(10), 'g') as text from documents) where {strip('text')} <> '' group by 1",
)
def blankline(spark, sf):
    path = fresh(spark, "blob")
    docs = wide(spark, sf, "documents", "text").select(F.regexp_replace("text", "\n\n+", "\n").alias("value"))
    # two line breaks after every document make one blob per part file
    docs.write.option("lineSep", "\n\n").text(path)
    out = readers.read_blankline_docs(spark, path)
    return out.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("a02_read_docs", "select md5(text) as digest, length(text)::bigint as n_chars, count(*)::bigint as n from documents group by 1, 2")
def read_docs(spark, sf):
    path = fresh(spark, "docs")
    writers.write_docs(wide(spark, sf, "documents", "text"), path)
    out = readers.read_docs(spark, path)
    return out.groupBy(F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


@query("a03_newline_marks", "select doc_id, md5(replace(text, chr(10), '<@x(x!>')) as encoded, md5(text) as decoded from documents")
def marks(spark, sf):
    d = wide(spark, sf, "documents", "doc_id", "text").withColumn("e", T.encode_newlines("text"))
    return d.select("doc_id", F.md5("e").alias("encoded"), F.md5(T.decode_newlines("e")).alias("decoded"))


@query("a04_read_records", "select conv_id, turn, role, md5(text) as digest from conversations")
def records(spark, sf):
    path = fresh(spark, "records")
    writers.write_records(table(spark, sf, "conversations"), path, ["role"])
    out = readers.read_records(spark, path, "conv_id long, turn long, text string, role string")
    return out.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("a05_write_records", "select l_returnflag as dataset, l_linestatus as prompt, case when l_linenumber = 1 then 'valid' else 'train' end as split, count(*)::bigint as n from lineitem group by all")
def write_records(spark, sf):
    path = fresh(spark, "split")
    rows = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("prompt"), F.when(F.col("l_linenumber") == 1, "valid").otherwise("train").alias("split"), "l_orderkey"
    )
    writers.write_records(rows, path)
    back = readers.read_records(spark, path, "l_orderkey long, dataset string, prompt string, split string")
    return back.groupBy("dataset", "prompt", "split").agg(F.count(F.lit(1)).alias("n"))


@query("a06_write_sharded_json", "select count(*)::bigint as n, sum(o_orderkey)::bigint as total, 1 as small_files from orders")
def sharded(spark, sf):
    path = fresh(spark, "shards")
    writers.write_sharded_json(table(spark, sf, "orders", "o_orderkey"), path, 1000)
    back = spark.read.schema("o_orderkey long").json(path).select("o_orderkey", F.col("_metadata.file_name").alias("f"))
    per_file = back.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))
    return per_file.agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.min((F.col("n") <= 1000).cast("int")).alias("small_files"))


@query("a07_sequences", f"select doc_id as seq_id, len({toks('text')})::bigint as n_tokens, coalesce(list_sum(list_transform({toks('text')}, lambda t: length(t))), 0)::bigint as total from documents")
def sequences(spark, sf):
    path = fresh(spark, "seqs")
    rows = wide(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("seq_id"), F.transform(T.regex_tokens("text"), lambda t: F.length(t)).alias("tokens"))
    writers.write_sequences(rows, path, vocab_size=50_257)
    out = readers.read_sequences(spark, path)
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("seq_id", F.col("n_tokens").cast("long").alias("n_tokens"), total.alias("total"))


@query(
    "a08_read_shards",
    """with s as (select p_partkey % 3 as shard, p_partkey, row_number() over (partition by p_partkey % 3 order by p_partkey) - 1 as id from part), c as (select shard, count(*) as n from s group by 1),
    o as (select a.shard, coalesce(sum(b.n), 0) as off from c a left join c b on b.shard < a.shard group by 1) select shard::bigint as shard, (id + off)::bigint as seq_id, p_partkey from s join o using (shard)""",
)
def shards(spark, sf):
    from corpusloom.ids import dense_ids

    paths = []
    for i in range(3):
        path = fresh(spark, f"part{i}")
        rows = table(spark, sf, "part", "p_partkey").filter(F.col("p_partkey") % 3 == i)
        dense_ids(rows, "p_partkey", "seq_id").write.parquet(path)
        paths.append(path)
    out = readers.read_shards(spark, paths)
    return out.withColumn("shard", F.col("shard").cast("long"))


@query("a09_merge_sequences", "select c_custkey as seq_id, 0::bigint as part, c_custkey as v from customer union all select s_suppkey + (select count(*) from customer), 1::bigint, s_suppkey from supplier")
def merge(spark, sf):
    a = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("seq_id"), F.lit(0).cast("long").alias("part"), F.col("c_custkey").alias("v"))
    b = table(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("seq_id"), F.lit(1).cast("long").alias("part"), F.col("s_suppkey").alias("v"))
    return readers.merge_sequences(a, b)


@query("a10_write_embeddings", "select vec_id, len(embedding)::bigint as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 5) as total from embeddings")
def embeddings(spark, sf):
    path = fresh(spark, "vecs")
    writers.write_embeddings(table(spark, sf, "embeddings", "vec_id", "embedding"), path)
    out = spark.read.schema("vec_id long, embedding array<float>").parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query("a11_read_delimited", "select p_partkey, p_name, p_brand, p_retailprice from part")
def delimited(spark, sf):
    path = fresh(spark, "tsv")
    table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_retailprice").write.option("sep", "\t").csv(path)
    return readers.read_delimited(spark, path, "p_partkey long, p_name string, p_brand string, p_retailprice double")


@query(
    "a12_read_conll",
    """with w as (select l_orderkey as q, l_linenumber as i, 'w' || min(l_partkey) as w, min(l_returnflag) as l from lineitem group by 1, 2)
    select md5(string_agg(w || ' ' || l, ',' order by i)) as digest, count(*)::bigint as n from w group by q""",
)
def conll(spark, sf):
    path = fresh(spark, "conll")
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    words = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    # an order has at most seven line numbers
    lists = words.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p", "f"))).alias("a"))
    sents = lists.select(
        F.lit("orders").alias("file"), F.col("l_orderkey").alias("sent"),
        F.transform("a", lambda s: F.concat(F.lit("w"), s["p"].cast("string"))).alias("words"), F.transform("a", lambda s: s["f"]).alias("labels"),
    )
    writers.write_conll(sents, path)
    out = readers.read_conll(spark, path)
    body = F.array_join(F.zip_with("words", "labels", lambda w, l: F.concat_ws(" ", w, l)), ",")
    return out.select(F.md5(body).alias("digest"), F.size("words").cast("long").alias("n"))


@query("a13_read_parallel", "select md5(replace(text, chr(10), ' ')) as src, role as tgt, count(*)::bigint as n from conversations group by 1, 2")
def parallel(spark, sf):
    path = fresh(spark, "parallel")
    rows = table(spark, sf, "conversations").select("text", "role", F.lit("validation").alias("split"), (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("k"))
    writers.write_parallel(rows, path, "text", "role", "k")
    out = readers.read_parallel(spark, f"{path}/text/split=val", f"{path}/role/split=val")
    return out.groupBy(F.md5("src").alias("src"), "tgt").agg(F.count(F.lit(1)).alias("n"))


@query("a14_read_tasks", "select role as task, count(*)::bigint as n, count(*)::bigint as n_positive from conversations group by 1")
def tasks(spark, sf):
    path = fresh(spark, "tasks")
    rows = table(spark, sf, "conversations")
    inst = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("input"), F.array("role").alias("output"))
    files = rows.groupBy("role").agg(F.collect_list(inst).alias("Instances"), F.collect_list(F.struct(F.col("text").alias("input"), F.col("role").alias("output"))).alias("Positive Examples"))
    files = files.withColumn("Definition", F.array(F.concat(F.lit("Say something as "), "role")))
    files.repartition("role").write.partitionBy("role").json(path)
    out = readers.read_tasks(spark, path)
    named = out.withColumn("task", F.regexp_extract("definition", r"as (\w+)$", 1))
    return named.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("positives")).cast("long").alias("n_positive"))


ARTICLES = "a as (select o_orderkey as id, o_orderpriority as article, [o_orderstatus, o_orderpriority] as questions, [['a', 'b', 'c', 'd'], ['e', 'f', 'g', 'h']] as options, [chr((65 + o_orderkey % 4)::int), chr((65 + o_custkey % 4)::int)] as answers from orders)"


@query("a15_read_multi_question", f"with {ARTICLES} select id, (generate_subscripts(questions, 1) - 1)::bigint as pos, article, unnest(questions) as question, array_to_string(unnest(options), '') as options, (ascii(unnest(answers)) - 65)::bigint as label from a")
def multi(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    letter = lambda c: F.char(65 + F.col(c) % 4)
    arts = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("article"), F.array("o_orderstatus", "o_orderpriority").alias("questions"),
        F.array(F.array(*[F.lit(x) for x in "abcd"]), F.array(*[F.lit(x) for x in "efgh"])).alias("options"), F.array(letter("o_orderkey"), letter("o_custkey")).alias("answers"),
    )
    out = readers.multi_questions(arts)
    return out.select("id", F.col("pos").cast("long").alias("pos"), "article", "question", F.array_join("options", "").alias("options"), F.col("label").cast("long").alias("label"))


def _choices(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    key = F.when(F.col("o_custkey") % 2 == 0, F.char(65 + F.col("o_orderkey") % 4)).otherwise((1 + F.col("o_orderkey") % 4).cast("string"))
    return o.select("o_orderkey", F.transform(F.sequence(F.lit(1).cast("long"), 2 + F.col("o_orderkey") % 5), lambda x: x).alias("choices"), key.alias("answer_key"))


@query("a16_filter_four_choice", "select o_orderkey, (o_orderkey % 4)::bigint as label from orders where 2 + o_orderkey % 5 = 4")
def four(spark, sf):
    return readers.four_choice(_choices(spark, sf)).select("o_orderkey", F.col("label").cast("long").alias("label"))


@query("a16_choice_counts", "select case 2 + o_orderkey % 5 when 3 then 'three' when 4 then 'four' when 5 then 'five' else 'other' end as kind, count(*)::bigint as n from orders group by 1")
def choice_counts(spark, sf):
    return readers.choice_counts(_choices(spark, sf))


@query("a17_relevance_records", "select 'Order ' || o_orderkey || '?' as question, o_orderpriority || chr(9) || o_orderstatus as titles from orders")
def relevance(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    title = lambda c: F.struct(F.col(c).alias("title"), F.lit("text").alias("text"))
    rows = o.select(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("question"), F.array(title("o_orderpriority"), title("o_orderstatus")).alias("positive_ctxs"))
    return readers.relevance_records(rows)


@query("a18_read_predictions", "select conv_id || '-' || turn as id, md5(text) as digest from conversations")
def preds(spark, sf):
    path = fresh(spark, "preds")
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("prediction"), "role")
    c.write.partitionBy("role").json(path)
    return readers.read_predictions(spark, f"{path}/role=*").select("id", F.md5("prediction").alias("digest"))


@query(
    "a19_load_templates",
    "select p_brand as dataset, p_type as subset, count(*)::bigint as n from (select distinct p_brand, p_type, p_name from part) group by 1, 2",
)
def templates(spark, sf):
    root = fresh(spark, "catalog")
    p = table(spark, sf, "part", "p_brand", "p_type", "p_name").distinct()
    entry = F.concat(
        F.lit("  "), F.md5(F.concat_ws("/", "p_brand", "p_type", "p_name")), F.lit(": !Template\n    name: "), "p_name",
        F.lit("\n    jinja: \"About {{name}} ||| {{label}}\"\n    metadata: !TemplateMetadata\n      metrics:\n      - Accuracy\n"),
    )
    files = p.groupBy("p_brand", "p_type").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("_b"))
    body = F.concat(F.lit("dataset: "), "p_brand", F.lit("\ntemplates:\n"), "_b").alias("value")
    # one YAML file per folder, as a catalog has them
    files.select("p_brand", "p_type", body).repartition("p_brand", "p_type").write.partitionBy("p_brand", "p_type").text(root)
    out = catalog.load_templates(spark, root, pattern="*.txt")
    name = lambda c: F.url_decode(F.regexp_extract(c, "=(.*)$", 1))
    return out.groupBy(name("dataset").alias("dataset"), name("subset").alias("subset")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a20_write_eval_report",
    """select role as dataset, count(*)::bigint as n_lines, sum(length(role || chr(9) || chr(9) || length(text)))::bigint as n_chars from conversations group by role""",
)
def report(spark, sf):
    c = table(spark, sf, "conversations")
    detail = c.select(F.col("role").alias("dataset"), (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), F.col("role").alias("label"), F.length("text").cast("string").alias("prediction"))
    avgs = c.groupBy(F.col("role").alias("dataset")).agg(F.avg(F.length("text")).alias("value"), F.lit(0.0).alias("loss"), F.lit(0.0).alias("tot_loss"))
    path = fresh(spark, "report")
    writers.write_report(M.eval_report(avgs, detail), path)
    lines = readers.with_line_numbers(spark, f"{path}/dataset=*").withColumn("dataset", F.regexp_extract("file", "dataset=([^/]+)", 1))
    detail_lines = lines.filter(F.contains("value", F.lit("\t")))
    return detail_lines.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query("a21_read_lines", rf"select l as text, count(*)::bigint as n from (select {strip('unnest(string_split(text, chr(10)))')} as l from benchmark) where l <> '' group by 1")
def lines(spark, sf):
    path = fresh(spark, "lines")
    table(spark, sf, "benchmark", "text").select(F.concat(F.lit("  "), "text", F.lit("\n \n")).alias("value")).write.text(path)
    return readers.read_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


STORY = f"""l as (select doc_id, list_filter(list_transform(string_split(text || chr(10) || '@highlight' || chr(10) || lang || chr(10) || ' @highlight' || chr(10) || source, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') as l from documents),
 f as (select doc_id, list_transform(l, lambda x: case when starts_with(x, '@highlight') or right(x, 1) in ('.', '!', '?', '''', '`', '"', '’', ')') then x else x || '.' end) as l from l)"""


@query(
    "a22_read_stories",
    f"with {STORY} select md5(array_to_string(list_slice(l, 1, list_position(l, '@highlight') - 1), chr(10))) as story, array_to_string(list_filter(list_slice(l, list_position(l, '@highlight') + 1, len(l)), lambda x: not starts_with(x, '@highlight')), '|') as summary from f",
)
def stories(spark, sf):
    d = wide(spark, sf, "documents", "doc_id", "text", "lang", "source")
    raw = d.select(F.concat("text", F.lit("\n@highlight\n"), "lang", F.lit("\n @highlight\n"), "source").alias("value"))
    path = fresh(spark, "stories")
    out = readers.read_stories(spark, writers.write_stories(raw, path))
    return out.select(F.md5(F.array_join("story_lines", "\n")).alias("story"), F.array_join("summary_lines", "|").alias("summary"))


@query("a23_write_parallel", "select case when o_orderkey % 5 = 0 then 'val' else 'train' end as split, o_orderpriority as src, o_orderstatus as tgt, count(*)::bigint as n from orders group by all")
def write_parallel(spark, sf):
    path = fresh(spark, "wmt")
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").withColumn("split", F.when(F.col("o_orderkey") % 5 == 0, "validation").otherwise("train"))
    writers.write_parallel(o, path, "o_orderpriority", "o_orderstatus", "o_orderkey")
    parts = [readers.read_parallel(spark, f"{path}/o_orderpriority/split={s}", f"{path}/o_orderstatus/split={s}").select(F.lit(s).alias("split"), "src", "tgt") for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).groupBy("split", "src", "tgt").agg(F.count(F.lit(1)).alias("n"))
