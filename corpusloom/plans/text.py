"""Queries: filters, segmentation and text normalisation (documents, pages, part)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.normalizers import basic_text_normalize
from corpusloom.operators import corpus as C
from corpusloom.operators import segment as S
from corpusloom.plans.registry import query, strip, table, toks, wide
from corpusloom.sources.html import html_nodes


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return wide(spark, sf, "documents", "doc_id", "text")


def _length_and_hash(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    return df.select(*(keys or ("doc_id",)), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


@query("b01_drop_short_docs", "select doc_id, length(text)::bigint as n_chars from documents where length(text) >= 20")
def drop_short(spark, sf):
    return S.drop_short_docs(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", F.length("text").cast("long").alias("n_chars"))


SEGMENT_SQL = rf"""
with recursive lines as (
  select doc_id, row_number() over (partition by doc_id order by pos) as i, line,
         len({toks('line')})::bigint as n, right(line, 1) in (':', '?', '：', '？') as glue
  from (select doc_id, generate_subscripts(parts, 1) as pos, unnest(list_transform(parts, lambda x: {strip('x')})) as line
        from (select doc_id, string_split(text, chr(10)) as parts from documents where length(text) >= 20))
  where line <> ''
), fold as (
  select doc_id, i, line, n as cnt, glue, 0 as ord from lines where i = 1
  union all
  select l.doc_id, l.i, l.line,
         case when f.cnt + l.n < 128 or f.glue then f.cnt + l.n else l.n end,
         l.glue,
         case when f.cnt + l.n < 128 or f.glue then f.ord else f.ord + 1 end
  from fold f join lines l on l.doc_id = f.doc_id and l.i = f.i + 1
), units as (
  select doc_id, ord, string_agg(line, chr(10) order by i) as text from fold group by doc_id, ord
)
"""


def paragraphs(spark: SparkSession, sf: str, budget: int = 128) -> DataFrame:
    return S.segment_paragraphs(S.drop_short_docs(docs(spark, sf)), budget)


@query("b02_segment_paragraphs", SEGMENT_SQL + "select doc_id, ord::bigint as ord, length(text)::bigint as n_chars, md5(text) as digest from units")
def segment(spark, sf):
    return _length_and_hash(paragraphs(spark, sf).withColumn("ord", F.col("ord").cast("long")), "text", "doc_id", "ord")


@query(
    "b03_segment_lines",
    rf"""select doc_id, (generate_subscripts(p, 1) - 1)::bigint as ord, md5(unnest(list_transform(p, lambda x: {strip('x')}))) as digest
    from (select doc_id, string_split(text, chr(10)) as p from documents)""",
)
def lines(spark, sf):
    return S.segment_lines(docs(spark, sf)).select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


@query("b04_flatten_whitespace", f"select doc_id, md5({strip('replace(text, chr(10), chr(32))')}) as digest from documents")
def flatten(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.flatten_whitespace("text")).alias("digest"))


@query(
    "b05_collapse_newlines",
    rf"select doc_id, md5({strip(chr(114) + 'egexp_replace(text, chr(10) || ' + chr(39) + '+' + chr(39) + ', chr(10), ' + chr(39) + 'g' + chr(39) + ')')}) as digest from documents",
)
def collapse(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.collapse_newlines("text")).alias("digest"))


ONE_LINE = r"regexp_replace({}, '\s+', ' ', 'g')"


@query(
    "b06_clean_prompt",
    rf"""select l.doc_id, md5({ONE_LINE.format(strip('d.text'))}) as context, {ONE_LINE.format("' ' || " + strip("case when l.quality = 1 then ' good ' else ' poor' end"))} as target
    from labels l join documents d using (doc_id)""",
)
def clean_prompt(spark, sf):
    rows = table(spark, sf, "labels").join(docs(spark, sf), "doc_id")
    context, target = T.clean_prompt("text", F.when(F.col("quality") == 1, " good ").otherwise(" poor"))
    return rows.select("doc_id", F.md5(context).alias("context"), target.alias("target"))


@query("b07_word_limit", "select doc_id from documents where len(string_split(text, ' ')) <= 256")
def word_limit(spark, sf):
    return docs(spark, sf).filter(T.within_words("text")).select("doc_id")


@query(
    "b08_prompt_limits",
    f"""select doc_id from documents where length(text) + length(lang) <= 5000
        and len({toks('text')}) + len({toks('lang')}) <= 256""",
)
def prompt_limits(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text", "lang")
    n = T.n_tokens("text") + T.n_tokens("lang")
    return rows.filter(T.prompt_fits(F.col("text"), F.col("lang"), n)).select("doc_id")


@query("b09_normalize_columns", "select l_orderkey, count(*)::bigint as line_count from lineitem group by 1")
def normalize_columns(spark, sf):
    dashed = table(spark, sf, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("line-count"))
    return dashed.toDF(*[c.replace("-", "_") for c in dashed.columns])


@query("b10_content_hash", r"select doc_id, md5(regexp_replace(text, '\s+', '', 'g')) as hash from documents")
def content_hash(spark, sf):
    return docs(spark, sf).select("doc_id", T.content_hash("text").alias("hash"))


LINES = r"string_split(regexp_replace(text, '\n$', ''), chr(10))"


@query(
    "b11_line_stats",
    f"""select doc_id, round(list_avg(list_transform({LINES}, lambda x: length(x))), 6) as line_mean,
        list_max(list_transform({LINES}, lambda x: length(x)))::bigint as line_max from documents""",
)
def line_stats(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(T.line_mean("text"), 6).alias("line_mean"), T.line_max("text").alias("line_max"))


@query(
    "b12_alnum_fraction",
    r"select doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text), 6) as fraction from documents",
)
def alnum(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(T.alnum_fraction("text"), 6).alias("fraction"))


@query("b13_chars_per_token", f"select doc_id, case when len({toks('text')}) > 0 then round(length(text) / len({toks('text')}), 6) end as ratio from documents")
def chars_per_token(spark, sf):
    ratio = F.when(T.n_tokens("text") > 0, T.chars_per_token("text"))
    return docs(spark, sf).select("doc_id", F.round(ratio, 6).alias("ratio"))


HEAD = "lower(array_to_string(list_slice(string_split({}, chr(10)), 1, 5), chr(10)))"
# the tables hold no code, so the four code tests run over page sources, which do
HAS = lambda expr, words: "(" + " or ".join(f"contains({expr}, '{w}')" for w in words) + ")"
AUTO_SQL = HAS(HEAD.format("{0}"), T.AUTOGENERATED_WORDS)
COUNT = "len(regexp_extract_all(lower({0}), '{1}'))"
NEWLINES = "(length({0}) - length(replace({0}, chr(10), '')))"
CONFIG_SQL = (
    "(" + HAS(HEAD.format("{0}"), T.CONFIG_TEST_WORDS)
    + " or len(regexp_extract_all(lower({0}), 'config')) > floor(0.05 * " + NEWLINES + ")"
    + " or len(regexp_extract_all(lower({0}), 'test')) > floor(0.05 * " + NEWLINES + "))"
)
WORDS_SQL = "not " + HAS("lower({0})", T.CODE_WORDS)
FEW_SQL = "(length({0}) - length(replace({0}, '=', '')) <= 4)"


@query("b14_is_autogenerated", f"select page_id, {AUTO_SQL.format('html')}::int as flag from pages")
def autogenerated(spark, sf):
    return wide(spark, sf, "pages", "page_id", "html").select("page_id", T.is_autogenerated("html").cast("int").alias("flag"))


@query(
    "b15_is_config_or_test",
    f"select doc_id as id, {CONFIG_SQL.format('text')}::int as flag from documents union all select -1 - page_id, {CONFIG_SQL.format('html')}::int from pages",
)
def config_or_test(spark, sf):
    a = docs(spark, sf).select(F.col("doc_id").alias("id"), T.is_config_or_test("text").cast("int").alias("flag"))
    b = wide(spark, sf, "pages", "page_id", "html").select((-1 - F.col("page_id")).alias("id"), T.is_config_or_test("html").cast("int").alias("flag"))
    return a.unionByName(b)


@query("b16_has_no_keywords", f"select doc_id, ({WORDS_SQL.format('text')})::int as flag from documents")
def no_keywords(spark, sf):
    return docs(spark, sf).select("doc_id", T.has_no_code_words("text").cast("int").alias("flag"))


@query("b17_has_few_assignments", f"select page_id, {FEW_SQL.format('html')}::int as flag from pages")
def few_assignments(spark, sf):
    return wide(spark, sf, "pages", "page_id", "html").select("page_id", T.has_few_assignments("html").cast("int").alias("flag"))


def _quality_sql(share: int) -> str:
    random = f" or {CONFIG_SQL.format('html')} or {WORDS_SQL.format('html')}" if share else ""
    plines = LINES.replace("text", "html")
    return rf"""select page_id from pages
    where page_id in (select min(page_id) from pages group by md5(regexp_replace(html, '\s+', '', 'g')))
      and not ({AUTO_SQL.format('html')} or list_max(list_transform({plines}, lambda x: length(x))) > 100000
        or list_avg(list_transform({plines}, lambda x: length(x))) > 100000
        or length(regexp_replace(html, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(html) < 0.25
        or length(html) / len({toks('html')}) < 1.5 {random} or {FEW_SQL.format('html')})"""


@query("b18_quality_filter_never", _quality_sql(0))
def quality_never(spark, sf):
    limits = C.QualityLimits(line_max=100_000, line_mean=100_000, drop_share=0.0)
    return C.quality_filter(wide(spark, sf, "pages", "page_id", "html"), "html", "page_id", limits).select("page_id")


@query("b18_quality_filter_always", _quality_sql(1))
def quality_always(spark, sf):
    limits = C.QualityLimits(line_max=100_000, line_mean=100_000, drop_share=1.1)
    return C.quality_filter(wide(spark, sf, "pages", "page_id", "html"), "html", "page_id", limits).select("page_id")


@query("b18_quality_filter_seeded")
def quality_seeded(spark, sf):
    limits = C.QualityLimits(line_max=100_000, line_mean=100_000)
    return C.quality_filter(wide(spark, sf, "pages", "page_id", "html"), "html", "page_id", limits, seed=7).select("page_id")


@query("b19_drop_short_sequences", f"select doc_id, len({toks('text')})::bigint as n from documents where len({toks('text')}) > 11")
def short_sequences(spark, sf):
    rows = docs(spark, sf).select("doc_id", T.regex_tokens("text").alias("tokens"))
    return C.drop_short_sequences(rows).select("doc_id", F.size("tokens").cast("long").alias("n"))


@query(
    "b19_drop_unknown",
    f"""select doc_id from (select doc_id, list_transform({toks('text')}, lambda t: case when length(t) > 8 then 0 else length(t) end) as ids from documents)
    where len(list_filter(ids, lambda x: x = 0)) < 0.5 * len(ids)""",
)
def unknown(spark, sf):
    ids = F.transform(T.regex_tokens("text"), lambda t: F.when(F.length(t) > 8, 0).otherwise(F.length(t)))
    rows = docs(spark, sf).select("doc_id", ids.alias("tokens"))
    return C.drop_unknown(rows, 0).select("doc_id")


PUNCT = r"[!-/:-@\[-`{-~]"


EDGE = r"[^\p{L}\p{N}_]"
# twice, because neighbouring articles share their border
ARTICLES = (
    rf"regexp_replace(regexp_replace(@, '(^|{EDGE})(a|an|the)({EDGE}|$)', '\1 \3', 'g'), '(^|{EDGE})(a|an|the)({EDGE}|$)', '\1 \3', 'g')"
)


def normal_sql(expr: str, articles: bool = False) -> str:
    bare = f"regexp_replace(lower({expr}), '{PUNCT}', '', 'g')"
    bare = ARTICLES.replace("@", bare) if articles else bare
    return strip(rf"regexp_replace({bare}, '\s+', ' ', 'g')")


@query(
    "b20_normalize_answer",
    f"select doc_id, md5({normal_sql('text')}) as plain, md5({normal_sql('text', True)}) as no_articles from documents",
)
def normalize_answer(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.normalize_answer("text")).alias("plain"), F.md5(T.normalize_answer("text", True)).alias("no_articles"))


@query(
    "b21_normalize_transcript",
    r"""select doc_id, md5(array_to_string(string_split(array_to_string(string_split(array_to_string(string_split(array_to_string(string_split(
      regexp_replace(lower(text), '[,?.!\-;:"“%‘”�—’…–]', '', 'g'), chr(10) || chr(10)), ' '), chr(10)), ' '), '   '), ' '), '  '), ' ')) as digest from documents""",
)
def normalize_transcript(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.normalize_transcript("text")).alias("digest"))


@query("b22_basic_text_normalize")
def basic_normalize(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(basic_text_normalize("text", diacritics=True)).alias("digest"))


@query(
    "b24_parse_number",
    r"""with forms as (
      select l_orderkey, l_linenumber, l_extendedprice as price, unnest([
        cast(l_quantity as varchar),
        cast(cast(floor(l_extendedprice) as bigint) as varchar),
        case when l_extendedprice >= 1000 then cast(cast(floor(l_extendedprice / 1000) as bigint) as varchar) || ',' || lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as varchar), 3, '0') || '.5' else '7,25' end,
        cast(l_linenumber as varchar) || ',5', '1.000.' || cast(l_linenumber as varchar), l_returnflag]) as txt,
        unnest(['q', 'p', 't', 'c', 'd', 'n']) as form from lineitem),
    cleaned as (select *, case
        when contains(txt, ',') and (contains(txt, '.') or len(list_filter(string_split(txt, ','), lambda x: length(x) = 3)) > 0) then replace(txt, ',', '')
        when length(txt) - length(replace(txt, ',', '')) = 1 then replace(txt, ',', '.')
        when length(txt) - length(replace(txt, '.', '')) > 1 then replace(txt, '.', '')
        else txt end as plain from forms)
    select form, count(*)::bigint as n, count(try_cast(plain as double))::bigint as n_numbers, round(coalesce(sum(try_cast(plain as double)), 0), 2) as total from cleaned group by form""",
)
def parse_number(spark, sf):
    rows = table(spark, sf, "lineitem", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    whole = F.floor("l_extendedprice").cast("long")
    thousands = F.concat(F.floor(F.col("l_extendedprice") / 1000).cast("long").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(".5"))
    forms = {
        "q": F.col("l_quantity").cast("string"),
        "p": whole.cast("string"),
        "t": F.when(F.col("l_extendedprice") >= 1000, thousands).otherwise("7,25"),
        "c": F.concat(F.col("l_linenumber").cast("string"), F.lit(",5")),
        "d": F.concat(F.lit("1.000."), F.col("l_linenumber").cast("string")),
        "n": F.col("l_returnflag"),
    }
    listed = F.array(*[F.struct(F.lit(k).alias("form"), v.alias("txt")) for k, v in forms.items()])
    out = rows.select(F.explode(listed).alias("f")).select("f.form", T.parse_number("f.txt").alias("v"))
    return out.groupBy("form").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_numbers"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 2).alias("total")
    )


@query("b25_html_nodes")
def nodes(spark, sf):
    return html_nodes(wide(spark, sf, "pages", "page_id", "html")).select("page_id", "ord", F.md5("text").alias("digest"), "xpath")


@query(
    "b26_drop_html_tokens",
    f"""with d as (select doc_id, {toks('text')} as t from documents),
    f as (select doc_id, t, list_transform(t, lambda x: regexp_matches(x, '^[^A-Za-z0-9_]')) as h, len(t) // 2 as s from d)
    select doc_id, len(list_filter(h, lambda x: not x))::bigint as n_kept,
      (s - len(list_filter(list_slice(h, 1, s), lambda x: x)))::bigint as new_start from f""",
)
def drop_html(spark, sf):
    rows = docs(spark, sf).select("doc_id", T.regex_tokens("text").alias("tokens"))
    flags = F.transform("tokens", lambda x: x.rlike("^[^A-Za-z0-9_]"))
    rows = rows.select("doc_id", "tokens", flags.alias("is_html"), F.floor(F.size("tokens") / 2).cast("int").alias("start"))
    out = S.drop_flagged_tokens(rows)
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_kept"), F.col("start").cast("long").alias("new_start"))


@query(
    "b27_pick_single_answer",
    """with a as (select o_orderkey as id,
        case when o_orderstatus = 'P' then [1] when o_orderpriority like '1%' then [0] else [-1] end as yes_no,
        case when o_orderpriority like '2%' then [o_orderkey % 50] when o_orderpriority like '3%' then [o_orderkey % 50, 3] else [] end as short,
        o_orderkey % 7 as long_start, o_orderkey % 5 as long_end from orders)
    select id, case when list_contains(yes_no, 1) then 'yes' when list_contains(yes_no, 0) then 'no' when len(short) > 0 then 'short' else 'long' end as category,
      (case when list_contains(yes_no, 1) or list_contains(yes_no, 0) then 1 when len(short) > 0 then (len(short) > 1)::int else (long_start = long_end)::int end)::int as remove from a""",
)
def single_answer(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    yes_no = F.when(F.col("o_orderstatus") == "P", F.array(F.lit(1))).when(F.startswith("o_orderpriority", F.lit("1")), F.array(F.lit(0))).otherwise(F.array(F.lit(-1)))
    k = F.col("o_orderkey") % 50
    starts = F.when(F.startswith("o_orderpriority", F.lit("2")), F.array(k)).when(F.startswith("o_orderpriority", F.lit("3")), F.array(k, F.lit(3).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = o.select(
        F.col("o_orderkey").alias("id"), yes_no.alias("yes_no"),
        F.transform(starts, lambda s: F.struct(s.alias("start"), (s + 1).alias("end"))).alias("short"),
        F.struct((F.col("o_orderkey") % 7).alias("start"), (F.col("o_orderkey") % 5).alias("end")).alias("long"),
    )
    return S.pick_single_answer(rows).select("id", "category", F.col("remove").cast("int").alias("remove"))


@query(
    "b28_expand_aliases",
    rf"""with a as (select part.p_partkey as id, [p_name, p_brand || '_' || p_type, upper(p_name)] as given from part),
    b as (select id, list_concat(given, list_concat(
       list_transform(list_filter(given, lambda x: contains(x, ' ')), lambda x: array_to_string(list_slice(string_split(x, ' '), 2, len(string_split(x, ' '))), ' ')),
       list_transform(list_filter(given, lambda x: contains(x, ' ')), lambda x: array_to_string(list_slice(string_split(x, ' '), 1, len(string_split(x, ' ')) - 1), ' ')))) as g from a)
    select id, array_to_string(list_sort(list_distinct(list_transform(g, lambda x: {strip("regexp_replace(regexp_replace(lower(x), '[‘’´`.,_" + chr(92) + "-" + chr(34) + "]', ' ', 'g'), '" + chr(92) + "s+', ' ', 'g')")}))), '|') as aliases from b""",
)
def aliases(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    given = F.array("p_name", F.concat_ws("_", "p_brand", "p_type"), F.upper("p_name"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(T.expand_aliases(given, True)), "|").alias("aliases"))


@query(
    "b29_strip_query_words",
    r"""select conv_id, turn, md5(array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'),
       lambda w: w <> '' and w not in ('how','why','what','where','which','do','does','is','?','eli5','eli5:')), ' ')) as digest from conversations""",
)
def query_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.strip_query_words("text")).alias("digest"))


@query(
    "b30_strip_quotes",
    """select o_orderkey, regexp_replace(regexp_replace(case when o_orderstatus = 'F' then '"' || o_orderpriority || '"' else o_orderpriority || '"' end, '^"', ''), '"$', '') as title from orders""",
)
def quotes(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    title = F.concat(F.when(F.col("o_orderstatus") == "F", '"').otherwise(""), "o_orderpriority", F.lit('"'))
    return o.select("o_orderkey", T.strip_quotes(title).alias("title"))


@query("b31_match_tokens", f"select p_partkey, array_to_string({toks('lower(p_name || chr(58) || p_brand)')}, ' ') as words from part")
def match(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", F.array_join(T.match_tokens(F.concat_ws(":", "p_name", "p_brand")), " ").alias("words"))
