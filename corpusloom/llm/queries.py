"""Registered queries of the subpackage and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    arc_convert,
    bitplane,
    curriculum,
    filter_audit,
    html_suffix,
    infill,
    jaccard_voronoi,
    one_bit_ann,
    prefix_bpe,
    secrets,
    url_rules,
    voronoi_knn,
    weak_toxicity,
)
from corpusloom.llm.vectors import finite
from corpusloom.llm.files import shared_folder
from corpusloom.session import load, load_numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
OP1_SQL = rf"""
with docs as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
rules(kind, place, p) as (values ('assign', 1, '{ASSIGN}'), ('access', 2, 'AKIA[A-Z0-9]+'), ('hex', 3, '[0-9a-f]+')),
hits as (
  select r, kind, place, unnest(generate_series(1, len(h))) i, h, v, g from (
    select r, kind, place, regexp_extract_all(t, p) h,
           case when kind = 'assign' then regexp_extract_all(t, p, 2) else regexp_extract_all(t, p) end v,
           string_split_regex(t, p) g
    from docs, rules)),
spans as (
  select r, kind, place, h[i] hit, v[i] val,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) s
  from hits where length(v[i]) >= case kind when 'assign' then 8 when 'access' then 16 else 32 end),
found as (
  select r, count(*) filter (kind = 'assign') a, count(*) filter (kind = 'access') c, count(*) filter (kind = 'hex') x,
         string_agg(kind || ':' || s::bigint || ':' || (s + length(hit))::bigint, ',' order by s, place) spans
  from spans group by r)
select doc_id, coalesce(a, 0) n_assign, coalesce(c, 0) n_access, coalesce(x, 0) n_hex,
       sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans
from docs left join found using (r)
"""


@query("op1_secret_ledger", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(load(spark, sf_dir, "documents"), shared_folder(spark, "secret-ledger"))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("found"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        secrets.spans_text(F.col("found")).alias("spans"),
    ).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


@query("op2_one_bit_codes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_ann.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP3_SQL = r"""
with bits as (
  select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes,
         list_aggregate(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c:
           substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1)::int + 1, 4)), 'string_agg', '') b
  from pages),
digests as (
  select page_id, payload_bytes, list_aggregate(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(generate_series(1, 5), lambda k:
      substr(b, (5 * i + k)::int, 1)::int * (1 << (5 - k))))::int + 1, 1)), 'string_agg', '') payload_digest
  from bits),
first as (select *, max(page_id) over (partition by payload_digest) m from digests)
select page_id, payload_bytes, payload_digest, case when page_id = m then 'response' else 'revisit' end record_type,
       case when page_id <> m then m end refers_to
from first
"""


@query("op3_arc_to_warc", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = arc_convert.write_arcs(load(spark, sf_dir, "pages"))
    return arc_convert.read_warcs(arc_convert.convert_arcs(arcs, least_bytes=0))


OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id query_id, s.vec_id,
                 list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * s.e[i]))::bigint score
          from v q join v s on q.vec_id % 50 = 0 and q.vec_id <> s.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from pairs)
select query_id, r::int rank, vec_id, score from ranked where r <= 5
"""


@query("op4_voronoi_knn", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").filter(finite(F.col("embedding")))
    whole = vectors.select("vec_id", voronoi_knn.integers(F.col("embedding")).alias("vec"))
    return voronoi_knn.join(whole, F.col("vec_id") % 50 == 0)


@query("op5_host_suffixes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_suffix.extract(load(spark, sf_dir, "pages"), html_suffix.LONG)


OP6_SQL = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
         cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) k
  from documents),
per as (select source, sum(size)::bigint source_size from docs group by source),
named as (
  select *, row_number() over (order by source is null, encode(source)) - 1 turn from per),
weighed as (select *, (turn % 3 + 1)::double w, source_size * 3 cap, source_size * 3 / (turn % 3 + 1)::double ratio from named),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::double
            / (sum(w) over () - coalesce(sum(w) over before, 0)) level
  from weighed window before as (order by ratio, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
final as (select *, max(case when ratio > level then level end) over () lv from levels),
targets as (select source, source_size, turn, case when ratio > level then lv * w else cap::double end target from final),
placed as (
  select d.doc_id, d.size, t.source_size, t.target, t.turn, round(t.target)::bigint goal,
         coalesce(sum(d.size) over (partition by d.source order by k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint at_
  from docs d join targets t on d.source is not distinct from t.source),
counted as (
  select *, case when source_size > 0 then goal // source_size else 0 end rounds,
         (case when turn % 3 = 0 then 3 when turn % 3 = 1 then 1 else 1 end)::double a,
         (case when turn % 3 = 0 then 1 when turn % 3 = 1 then 1 else 3 end)::double b,
         at_ / greatest(target, 1.0) u
  from placed),
taken as (
  select *, (size * rounds + greatest(0, least(size, goal - rounds * source_size - at_)))::bigint taken from counted)
select doc_id, size::bigint size, source_size, target, taken,
       case when taken > 0 then round(case when u * (a + b) / 2 <= (a + (a + b) / 2) / 4
            then 2 * (u * (a + b) / 2) / (a + sqrt(a * a + 2 * (b - a) * (u * (a + b) / 2)))
            else 0.5 + 2 * (u * (a + b) / 2 - (a + (a + b) / 2) / 4)
                 / ((a + b) / 2 + sqrt(((a + b) / 2) * ((a + b) / 2) + 2 * (b - a) * (u * (a + b) / 2 - (a + (a + b) / 2) / 4))) end, 9) end "position"
from taken
"""


@query("op6_curriculum_mix", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mixed(load(spark, sf_dir, "documents")).drop("positions")


@query("op7_bitplane_ids")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return bitplane.read_shards(bitplane.write_shards(documents, public_tokenizers.path("byte_bpe_50k.json")))


OP8_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) end s from words),
firsts as (select min(doc_id) d, s from (select doc_id, list_sort(s) s from sets) group by s),
each as (select d, len(s) n, unnest(s) g from firsts),
shared as (select a.d x, b.d y, any_value(a.n) nx, any_value(b.n) ny, count(*) i from each a join each b on a.g = b.g and a.d < b.d group by 1, 2),
links as (select x, y from shared where 100 * i >= 85 * (nx + ny - i)),
both_ways as (select x, y from links union select y, x from links),
reach(a, b) as (select d, d from firsts union select r.a, l.y from reach r join both_ways l on r.b = l.x),
comp as (select a d, min(b) c from reach group by a)
select s.doc_id, len(s.s)::bigint n_shingles,
       case when len(s.s) = 0 then s.doc_id else c.c end component_id
from (select doc_id, list_sort(s) s from sets) s left join firsts f on f.s = s.s left join comp c on c.d = f.d
"""


@query("op8_jaccard_voronoi", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_voronoi.components(load_numbered(spark, sf_dir, "documents"), row_col="row")
    return found.select("doc_id", "n_shingles", "component_id")


@query("op9_prefix_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_weak_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, settings = load(spark, sf_dir, "documents"), weak_toxicity.Settings()
    model = weak_toxicity.fit(documents, load(spark, sf_dir, "labels"), settings)
    return weak_toxicity.score(documents, model).select(
        "doc_id",
        weak_toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )


OP11_SQL = r"""
with docs as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') units,
         list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), i, 8) as bigint)) h
  from documents),
cuts as (
  select doc_id, t, units, len(units) n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) a,
         greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain'
              when h[4] % 100 < 50 then 'spm' else 'psm' end form
  from docs),
parts as (
  select doc_id, t, n, form, array_to_string(units[1:a], '') p, array_to_string(units[a + 1:b], '') m, array_to_string(units[b + 1:], '') s from cuts)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
       sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) output_sha256,
       sha256(t) restored_sha256
from parts
"""


@query("op11_fenwick_infill", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(load(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
with recursive known as (
  select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic from labels group by doc_id),
docs as (
  select d.doc_id, coalesce(d.source, '') part, coalesce(d.text, '') t,
         regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') w, coalesce(k.good, false) good, coalesce(k.toxic, false) toxic
  from documents d left join known k using (doc_id)),
masks as (
  select part, good, toxic,
         (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
         + 16 * coalesce(min(doc_id) over (partition by t) < doc_id, false)::int mask
  from docs),
counted as (select part, mask, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from masks group by 1, 2),
orders(o) as (
  select '' union all
  select o || l from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) x(l) where length(o) < 5 and not contains(o, l)),
steps as (
  select o filter_order, s step, 1 << (strpos('ABCDE', o[s:s]) - 1)::int bit,
         coalesce(list_sum(list_transform(generate_series(1, s - 1), lambda i: 1 << (strpos('ABCDE', o[i:i]) - 1)::int)), 0)::int gone
  from orders, (select unnest(generate_series(1, 5))::int s) where length(o) = 5)
select part, filter_order, step,
       coalesce(sum(n) filter (mask & (bit | gone) = 0), 0)::bigint kept,
       coalesce(sum(n) filter (mask & bit > 0 and mask & gone = 0), 0)::bigint removed,
       coalesce(sum(n) filter (mask & bit > 0 and mask & gone > 0), 0)::bigint redundant,
       coalesce(sum(n) filter (mask = bit), 0)::bigint unique_fails,
       coalesce(sum(good) filter (mask & bit > 0 and mask & gone = 0), 0)::bigint good_lost,
       coalesce(sum(toxic) filter (mask & bit > 0 and mask & gone = 0), 0)::bigint toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) filter (mask & bit > 0), 0)::bigint shapley
from counted, steps group by part, filter_order, step
"""


@query("op12_retraction_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_files(spark, f"{sf_dir}/documents.parquet", load(spark, sf_dir, "labels"))


# Host, path and verdict of the rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
OP13_SQL = r"""
with cut as (
  select page_id, case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end rest from pages),
parts as (
  select page_id, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) path from cut),
rules(h, p, v) as (values """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r"""),
judged as (
  select r, max_by(h || p, length(h || p)) rule, max_by(v, length(h || p)) verdict
  from (select row_number() over () r, * from parts) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by r)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from (select row_number() over () r, * from parts) left join judged using (r)
"""


@query("op13_sorted_digests", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(load(spark, sf_dir, "pages"), url_rules.build(rules))
