"""Queries: splits, caps, demonstrations, epochs and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.ids import MULTIPLIER, ROUNDS, SHIFT, WIDTH
from corpusloom.operators import corpus as C
from corpusloom.operators import sampling as G
from corpusloom.operators import segment as S
from corpusloom.plans.registry import hashed, query, table, toks, wide
from corpusloom.plans.sequences import IDS
from corpusloom.plans.text import SEGMENT_SQL, paragraphs


@query(
    "g02_limit_units",
    SEGMENT_SQL
    + """, c as (select doc_id, count(*) as n from units group by 1), b as (select doc_id, sum(n) over (order by doc_id) - n as before from c)
    select doc_id, ord::bigint as ord, md5(text) as digest from units join b using (doc_id) where before < 500""",
)
def limit_units(spark, sf):
    out = C.limit_units(paragraphs(spark, sf), 500)
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"))


@query("g03_split_first_n", "select o_orderkey, case when row_number() over (order by o_orderkey) <= 1000 then 'valid' else 'train' end as split from orders")
def split_first(spark, sf):
    return C.split_first_n(table(spark, sf, "orders", "o_orderkey"), 1000, "o_orderkey")


LABELLED = "p as (select doc_id as id, lang as dataset, quality as label, n_chars // 4 as n from documents join labels using (doc_id))"


def labelled(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang", "n_chars").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("dataset"), F.col("quality").alias("label"), F.floor(F.col("n_chars") / 4).alias("n"))


@query(
    "g05_balance_labels",
    f"""with {LABELLED}, c as (select dataset, label, least(count(*), 30) as c from p group by 1, 2), m as (select dataset, case when count(*) < 2 then 0 else min(c) end as m from c group by 1),
    r as (select *, row_number() over (partition by dataset, label order by {hashed(2, 'id')}, id) as r from p) select id, dataset, label from r join m using (dataset) where r <= m and r <= 30""",
)
def balance(spark, sf):
    from corpusloom.ids import seeded_key

    out = G.balance_labels(labelled(spark, sf), 60, 2, "label", ["dataset"], [seeded_key(2, "id"), F.col("id")])
    return out.select("id", "dataset", "label")


@query(
    "g06_demos_random",
    f"""with {LABELLED}, k as (select *, row_number() over (partition by dataset order by {hashed(5, 'id')}, id) - 1 as pos, count(*) over (partition by dataset) as size from p),
    d as (select s.id, s.dataset, s.n as own, s.size, unnest(generate_series(0, least(4, s.size - 1))) as draw from k s),
    e as (select d.id, d.dataset, d.own, d.draw, k.id as demo_id, k.n from d join k on k.dataset = d.dataset and k.pos = ({hashed(5, 'd.id')} + d.draw) % d.size where k.id <> d.id),
    q as (select *, row_number() over (partition by dataset, id order by draw) as place from e),
    t as (select *, sum(n) over (partition by dataset, id order by draw) as total from q where place <= 4)
    select dataset, id, place::bigint as place, demo_id, n::bigint as n from t where total + own <= 2000""",
)
def demos_random(spark, sf):
    pool = labelled(spark, sf)
    out = G.demos_random(pool, pool, 4, 2000, 5, True, ["dataset"])
    return out.select("dataset", "id", F.col("place").cast("long").alias("place"), "demo_id", "n")


def permuted_sql(source: str, key: list[str]) -> str:
    """Recursive SQL of ``ids.permuted``: ``walk`` has the rows of ``source`` (with n and j) and x, where j goes; use rows with x < n.

    ``key`` has four SQL expressions over ``s``, a row of the source.
    """

    def once(rows: str) -> str:
        rows = f"(select *, x % a as l, x // a as r from {rows})"
        for i in range(1, ROUNDS + 1):
            half, size = ("r", "a") if i % 2 else ("l", "b")
            add = f"((({half} + k[{i}]) % {WIDTH}) * {MULTIPLIER} // {1 << SHIFT}) % {size}"
            new = f"(l + {add}) % a as l, r" if i % 2 else f"l, (r + {add}) % b as r"
            rows = f"(select * exclude (l, r), {new} from {rows})"
        return f"(select * exclude (l, r, x), r * a + l as x from {rows})"

    start = f"(select s.*, [{', '.join(key)}] as k, j::bigint as x, ceil(sqrt(n))::bigint as a, ceil(n / ceil(sqrt(n)))::bigint as b from {source} s)"
    return f"walk as (select * from {once(start)} union all select * from {once('(select * from walk where x >= n)')})"


def _shared_sql(balanced: bool) -> str:
    part = ["dataset", "label"] if balanced else ["dataset"]
    want = "ceil((case when t < 10 then 8 else 17 - t end) / labels)" if balanced else "case when t < 10 then 8 else 17 - t end"
    parts = ", ".join(part)
    keys = [f"{hashed(8, str(i), *[f'z.{p}' for p in part], 'z.t')} % {WIDTH}".replace("z.", "s.") for i in range(ROUNDS)]
    same = " and ".join(f"walk.{p} = o.{p}" for p in part)
    return f"""with recursive {LABELLED}, nl as (select dataset, count(distinct label) as labels from p group by 1),
    o as (select *, row_number() over (partition by {parts} order by id) - 1 as pos from p),
    z as (select {parts}, count(*)::bigint as n from p group by {parts}), a as (select z.*, t.t, labels from z join nl using (dataset) cross join (select unnest(generate_series(0, 16)) as t) t),
    d as (select *, unnest(generate_series(0, least({want}, n)::bigint - 1)) as j from a), {permuted_sql('d', keys)},
    e as (select walk.dataset, walk.t, o.id, o.n from walk join o on {same} and walk.x = o.pos where walk.x < walk.n),
    f as (select dataset, t from e group by 1, 2 having sum(n) <= 1500), m as (select dataset, min(t) as t from f group by 1)
    select dataset, id, n::bigint as n, t::bigint as try from e join m using (dataset, t)"""


@query("g07_demos_shared", _shared_sql(False))
def demos_shared(spark, sf):
    out = G.demos_shared(labelled(spark, sf), 8, 1500, 8, ["dataset"])
    return out.withColumn("try", F.col("try").cast("long"))


@query("g07_demos_shared_balanced", _shared_sql(True))
def demos_balanced(spark, sf):
    out = G.demos_shared(labelled(spark, sf), 8, 1500, 8, ["dataset"], label="label")
    return out.withColumn("try", F.col("try").cast("long"))


@query(
    "g11_epoch_index",
    f"""with {LABELLED}, s as (select dataset, count(*) as n, least(40, count(*)) as m from p group by 1),
    x as (select p.dataset, id, s.n, s.m, unnest(generate_series(0, (ceil(3 * s.m / s.n) - 1)::bigint)) as pass from p join s using (dataset)),
    o as (select *, row_number() over (partition by dataset, pass order by {hashed(6, 'pass', 'id')}, id) - 1 + pass * n as g from x)
    select dataset, (g // m)::bigint as epoch, (g % m)::bigint as place, id from o where g // m < 3""",
)
def epochs(spark, sf):
    return G.epoch_index(labelled(spark, sf), 3, 40, 6, ["dataset"])


@query("g12_head_per_file", "select 'documents' as name, doc_id from documents where doc_id < 25 union all select 'benchmark', item_id from benchmark where item_id < 25")
def head(spark, sf):
    import uuid

    from corpusloom.session import checkpoint_root
    from corpusloom.sources.readers import head_per_file

    root = f"{checkpoint_root(spark)}/heads-{uuid.uuid4().hex}"
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        rows = table(spark, sf, name, key).orderBy(key).select(F.col(key).cast("string").alias("value"))
        rows.coalesce(1).write.text(f"{root}/{name}")
    parts = [head_per_file(spark, f"{root}/{n}", 25).select(F.lit(n).alias("name"), F.col("value").cast("long").alias("doc_id")) for n in ("documents", "benchmark")]
    return parts[0].unionByName(parts[1])


GROUPS = f"s as (select doc_id as id, len(list_filter([50, 200, 800], lambda b: b <= len({toks('text')}))) as grp from documents)"


@query(
    "g13_batches_by_length",
    f"""with {GROUPS}, r as (select *, row_number() over (partition by grp order by id) - 1 as pos, count(*) over (partition by grp) as n from s),
    w as (select id, grp, 'g-' || grp || '-' || (pos // 32) as batch from r where pos < n // 32 * 32),
    l as (select id, grp, row_number() over (order by grp, pos) - 1 as pos from r where pos >= n // 32 * 32)
    select id, grp::bigint as "group", batch from w union all select id, grp::bigint, 'rest-' || (pos // 32) from l""",
)
def by_length(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text").select("doc_id", T.n_tokens("text").alias("len"))
    out = G.batches_by_length(rows, [50, 200, 800], 32, F.col("len"), "doc_id")
    return out.withColumn("group", F.col("group").cast("long"))


@query(
    "g14_sortish_batches",
    f"""with o as (select o_orderkey as id, floor(o_totalprice / 1000)::bigint as len from orders), m as (select *, row_number() over (order by {hashed(3, 'id')}, id) - 1 as pos from o),
    c as (select *, pos // 800 as chunk, row_number() over (partition by pos // 800 order by len desc, pos) - 1 as i from m), r as (select id, len, i, chunk * 50 + i // 16 as raw from c),
    h as (select raw, len from r where i % 16 = 0), f as (select raw from h order by len desc, raw limit 1),
    b as (select raw, row_number() over (order by case when raw = (select raw from f) then 0 else {hashed(3, 'raw')} + 1 end, raw) - 1 as batch from h)
    select batch::bigint as batch, count(*)::bigint as n, max(len) as longest, min(len) as shortest from r join b using (raw) group by batch""",
)
def sortish(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    rows = rows.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).alias("len"))
    out = G.sortish_batches(rows, 16, 3, "len", "id")
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest"), F.min("len").alias("shortest"))


@query(
    "g15_token_budget_batches",
    f"""with recursive s as (select doc_id as id, len({toks('text')}) as len from documents),
    n as materialized (select *, row_number() over (order by len desc, id) as r, greatest(1, 65536 // greatest(len, 1)) as m from s),
    f(r, batch, room) as (select r, 0, case when m < 8 then m else m - m % 8 end - 1 from n where r = 1
      union all select n.r, case when f.room > 0 then f.batch else f.batch + 1 end, case when f.room > 0 then f.room else case when m < 8 then m else m - m % 8 end end - 1
      from f join n on n.r = f.r + 1)
    select batch::bigint as batch, count(*) as n, (count(*) * max(len))::bigint as padded from f join n using (r) group by batch""",
)
def budget(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text").select("doc_id", T.n_tokens("text").alias("len"))
    out = G.token_budget_batches(rows, 65536, "len", "doc_id", 8)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.max("len")).alias("padded"))


@query(
    "g16_assign_workers",
    """with r as (select c_custkey, row_number() over (order by c_custkey) - 1 as i, count(*) over () as n from customer),
    a as (select c_custkey, i from r union all select c_custkey, i + n from r where i < (7 - n % 7) % 7) select c_custkey, (i % 7)::bigint as worker, (i // 7)::bigint as place from a""",
)
def workers(spark, sf):
    out = G.assign_workers(table(spark, sf, "customer", "c_custkey"), 7, "c_custkey")
    return out.withColumn("worker", F.col("worker").cast("long"))


@query(
    "g17_mixture",
    "select p_partkey as id, 'icl' as source from part union all select id, 'lm' from (select o_orderkey as id, row_number() over (order by o_orderkey) as r from orders) where r <= (select floor(1.5 * count(*)) from part)",
)
def mixture(spark, sf):
    return G.mixture(
        table(spark, sf, "part", "p_partkey").withColumnRenamed("p_partkey", "id"),
        table(spark, sf, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "id"), 1.5, "id",
    )


@query(
    "g18_drop_null_windows",
    f"""with s as (select doc_id, {IDS} as t, (doc_id * 37) % greatest(len({toks('text')}) - 3, 1) as st, len({toks('text')}) as n from documents),
    g as (select *, unnest(generate_series(0, n - 1, 192)) as b from s), k as (select *, b // 192 as ord, (st >= b and st + 2 <= b + 253) as hit from g where b = 0 or b - 192 + 254 < n)
    select doc_id, ord::bigint as ord from k where doc_id % 11 <> 0 and (hit or {hashed(4, "(doc_id || ':' || ord)")} % 1000000 / 1000000.0 >= 0.6)""",
)
def null_windows(spark, sf):
    from corpusloom.plans.sequences import _window_input

    w = S.windows(_window_input(spark, sf), 256, 64).withColumn("wid", F.concat_ws(":", "doc_id", "ord"))
    out = G.drop_null_windows(w, 0.6, 4, "wid", F.col("start") == -100, F.col("doc_id") % 11 == 0)
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"))


@query("g19_take_pool", "select doc_id, lang from (select *, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 50")
def pool(spark, sf):
    return G.take_pool(table(spark, sf, "documents", "doc_id", "lang"), 50, ["lang"], "doc_id")


@query(
    "g20_sample_answer_span",
    rf"""with a as (select doc_id, string_split(text, chr(10)) as l from documents), p as (select doc_id, regexp_split_to_array(l[{hashed(3, "'a'", 'doc_id')} % len(l) + 1], '\s+') as w from a),
    s as (select doc_id, w, {hashed(3, "'s'", 'doc_id')} % greatest(len(w) - 8 + 1, 1) as st from p) select doc_id, md5(array_to_string(list_slice(w, st + 1, len(w)), ' ')) as span from s""",
)
def span(spark, sf):
    rows = wide(spark, sf, "documents", "doc_id", "text").select("doc_id", F.split("text", "\n", -1).alias("answers"))
    return G.sample_answer_span(rows, "answers", 8, 3, "doc_id").select("doc_id", F.md5("span").alias("span"))


