"""Fill-in-the-middle forms, the filter audit and URL rules against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import filter_audit, infill, url_rules

# ---- fill-in-the-middle

LINES = ["", None, "\n", "one", "one\n", "a\n\n\nb", "é\nüü\n中文字\n😀", "x<P>y\nz", "<S>", "a<M", "<\nS>\n<", "long " * 40_000, "line\n" * 30_000, "\r\n \t\n\x00\n"]


def plain_infill(doc_id, text, settings):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    one, two, three = settings.marks
    if not text or any(k in text for k in settings.marks) or h[2] % 100 >= settings.percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < settings.spm_percent:
        return len(units), "spm", len(p), len(m), two + s + one + p + three + m
    return len(units), "psm", len(p), len(m), one + p + two + s + three + m


@pytest.mark.parametrize("block_bytes, slice_bytes", [(1, 50), (7, 100_000), (256, 8_000_000)])
def test_infill_equals_plain_cuts(spark, block_bytes, slice_bytes):
    rng = random.Random(3)
    texts = LINES + ["".join(rng.choice("ab\né\n😀 <PS>") for _ in range(rng.randrange(60))) for _ in range(120)]
    texts = texts if block_bytes > 1 else [t for t in texts if len(t or "") < 1000]
    rows = [(None if i == 5 else i - i % 2, t, "x", 1.0, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 string, cut double, h string").repartition(3)
    settings = infill.Infill(percent=90, block_bytes=block_bytes, slice_bytes=slice_bytes)
    made = infill.transform(docs, settings, keep=("doc_id", "c0", "cut", "h"))
    made = made.withColumn("back", infill.restore(F.col("output"), F.col("form"), settings)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made), key=key)
    assert got == sorted(((d, *plain_infill(d, t, settings)) for d, t, *_ in rows), key=key)
    assert all(r["back"] == r["text"] and (r["c0"], r["cut"], r["h"]) == ("x", 1.0, "y") for r in made)


def test_infill_of_an_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_hold_units_and_code_points():
    texts = [b"", b"ab\n", "é\n中\n".encode() * 37, b"\n" * 64, b"q" * 100]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    trees = infill.Trees(data, ends, 8)
    feeds, points = trees.totals()
    assert feeds.tolist() == [t.count(b"\n") for t in texts]
    assert points.tolist() == [len(t.decode()) for t in texts]
    for t, text in enumerate(texts):
        places = [i + 1 for i, c in enumerate(text.decode()) if c == "\n"]
        k = np.arange(1, len(places) + 1)
        assert trees.points_until(np.full(len(k), t), k).tolist() == places


# ---- filter audit


def plain_mask(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return "".join(c for c, f in zip("ABCD", fails) if f)


def plain_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({d for d, *q in labels if q[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, s in rows:
        fails = plain_mask(t or "") + ("E" if i is not None and first[t or ""] < i else "")
        parts[s or ""].append((fails, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(n=240):
    rng = random.Random(11)
    long = [" ".join(f"w{rng.randrange(400)}" for _ in range(230)) for _ in range(12)]
    texts = [None, "", " ", "short", "SHOUT", "a#b", "same " * 300, "é" * 10, *long, *[t + " $" for t in long[:4]], *[t.upper() for t in long[:3]]]
    rows = [(n - i if i % 9 else None, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(n)]
    rows += [(7, "twice", "s"), (7, "twice", "t"), (7, "twice", "s"), (900, "twice", "t"), (3, "hot", "h")] + [(10 + i, "hot", "h") for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, n, 2)] + [(None, 1, 1), (7, 1, 0), (7, None, 1), (14, 0, 0)]
    return rows, labels


def write_files(tmp_path, rows, files):
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    for k in range(files):
        part = rows[k::files]
        columns = [[r[c] for r in part] for c in range(3)]
        table = pa.table({"doc_id": pa.array(columns[0], pa.int64()), "text": pa.array(columns[1], pa.string()), "source": pa.array(columns[2], pa.string()), "id": pa.array(["x"] * len(part)), "mask": pa.array([1] * len(part), pa.int64()), "known": pa.array(["k"] * len(part))})
        pq.write_table(table, folder / f"part-{k}.parquet")
    return str(folder)


@pytest.mark.parametrize("files, batches", [(1, 1), (6, 6)])
def test_audit_equals_plain_audit_whatever_the_order_of_files(spark, tmp_path, files, batches):
    rows, labels = audit_rows()
    path = write_files(tmp_path, rows, files)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    audit = filter_audit.Audit(batches=batches)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit_files(spark, path, known, audit).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_of_an_empty_table(spark, tmp_path):
    path = write_files(tmp_path, [], 1)
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_files(spark, path, known).count() == 0


def test_a_smaller_id_retracts_the_earlier_mask(spark):
    schema = "digest binary, known boolean, id long, mask int, part string, good boolean, toxic boolean, n long"
    state = spark.createDataFrame([], filter_audit.STATE)
    steps = [
        ([(9, "a", 1), (11, "a", 2)], {("a", 1): 1, ("a", 17): 2}),
        ([(12, "b", 1)], {("b", 17): 1}),
        ([(4, "b", 1)], {("b", 1): 1, ("a", 1): -1, ("a", 17): 1}),
        ([(4, "c", 2), (5, "c", 1)], {("c", 1): 2, ("c", 17): 1}),
        ([(1, "d", 1)], {("d", 1): 1, ("b", 1): -1, ("b", 17): 1, ("c", 1): -2, ("c", 17): 2}),
    ]
    for number, (arrived, want) in enumerate(steps):
        rows = spark.createDataFrame([(b"d", True, i, 1, p, False, False, n) for i, p, n in arrived], schema)
        up, changes = filter_audit.advance(rows, state, 16)
        assert {(r["part"], r["mask"]): r["n"] for r in changes.collect()} == want
        state = state.unionByName(up.withColumn("batch", F.lit(number)))


# ---- URL rules

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
    ("B.Example.com", "", "block"), ("example.com", "/x", "allow"), ("example.com", "/x", "block"), ("ab", "/cd", "allow"), ("x.ab", "/", "block"),
    ("", "/", "block"), (None, "/", "block"), ("net", None, "block"), ("net", "/é中", "block"), ("ple.org", "/", "block"),
]
URLS = [
    None, "", "no scheme", "://", "a://?q", "http://example.org", "http://EXAMPLE.org/", "http://a.b.example.org/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/de/", "http://com/fr/#f", "http://b.example.com", "http://b.example.com?/x", "http://c.b.example.com/x/y", "http://example.com/x",
    "http://x.ab/cd", "http://y.ab/cd", "http://.org/", "http://org./", "http://net/é中文", "http://u@example.org:80/es/", "x" * 5000 + "://h.org/" + "p" * 100_000,
    "http://" + "a." * 20_000 + "org/q", "http://a\nb.org/c\nd\n", "://x.com/de/://y",
]


def plain_judge(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = re.match(r"[^?#]*", url[url.index("://") + 3 :])[0]
        host = rest.split("/")[0]
        path = rest[len(host) :]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    host, best = low(host), None
    for h, p, v in rules:
        if h and p is not None and (host == low(h) or host.endswith("." + low(h))) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), low(h) + p, v))
    return host, path, best and best[2], best[3] if best else otherwise


@pytest.mark.parametrize("judge", [url_rules.Judge(), url_rules.Judge(bits=1), url_rules.Judge(shard_rules=2, otherwise="block", bits=62)])
def test_urls_equal_plain_judging_with_collisions_and_shards(spark, judge):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(i // 2, u, "x", "y") for i, u in enumerate(URLS * 2)]
    urls = spark.createDataFrame(rows, "page_id long, url string, c0 string, host string").repartition(3)
    found = url_rules.judge(urls, url_rules.build(rules, judge), keep=("page_id", "c0")).collect()
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found)
    assert got == Counter((i, *plain_judge(u, RULES, judge.otherwise)) for i, u, *_ in rows)


def test_random_urls_equal_plain_judging(spark):
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice("/xy") for _ in range(rng.randrange(4)))
    rules = list({(host(), "/" + path() if rng.random() < 0.8 else ""): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host()}/{path()}" for _ in range(500)]
    index = url_rules.build(spark.createDataFrame(rules, "host string, path string, verdict string"), url_rules.Judge(shard_rules=10))
    found = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), index).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in found} == {i: plain_judge(u, rules) for i, u in enumerate(urls)}


def test_no_rules_and_no_urls(spark):
    none = url_rules.build(spark.createDataFrame([], "host string, path string, verdict string"))
    urls = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge(urls, none).collect()] == [(1, "a.org", "/", None, "allow")]
    assert url_rules.judge(urls.limit(0), none).count() == 0


def test_keys_are_those_of_the_hash_library(spark):
    for text in ("", "org/", "é中", "x" * 100):
        key = spark.sql("select 1").select(F.xxhash64(F.lit(text))).first()[0]
        assert key % 2**64 == xxhash.xxh64_intdigest(text.encode(), url_rules.SEED)
