"""Small fixtures with known answers, and brute force for what SQL cannot say."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import prompt_columns
from corpusloom.functions import scores as X
from corpusloom.functions import text as T
from corpusloom.functions.normalizers import basic_text_normalize
from corpusloom.functions.vectors import half_precision
from corpusloom.operators import knn as K
from corpusloom.operators import neardup as N
from corpusloom.operators import sequences as Q
from corpusloom.operators import segment as S
from corpusloom.operators import spans as P
from corpusloom.sources import readers
from corpusloom.sources.html import page_nodes


def test_near_dedup_three_files(spark):
    rows = [(0, "a " * 20), (1, "a " * 30), (2, "b " * 7)]
    df = spark.createDataFrame(rows, "id long, content string")
    kept, report = N.near_dedup(df, "content", "id")
    found = {r.id: r for r in report.collect()}
    assert set(found) == {0, 1}
    assert found[0].is_extreme and found[0].copies == 2
    assert not found[1].is_extreme
    assert sorted(r.id for r in kept.collect()) == [0, 2]


def _noisy_docs(n=160, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [list(rng.choice(words, 60, replace=False)) for _ in range(12)]
    docs = []
    for i in range(n):
        base = list(bases[int(rng.integers(0, 3 if i % 3 == 0 else 12))])
        for _ in range(int(rng.integers(0, 9))):
            base[int(rng.integers(0, len(base)))] = words[int(rng.integers(0, 400))]
        docs.append((i, " ".join(base)))
    return docs


def test_clusters_and_extremes_equal_the_sequential_rule(spark):
    """A third of the documents come from three bases, so buckets are hot and clusters large."""
    docs = _noisy_docs()
    df = spark.createDataFrame(docs, "id long, content string")
    bands, rows = N.best_bands()
    sigs = N.minhash(df, "content", "id")
    per = defaultdict(list)
    for r in N.lsh_buckets(sigs, "id", bands, rows).collect():
        per[r.id].append(r.bucket)
    index, bases, want = defaultdict(list), set(), {}
    for i in sorted(per):
        close = sorted({j for b in per[i] for j in index[b]})
        for b in per[i]:
            index[b].append(i)
        if close:
            base = next((c for c in close if c in bases), close[0])
            bases.add(base)
            want[i] = base
    got = N.duplicate_clusters(sigs, "id", bands, rows, hot_rows=10)
    assert {r.id: r.base for r in got.collect()} == want

    tokens = {i: set(t.split()) for i, t in docs}
    extremes = {}
    for base in bases:
        kept = []
        for m in sorted([base, *[i for i, b in want.items() if b == base]]):
            hit = next((e for e in kept if len(tokens[m] & tokens[e]) / len(tokens[m] | tokens[e]) >= 0.85), None)
            if hit is None:
                kept.append(m)
                hit = m
            extremes[base, m] = hit
    for small in (2, 200):
        report = N.cluster_extremes(got, df, "content", "id", small=small)
        assert {(r.base, r.id): r.extreme for r in report.collect()} == extremes


def test_similar_pairs_are_exact(spark):
    docs = _noisy_docs(60)
    df = spark.createDataFrame(docs, "id long, content string")
    every = [(i, j) for i, _ in docs for j, _ in docs if j < i]
    pairs = N.similar_pairs(df, spark.createDataFrame(every, "id long, base long"), "content", "id")
    sets = {i: set(t.split()) for i, t in docs}
    want = {(i, j) for i, j in every if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    assert {(r.id, r.base) for r in pairs.collect()} == want


def test_retrieval_by_inner_product(spark):
    corpus = spark.createDataFrame([(0, [1.0] * 8), (1, [2.0] * 8)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(10, [1.0] * 8), (11, [-1.0] * 8)], "query_id long, embedding array<float>")
    hits = K.knn(q, corpus, 1, "IP", exclude_self=False)
    assert {r.query_id: r.neighbor_id for r in hits.collect()} == {10: 1, 11: 0}


def test_knn_blocks_do_not_change_the_answer(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 6)]) for i in range(150)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.withColumnRenamed("vec_id", "query_id")
    one = K.knn(q, v, 5, block_rows=1000).collect()
    many = K.knn(q, v, 5, block_rows=17, query_rows=4).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
    mat = np.array([r[1] for r in rows])
    dist = ((mat[:, None] - mat[None]) ** 2).sum(-1)
    for r in one:
        order = sorted((d, j) for j, d in enumerate(dist[r.query_id]) if j != r.query_id)
        assert order[r["rank"] - 1] == (r.score, r.neighbor_id)


LABELS = ["O", "B-MISC", "I-MISC", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]


def _tokens(spark):
    def scores(**at):
        out = [0.0] * 9
        for k, v in at.items():
            out[LABELS.index(k.replace("_", "-"))] = v
        return out

    rows = [
        (0, 1, "En", 0, 2, False, scores(I_PER=0.997)),
        (0, 2, "##zo", 2, 4, True, scores(I_PER=0.996)),
        (0, 7, "UN", 11, 13, False, scores(B_ORG=0.999)),
    ]
    return spark.createDataFrame(rows, "sent_id int, index int, word string, start int, end int, is_subword boolean, scores array<double>")


def test_entity_strategies(spark):
    toks = _tokens(spark)
    plain = P.token_labels(toks, LABELS).orderBy("index").collect()
    assert [(r.entity, r.score) for r in plain] == [("I-PER", 0.997), ("I-PER", 0.996), ("B-ORG", 0.999)]
    simple = P.group_entities(P.token_labels(toks, LABELS)).orderBy("start").collect()
    assert [(r.entity_group, r.word, r.start, r.end) for r in simple] == [("PER", "Enzo", 0, 4), ("ORG", "UN", 11, 13)]
    assert abs(simple[0].score - 0.9965) < 1e-9
    for strategy, score in (("FIRST", 0.997), ("MAX", 0.997), ("AVERAGE", 0.9965)):
        out = P.group_entities(P.words_from_subwords(toks, LABELS, strategy)).orderBy("start").collect()
        assert [r.entity_group for r in out] == ["PER", "ORG"]
        assert abs(out[0].score - score) < 1e-9 and out[0].word == "Enzo"


PAGE = """<HTML>
    <HEAD><TITLE>sample document</TITLE></HEAD>
    <BODY BGCOLOR="FFFFFF"><HR>
    <a href="http://google.com">Goog</a>
    <H1>This is one header</H1>
    <P>Travel from
        <P>
        <B>SFO to JFK</B>
        <BR>
        <B><I>on May 2</I></B>
        <div><h3>Traveler <b> name </b> is
            <p> John Doe </p>
        </div>"""


def test_html_nodes_nest_unclosed_elements():
    assert page_nodes(PAGE) == [
        ("sample document", "/html/head/title"),
        ("Goog", "/html/body/a"),
        ("This is one header", "/html/body/h1"),
        ("Travel from", "/html/body/p"),
        ("SFO to JFK", "/html/body/p/p/b[1]"),
        ("on May 2", "/html/body/p/p/b[2]/i"),
        ("Traveler", "/html/body/p/p/div/h3"),
        ("name", "/html/body/p/p/div/h3/b"),
        ("is", "/html/body/p/p/div/h3"),
        ("John Doe", "/html/body/p/p/div/h3/p"),
    ]


def test_stories(spark):
    raw = [("It was the year of Our Lord one thousand seven hundred and seventy-five\n\nmessages as at this\n\n@highlight\n\nIt was the best of times",), ("no marker here.",), ("",)]
    out = readers.parse_stories(spark.createDataFrame(raw, "value string")).collect()
    assert out[0].story_lines[0].endswith("seventy-five.") and out[0].story_lines[1].endswith("as at this.")
    assert out[0].summary_lines == ["It was the best of times."]
    assert out[1].story_lines == ["no marker here."] and out[1].summary_lines == []
    assert out[2].story_lines == [] and out[2].summary_lines == []


def test_every_story_is_a_file_of_its_own(spark, tmp_path):
    from corpusloom.sources import readers as R
    from corpusloom.sources import writers as W

    rows = [("a b\n\n@highlight\nc",), ("a b\n\n@highlight\nc",), ("",), (None,), ("d",)]
    folders = W.write_stories(spark.createDataFrame(rows, "value string").repartition(2), str(tmp_path))
    assert len(folders) <= 2 and len(list(tmp_path.glob("*/*.story"))) == len(rows)
    got = sorted((r.story_lines, r.summary_lines) for r in R.read_stories(spark, folders).collect())
    assert got == [([], []), ([], []), (["a b."], ["c."]), (["a b."], ["c."]), (["d."], [])]


def test_stories_are_listed_and_read_by_tasks(spark, tmp_path):
    """As Spark's text reader: folders, files and patterns, hidden and empty files, inner folders; no file in the driver's plan."""
    from corpusloom.sources import readers as R

    for name in ("a/1.story", "b/1 x%20.story", "a/2.story", "b/summary.story", "b/_hidden", "b/.crc", "a/k=1/3.story", "dd/in/4.story", "dd/8.story", "b/5.story", "c#/6.story"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text {name}\n\n@highlight\nsum")
    (tmp_path / "b/empty.story").write_text("")
    (tmp_path / "b/7.story").write_bytes(b"caf\xc3\xa9 \xff")
    for path in (str(tmp_path / "a"), str(tmp_path / "a/k=1"), [str(tmp_path / "b"), str(tmp_path / "c#")], str(tmp_path / "dd"), str(tmp_path / "[bc]*"), str(tmp_path / "a/2.story")):
        by_spark = spark.read.schema("value string").text(path, wholetext=True).selectExpr("cast(value as binary) as value")
        ours = R.read_whole_files(spark, path)
        assert sorted(bytes(r.value) for r in ours.selectExpr("cast(value as binary) as value").collect()) == sorted(bytes(r.value) for r in by_spark.collect())
    found = R.read_stories(spark, str(tmp_path / "?"))
    assert sorted(r.file for r in found.collect()) == ["1 x%20.story", "3.story", "5.story", "7.story"]
    assert "Scan text" not in found._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        R.read_stories(spark, str(tmp_path / "none"))


def test_equal_questions_are_answered_once(spark):
    from corpusloom.operators import metrics as M

    rows = spark.createDataFrame([(1, i, ["x", str(i)], ["text", "real"]) for i in range(6)], "table_id int, row int, cells array<string>, types array<string>")
    conds = "array<struct<col:int,op:int,value:string>>"
    asked = [(i, 1, 1, 4, [(1, 1, "2")]) for i in range(50)] + [(99, 1, 1, 4, [(1, 1, "2")])] * 2 + [(98, 1, 0, 0, [(1, 1, "3")]), (97, 1, 1, 1, [(1, 1, "9")])]
    queries = spark.createDataFrame(asked, f"query_id int, table_id int, sel int, agg int, conds {conds}")
    out = M.table_query(rows, queries)
    got = sorted(map(tuple, out.collect()))
    want = [(i, -1, None, 12.0) for i in range(50)] + [(97, -1, "none", None), (98, 4, "x", None), (98, 5, "x", None), (99, -1, None, 24.0)]
    assert got == want


def test_nodes_leave_a_few_pages_at_a_time(spark):
    from corpusloom.sources.html import PAGES, html_nodes

    pages = spark.createDataFrame([(i, f"<p>t{i}<b>u</b></p>") for i in range(2 * PAGES + 3)], "page_id long, html string").coalesce(1)
    got = sorted((r.page_id, r.ord, r.text, r.xpath) for r in html_nodes(pages).collect())
    assert got == sorted(x for i in range(2 * PAGES + 3) for x in [(i, 0, f"t{i}", "/p"), (i, 1, "u", "/p/b")])


def test_products_are_cut_and_copies_rank_by_id():
    import numpy as np

    from corpusloom.operators import knn as K

    rng = np.random.default_rng(1)
    c = np.repeat(rng.standard_normal((5, 4)), 8, axis=0)
    ids = rng.permutation(40)
    for metric in ("L2", "IP"):
        row, near, score = K._nearest(c[:9], c, ids, 7, metric)
        exact = -(c[:9, None] * c[None]).sum(2) if metric == "IP" else ((c[:9, None] - c[None]) ** 2).sum(2)
        for i in range(9):
            assert near[row == i].tolist() == ids[np.lexsort((ids, exact[i]))[:7]].tolist()


def test_fit_and_segments(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), (list(range(1, 14)),)], "t array<int>")
    assert [r[0] for r in df.select(A.fit("t", 10, 0)).collect()] == [[1, 2, 3, 4] + [0] * 6, list(range(1, 11))]
    df = spark.createDataFrame([([1, 2, 3, 101, 5, 6],), ([1, 101, 3, 4, 101, 6],)], "t array<int>")
    assert [r[0] for r in df.select(A.segment_ids("t", 101)).collect()] == [[1, 1, 1, 0, 0, 0], [1, 0, 0, 0, 1, 1]]


def test_segmentation_glues_after_a_colon(spark):
    text = "one two three four:\nfive six\nseven eight nine\n\nten"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = S.segment_paragraphs(df, 6).orderBy("ord").collect()
    assert [r.text for r in out] == ["one two three four:\nfive six", "seven eight nine\nten"]


def test_evidence_positions(spark):
    blocks = [(1, 0, "this is the first one".split()), (1, 3, "this is the fourth".split()), (1, 5, "is longer longer longer".split())]
    b = spark.createDataFrame(blocks, "question_id int, block_id int, tokens array<string>")
    a = spark.createDataFrame([(1, "the fourth".split()), (1, "longer longer".split())], "question_id int, answer array<string>")
    out = {r.block_id: r for r in P.evidence_table(P.evidence_positions(b, a)).collect()}
    assert [out[i].has for i in (0, 3, 5)] == [False, True, True]
    assert out[0].starts == [-1, -1] and out[3].starts == [2, -1] and out[5].starts == [1, 2] and out[5].ends == [2, 3]


def test_pack_pairs(spark):
    rows = [(0, " Sam ate lunch today.", "A very interesting story about what I ate for lunch."), (1, "Sams lunch ingredients.", "Avocado, celery, turkey, coffee")]
    df = spark.createDataFrame(rows, "id long, src string, tgt string")
    df = df.withColumn("src_tokens", T.n_tokens("src")).withColumn("tgt_tokens", T.n_tokens("tgt"))
    assert Q.pack_pairs(df, 128).count() == 1
    assert Q.pack_pairs(df, 5).count() == 2


def test_word_scores():
    assert X.lcs_length("a b c d".split(), "b x d".split()) == 2
    assert X.edit_distance("kitten sitting on".split(), "sitting on mat".split()) == 2
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 12)))) for _ in range(2))
        lcs = np.zeros((len(a) + 1, len(b) + 1), int)
        edit = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                lcs[i, j] = lcs[i - 1, j - 1] + 1 if x == y else max(lcs[i - 1, j], lcs[i, j - 1])
                edit[i, j] = min(edit[i - 1, j] + 1, edit[i, j - 1] + 1, edit[i - 1, j - 1] + (x != y))
        assert X.lcs_length(a, b) == lcs[-1, -1] == len(X.lcs_members(a, b))
        assert X.edit_distance(a, b) == edit[-1, -1]


def test_basic_normalizer(spark):
    rows = [("Naïve  [x] CAFÉ, œuvre (y)!", "naive cafe oeuvre "), ("a<b>c", "ac"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("want", basic_text_normalize("t", diacritics=True).alias("got")).collect():
        assert r["got"] == r["want"]
    split = spark.createDataFrame([("Ab é", ), (None,)], "t string").select(basic_text_normalize("t", split_letters=True).alias("t"))
    assert [r["t"] for r in split.collect()] == ["a b é", None]


def test_nearest_of_small_vectors(spark):
    """Differences far below any rounding still rank."""
    points = spark.createDataFrame([(i, [i * 1e-4, 0.0]) for i in (3, 2, 1)] + [(9, [0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = points.filter("vec_id = 9").withColumnRenamed("vec_id", "query_id")
    assert [r["neighbor_id"] for r in K.knn(queries, points, 3).orderBy("rank").collect()] == [1, 2, 3]
    near = K.knn(queries, points, 3).orderBy("rank").first()
    assert abs(near["score"] - 1e-8) < 1e-20


def test_scores_of_null_texts(spark):
    df = spark.createDataFrame([(None, ["a"], "a"), ("a", None, None), ("a b", ["a b"], "a b")], "p string, r array<string>, t string")
    got = df.select(X.rouge_l_max("p", "r").alias("l"), X.rouge_scores("p", "t").alias("s"), X.word_edits("p", "t").alias("e")).collect()
    assert [r["l"] for r in got] == [None, None, 1.0]
    assert [r["s"] and r["s"]["rouge1"] for r in got] == [None, None, 1.0]
    assert [r["e"] for r in got] == [None, None, 0]


def test_template_values(spark):
    """Operands, branches, names set in branches, rounding and floats print as the template language prints them."""
    df = spark.createDataFrame([(1, "", "b", 0, 2.5, 1e8, True, 1e-5)], "id long, a string, b string, n long, d double, big double, t boolean, tiny double")
    cases = {
        "{{ a or b }}": "b",
        "{{ b and a }}|": "|",
        "{{ b or a }}": "b",
        "{{ a or n }}": "0",
        "{% if a or n %}yes{% else %}no{% endif %}": "no",
        "{{ (1 if t else 2) + 3 }}": "4",
        "{% if t %}{% set x = 'one' %}{% endif %}{{ x }}": "one",
        "{% set x = 'zero' %}{% if a %}{% set x = 'one' %}{% else %}{% set x = 'two' %}{% endif %}{{ x }}": "two",
        "{% set x = 'zero' %}{% if a %}{% set x = 'one' %}{% endif %}{{ x }}": "zero",
        "{{ d | round }}": "2.0",
        "{{ big }}": "100000000.0",
        "{{ big * 1.25 + 0.5 }}": "125000000.5",
        "{{ big * big * 10 }}": "1e+17",
        "{{ tiny }}": "1e-05",
        "{{ tiny * 25 }}": "0.00025",
        "{{ 0 - big }}": "-100000000.0",
    }
    got = df.select(*[prompt_columns.render_text(c, df.schema).alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert dict(zip(cases, got)) == cases
    for refused in ("{{ (1 if t else 'x') + 3 }}", "{% if (1 if t else 'x') %}y{% endif %}", "{{ (a or n) + 1 }}"):
        with pytest.raises(prompt_columns.UnsupportedTemplate):
            prompt_columns.render_text(refused, df.schema)


def test_half_precision(spark):
    values = [0.1, 1.0, 2049.0, 0.33333, 0.0, 7.77, 1e-3]
    got = spark.createDataFrame([(values,)], "v array<double>").select(half_precision("v")).first()[0]
    assert got == [float(np.float16(v)) for v in values]


def test_parallel_files_must_align(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.txt").write_text("eins\nzwei\n")
    good = readers.read_parallel(spark, str(tmp_path / "a.txt"), str(tmp_path / "a.txt"))
    assert good.count() == 3 and good.filter(F.col("src") == F.col("tgt")).count() == 3
    try:
        readers.read_parallel(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()
    except Exception as err:  # noqa: BLE001
        assert "empty or missing text" in str(err)
    else:
        raise AssertionError("misaligned files must fail")
