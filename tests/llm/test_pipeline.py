"""The pipeline's stages against plain Python on the smallest tables, and its edge cases."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import weak_toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def first_of_groups(rows):
    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {rows[i]["doc_id"] for i in range(len(rows)) if root(i) == i}


def test_stages_match_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "secrets", "mix", "encode"]

    def after(name, frame):
        path = str(tmp_path / name.replace(" ", "-"))
        stages[name](spark, frame, SF).write.parquet(path)
        return spark.read.parquet(path)

    kept = after("toxicity", docs)
    model = weak_toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in weak_toxicity.score(docs, model).collect()}
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s < 0.7}

    first = after("near copies", kept)
    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == first_of_groups(rows)

    masked = after("secrets", first)
    before = {r["doc_id"]: r for r in first.collect()}
    hits = re.compile(r"""AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""")
    assert masked.columns == columns and masked.count() == len(before)
    for r in masked.collect():
        old = before[r["doc_id"]]
        if hits.search(old["text"]):
            assert not hits.search(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert r == old

    mixed = after("mix", masked)
    assert mixed.columns == columns
    sizes, times = {r["doc_id"]: len(WORD.findall(r["text"])) for r in masked.collect()}, {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert all(1 <= n <= 3 and sizes[i] > 0 for i, n in times.items())
    assert abs(sum(n * sizes[i] for i, n in times.items()) / sum(sizes.values()) - 1) < 0.2

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in mixed.collect()}
    got = stages["encode"](spark, mixed, SF).collect()
    assert len(got) == mixed.count()
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["doc_id"]], "<u4").tobytes()).hexdigest()


CLASHING = ["_extra", "score", "component", "position"] + [u + n for n in ("row", "blob", "text", "hit", "masked", "toxicity", "position_", "a", "b") for u in ("_", "__")]
CLASHING += ["row", "blob", "hit", "masked", "toxicity", "size", "taken", "key", "slab", "digest", "found"]


def test_stages_take_odd_rows_and_keep_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    extra = [f"own {c}" for c in CLASHING]
    rows = [
        (1, None, None, None, None, *[None] * len(extra)),
        (None, "", "en", "a", 0, *extra),
        (2, "one two three four five secret=abcdefgh99", "en", "a", 9, *extra),
        (2, "one two three four five secret=abcdefgh99", "en", "a", 9, *extra),
    ]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{len(data)}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
            assert all(tuple(r)[5:] in (tuple(extra), (None,) * len(extra)) for r in docs.collect()), name
        found = docs.filter(F.contains("text", F.lit("[secret]"))).count()
        assert found >= 1 if data else docs.count() == 0


def test_near_copies_of_five_words_go(spark):
    """Similar by five words to between 0.80 and 0.85, by four words to less than 0.85; and pairs just below 0.80."""
    words = [f"w{i}" for i in range(1000)]
    edited = list(words)
    for i in range(20, 1000, 47):
        edited[i] = f"e{i}"
    texts = [words, words + [f"x{i}" for i in range(200)], edited, [f"v{i}" for i in range(1000)]]
    texts.append(texts[3] + [f"y{i}" for i in range(260)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= near(0, 1) < 0.85 and 0.8 <= near(0, 2) < 0.85 and 0.75 < near(3, 4) < 0.8
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 3, 4]


def test_mix_spreads_the_readings_of_a_source(spark):
    """A small source read three times is read whole before any of its documents comes again."""
    rows = [(i, "one two three", "b" if i % 40 == 0 else "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect() if r["source"] == "b"]
    assert len(small) == 30 and len(set(small[:10])) == 10 and small[:10] == small[10:20] == small[20:]
