import os
import re
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import common, language_id, mixing, simhash, tokens

from .test_substring_dedup import brute


def alike_firsts(texts):
    """The least id of each component of texts (by id) that share 0.8 of their five-word shingles."""
    sets = {}
    for i, t in sorted(texts.items()):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for b in sets:
        for a in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return set(root.values())


def test_stages(spark, sf):
    docs = common.documents(spark, sf)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), "test")
        seen[name] = docs
        assert docs.columns == columns or name == "packing"
    rows = common.documents(spark, sf)
    start = {r.doc_id: r.text for r in rows.collect()}
    said = {r.doc_id: r for r in language_id.predictions(rows).collect()}
    for r in seen["language_id"].join(rows.select("doc_id", F.col("lang").alias("was")), "doc_id").collect():
        assert r.lang == (said[r.doc_id].lang_pred if said[r.doc_id].score >= 0.5 else r.was)
    one = {r.doc_id: r.text for r in seen["language_id"].collect()}
    assert one == {i: t for i, t in start.items() if any(c.isalpha() for c in t)}
    two = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    assert two == {i: one[i] for i in alike_firsts(one)}
    three = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    for (i, text), (n, removed, _) in brute(list(two.items())).items():
        assert (i in three) == (removed < n or n == 0)
        if i in three:
            assert len(three[i].text.split()) == n - removed and three[i].n_chars == (len(three[i].text) if removed else len(text))
    taken = defaultdict(int)
    for r in seen["mixing"].collect():
        taken[r.doc_id] += 1
    copies = {r.doc_id: r.copies for r in mixing.mix(seen["substring_dedup"]).collect() if r.copies}
    assert taken == copies
    fill = defaultdict(int)
    for r in docs.collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and set(r.doc_id for r in docs.select("doc_id").collect()) == set(copies)


def test_run(spark, sf):
    with common.scratch() as tables:
        assert corpus_pipeline.run(spark, sf).count() > 0
    left = [t for t in tables if os.path.isdir(t.removeprefix("file://"))]
    assert len(left) < len(tables) / 4 and sum("pipeline-" in t for t in left) == 1


def test_odd(spark, odd, none, sf):
    left = {}
    for docs in (odd, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, sf), "test")
            assert docs.columns == columns or name == "packing"
            left.setdefault(name, sorted(r.doc_id or -1 for r in docs.collect()))
    assert left["language_id"] == [-1, 1, 2, 6, 7, 7, 9, 10, 11]  # 3, 4 and 5 have no letter
    assert left["near_dedup"] == [-1, 1, 6, 7, 9, 11]  # 2 is 1, 10 repeats 1, and the second 7 is the first
    assert left["substring_dedup"] == [-1, 1, 6, 7, 9, 11]
    assert set(left["packing"]) <= set(left["mixing"]) <= set(left["substring_dedup"])


def test_near_copies_are_one(spark):
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(k, text.replace("word7 ", f"other{k} ") if k % 2 else text, "en", "a", 1) for k in range(20)] + [(50, "quite another text than that", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    groups = simhash.near_duplicates(docs, bits=2).collect()
    assert {r.component_id for r in groups if r.doc_id % 2 == 0 and r.doc_id < 20} == {0}
    assert 50 in {r.doc_id for r in simhash.one_of_each(docs).collect()}


def test_stages_free_what_packing_left(spark, sf, monkeypatch):
    """A Python worker lives on from the last run's packing: each stage that looks at texts frees its tokens first."""
    docs, tasks, path = common.documents(spark, sf), {}, public_tokenizers.path("byte_bpe_50k.json")
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: tasks.setdefault(f.__qualname__.replace(".<locals>", ""), f) and plain(self, f, *a, **b))
    for name, stage in corpus_pipeline.STAGES[:3]:
        tasks.clear()
        stage(spark, docs, sf)
        for task in {"language_id": ("train.count", "identify.work"), "near_dedup": ("one_of_alike.work", "alike_links.work"), "substring_dedup": ("duplicate_factors.index",)}[name]:
            tokens.byte_bpe(path)
            assert not list(tasks[task](iter(()))) and tokens.byte_bpe.cache_info().currsize == 0
    pack = corpus_pipeline.STAGES[-1][1]
    tasks.clear()
    pack(spark, docs, sf)
    list(tasks["pieces.cut"](iter(())))
    hits = tokens.byte_bpe.cache_info().hits
    assert tokens.byte_bpe(path, corpus_pipeline.REMEMBERED).entries == corpus_pipeline.REMEMBERED < tokens.ID_ENTRIES and tokens.byte_bpe.cache_info().hits == hits + 1
