import hashlib
import re

import pytest

from tidewright.llm import spotsigs

COMMON = set(spotsigs.COMMON)


def words(text):
    out, run = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha() or c.isdecimal():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def sets(text):
    w = words(text)
    spots = set()
    for i, x in enumerate(w):
        chain = [y for y in w[i + 1 : i + 9] if y not in COMMON][:2]
        if chain and x in COMMON or x not in COMMON and not COMMON.intersection(w[max(0, i - 8) : i]):
            spots.add((x, *chain))
    return spots or {("", *w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("buckets", [2000, 7])
@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_against_brute_force(tiny, odd, which, buckets, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", buckets)
    docs = odd if which == "odd" else tiny
    big = (1 << 63) - 1
    rows = sorted(((big if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: -x[0])
    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own = sets(text)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(own, sets(edited)), 9), round(jaccard(own, sets(following)), 9)))
    got = spotsigs.edited_likeness(docs).collect()
    assert sorted((big if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    of = {}
    text = dict(rows)
    for r in got:
        t = text[big if r.doc_id is None else r.doc_id]
        assert of.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 8 * len(sets(t))


def test_empty(none):
    assert spotsigs.edited_likeness(none).count() == 0


def test_texts_that_share_two_thirds_are_alike(spark):
    rows = spotsigs.edited_likeness(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 200")).collect()
    assert len(rows) > 800 and min(r.near_edited for r in rows) > 0.1 and sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


@pytest.mark.parametrize(("frequent", "slots", "together", "max_rows"), [(1000, 16_384, 256, 10**6), (20, 8, 2, 0)])
def test_links_of_the_query(tiny, odd, frequent, slots, together, max_rows, monkeypatch):
    for name, value in (("FREQUENT", frequent), ("SLOTS", slots), ("TOGETHER", together), ("MAX_ROWS", max_rows), ("MAX_HELD", max_rows)):
        monkeypatch.setattr(spotsigs, name, value)
    for docs, every in ((tiny, 5), (odd, 2)):
        rows = [(r.doc_id, sets(r.text)) for r in docs.collect()]
        want = sorted((a, sum(jaccard(s, t) >= 0.8 for _, t in rows) - 1) for a, s in rows if a is not None and a % every == 0)
        got = spotsigs.fingerprinted(docs, every).collect()
        assert len(got) == len(rows) and sorted((r.doc_id, r.n_similar) for r in got if r.n_similar is not None) == want


@pytest.mark.parametrize("name", ["spotsigs", "quality_rules"])
def test_no_python_in_native_operators(spark, sf, name, monkeypatch):
    import importlib

    from pyspark.sql.classic.dataframe import DataFrame

    module = importlib.import_module(f"tidewright.llm.{name}")
    seen = []
    for f in ("mapInArrow", "mapInPandas", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, f, lambda *_, f=f, **__: seen.append(f))
    written = module.common.written

    def watched(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(module.common, "written", watched)
    out = module.query(spark, sf)
    assert out.count() and not any(w in x for x in [*seen, out._jdf.queryExecution().executedPlan().toString()] for w in ("Python", "Pandas", "Arrow", "mapIn", "RDDScan"))


def test_ids_of_any_kind(spark):
    texts = [f"the house of number {k} stands near the river and the bridge of the town {k * 7}" for k in range(60)]
    for ids in ([hash((k, "x")) for k in range(60)], [-5, None, *range(58)], [-k for k in range(60)], [None] * 60):
        rows = spotsigs.edited_likeness(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
        assert sorted(r.n_chars for r in rows) == sorted(map(len, texts))


def test_pairs_of_a_dense_group_are_made_once(spark, monkeypatch):
    """120 near copies, all asked about: a pair comes out of the join at its first common signature only."""
    base = [f"word{k}" for k in range(200)]
    texts = [" ".join(w if j != 3 * k % 200 else f"other{k}" for j, w in enumerate(base)) for k in range(120)] + ["a text of its own " * 9]
    docs = spark.createDataFrame([(k * 5, t) for k, t in enumerate(texts)], "doc_id long, text string")
    made, written = [], spotsigs.common.written

    def watched(df, name):
        out = written(df, name)
        if name == "spotsigs-pairs":
            made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(spotsigs.common, "written", watched)
    got = {r.doc_id: r.n_similar for r in spotsigs.fingerprinted(docs, 5).collect()}
    own = [sets(t) for t in texts]
    assert got == {k * 5: sum(jaccard(s, t) >= 0.8 for t in own) - 1 for k, s in enumerate(own)}
    assert made[0][0] == made[0][1] <= 121 * 120


def test_search_finds_all(tiny):
    rows = [(r.doc_id, sets(r.text)) for r in tiny.collect()]
    queries = tiny.filter("doc_id % 10 = 0")
    want = {(a, b) for a, s in rows if a % 10 == 0 for b, t in rows if a != b and jaccard(s, t) >= 0.8}
    assert {(r.query_id, r.doc_id) for r in spotsigs.search(queries, tiny).collect()} == want


def test_ranges_are_even_for_any_ids(spark):
    ids = [*range(300), *range(10**9, 10**9 + 300), *[(1 << 63) - 1] * 300]
    df = spark.createDataFrame([(i, k * 7919 % 911) for k, i in enumerate(ids)], "_id long, _tie long")
    rows = sorted(tuple(r) for r in df.select("_id", "_tie", spotsigs.range_of(df, 30)).collect())
    buckets = [b for _, _, b in rows]
    assert buckets == sorted(buckets) and len(set(buckets)) > 20 and max(map(buckets.count, buckets)) <= 90


@pytest.mark.parametrize("held", [10**6, 2000])
def test_no_pair_or_set_is_shuffled(spark, held, monkeypatch):
    """Near copies of one text: whatever Spark would broadcast by itself, the asked sets come to the others, in portions."""
    monkeypatch.setattr(spotsigs, "MAX_HELD", held)
    monkeypatch.setattr(spotsigs, "MIN_HELD", 1, raising=False)
    base, plans, written = [f"word{k}" for k in range(100)], [], spotsigs.common.written
    texts = [" ".join(w if j != 3 * k % 100 else f"other{k}" for j, w in enumerate(base)) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def watched(df, name):
        if name == "spotsigs-pairs":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(spotsigs.common, "written", watched)
    got = {r.doc_id: r.n_similar for r in spotsigs.fingerprinted(docs, 5).collect() if r.n_similar is not None}
    own = [sets(t) for t in texts]
    assert got == {k: sum(jaccard(own[k], t) >= 0.8 for t in own) - 1 for k in range(0, 30, 5)}
    assert len(plans) == 1 and plans[0].count("strategy=broadcast") >= 2 * (1 if held > 10**5 else 2)


def test_near_copies_meet_by_rare_signatures(spark, monkeypatch):
    """Copies of one text with a tenth of their words changed are not alike: what all share keeps out of their prefixes,
    though it is no such part of all places as makes signatures frequent (as in a large table)."""
    monkeypatch.setattr(spotsigs, "FREQUENT", 2)
    base, kept, written = [f"word{k}" for k in range(200)], [], spotsigs.common.written
    texts = [" ".join(f"own{j}x{k}" if (j + k) % 10 == 0 else w for j, w in enumerate(base)) for k in range(50)]
    texts += [" ".join(f"one{k}" if j == 4 * k else w for j, w in enumerate(base[::-1])) for k in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def watched(df, name):
        out = written(df, name)
        if name == "spotsigs-prefixes":
            kept.extend(set(r.s[: r.reach]) for r in out.collect())
        return out

    monkeypatch.setattr(spotsigs.common, "written", watched)
    got = {r.doc_id: r.n_similar for r in spotsigs.fingerprinted(docs, 1).collect()}
    own = [sets(t) for t in texts]
    assert got == {k: sum(jaccard(s, t) >= 0.8 for t in own) - 1 for k, s in enumerate(own)} and max(got.values()) >= 9
    assert sum(len(a & b) for a in kept for b in kept if a is not b) < 3 * len(kept) ** 2
