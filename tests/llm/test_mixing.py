import math
from collections import defaultdict

import pytest

from tidewright.llm import mixing


def check(docs, tolerance=None):
    rows = mixing.mix(docs).collect()
    size = {}
    for r in docs.collect():
        size.setdefault(r.doc_id, len((r.text or "").encode().split()))
    assert len(rows) == docs.count() and all(r["size"] == size[r.doc_id] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for group in by.values():
        source_size, target, taken = group[0].source_size, group[0].target, sum(r.taken for r in group)
        assert source_size == sum(r["size"] for r in group) and target <= 3 * source_size + 1e-6
        assert abs(taken - target) <= 0.5 * max(r["size"] for r in group) + 1
        assert all(0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in group)
    return rows


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = check(docs)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    total = sum(r["size"] for r in rows)
    assert math.isclose(sum({r.source: r.target for r in rows}.values()), total, rel_tol=1e-6)


def test_odd(odd, none):
    check(odd)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 10, "b": 10}, {"a": 0, "b": 5}, {"a": 0}])
def test_targets(sizes):
    target = mixing.source_targets(sizes, (1, 2, 3), 3.0)
    assert all(t <= 3 * sizes[s] + 1e-9 for s, t in target.items())
    assert math.isclose(sum(target.values()), min(sum(sizes.values()), 3 * sum(sizes.values())), abs_tol=1e-9)


def test_shares_by_hand():
    # a, b, c weigh 1, 2, 3: b and c stop at 3; a takes the rest
    assert mixing.source_targets({"a": 100, "b": 1, "c": 1}, (1, 2, 3), 3.0) == {"b": 3.0, "c": 3.0, "a": 96.0}


def test_rates_tilt_exponentially(spark, sf):
    rows = [r for r in mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.rate < 3 and r["size"] > 0]
    by = defaultdict(set)
    for r in rows:
        by[r.source].add(round(math.log(r.rate) / r["size"], 9))
    assert all(max(v) - min(v) < 1e-8 for v in by.values())


def test_rows_under_one_id_take_their_own_copies(spark):
    rows = [(None if k % 2 else 5, f"{'word ' * (1 + k % 7)}{k // 40}", "abc"[k % 3]) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    for r in mixing.mixed_documents(docs).collect():
        got[r.source] += len(r.text.split())
    assert got == want and len(set(want.values())) > 1


def test_sources_that_do_not_settle_are_refused(spark):
    hist = spark.createDataFrame([("=a", 10, 5), ("=a", 90, 5)], "_src string, size long, n long")
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.balance(hist, {"=a": 500}, {"=a": 300.0}, 3.0, rounds=1)
