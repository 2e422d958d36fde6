import math

import numpy as np
import pytest

from tidewright.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(vec_id, n_links, component_id, kept) of each row, by all pairs."""
    def sound(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    big = (1 << 63) - 1
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n
    for a in range(n):
        for b in range(a):
            (_, v, s), (_, w, t) = rows[a], rows[b]
            if s is None or s != t or not sound(v) or not sound(w) or len(v) != len(w):
                continue
            v, w = np.array(v, "f8"), np.array(w, "f8")
            if v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= 0.98:
                links[a] += 1
                links[b] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], big), big if i is None else i)
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = None if least[root[k]] == big else least[root[k]]
        out.append((i, links[k], c, i == c))
    return sorted(out, key=str)


def clusters(rng, dim, groups, size, spread, first=0, label=None):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + rng.normal(size=dim) * rng.uniform(0, spread) / math.sqrt(dim)
            rows.append((first + len(rows), (v * rng.uniform(0.1, 9)).astype("f4").tolist(), g % 3 if label is None else label))
    return rows


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in embedding_dedup.near_embeddings(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize(("dim", "block", "pack"), [(64, 1024, 20_000), (64, 7, 10), (37, 16, 50), (3, 1024, 20_000), (1, 8, 100)])
def test_clusters(spark, dim, block, pack, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PACK_ROWS", pack)
    rng = np.random.default_rng(dim)
    rows = clusters(rng, dim, 12, 14, 0.35)
    rows += [(500 + k, v, s) for k, (_, v, s) in enumerate(rows[:20])] * 2  # exact copies, and repeated rows
    assert found(spark, rows) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(1500):  # pairs at cosine 0.98 to 0.985, the hardest there are
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        r = rng.normal(size=64)
        r -= (r @ a) * a
        c = rng.uniform(0.98, 0.985)
        b = c * a + math.sqrt(1 - c * c) * r / np.linalg.norm(r)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, b.tolist(), 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    linked = [r for r in embedding_dedup.near_embeddings(vectors).collect() if r.n_links]
    assert len(linked) >= 0.995 * len(rows) and {r.component_id % 2 for r in linked} == {0}


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    inf, nan = float("inf"), float("nan")
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, v, None), (5, None, 1), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [0.0, -0.0, 0.0], 1), (9, [], 1), (10, [], 1), (11, [1.0, None, 3.0], 1), (12, [1.0, None, 3.0], 1)]
    rows += [(13, [nan, 2.0, 3.0], 1), (14, [inf, 1.0, 1.0], 1), (15, [inf, 1.0, 1.0], 1), (16, [1.0, 2.0], 1), (17, [2.0, 4.0, 6.0], 1), (None, v, 1), (None, [5.0, -1.0, 0.0], 1), (2, v, 1), (2, v, 2), (18, [-1.0, -2.0, -3.0], 1), (19, [1e-30, 2e-30, 3e-30], 1), (20, [1e30, 2e30, 3e30], 1), (21, [0.0, 1.0, 0.0], 3), (22, [-0.0, 1.0, -0.0], 3)]
    assert found(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as copies", "'x' as `a b`", "3 as n_links")
    assert sorted((tuple(r) for r in embedding_dedup.near_embeddings(df).collect()), key=str) == brute(rows)
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def test_fast_hadamard_is_a_rotation():
    x = np.eye(8)
    y = embedding_dedup.hadamard(x) / math.sqrt(8)
    assert np.allclose(y @ y.T, x) and np.allclose(np.abs(y), 1 / math.sqrt(8))
