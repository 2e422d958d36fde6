import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import cells, targets


def brute(stations, points):
    out = {}
    for s, a, b in stations:
        d = np.sqrt((points[:, 0] - a) ** 2 + (points[:, 1] - b) ** 2) * 111
        out[s] = min(zip(d.tolist(), range(len(points)), strict=True))
    return out


def search(spark, stations, points, leaf, seen=None):
    df = spark.createDataFrame([(float(x), float(y), k) for k, (x, y) in enumerate(points)], "x double, y double, k long")
    tree = cells.cell_tree(df.groupBy("x", "y").agg(F.min("k").alias("payload")), leaf)
    asked = spark.createDataFrame([(int(s), float(a), float(b)) for s, a, b in stations], "s long, a double, b double")
    found = cells.nearest(asked, tree, "s", 111, None if seen is None else lambda met, leaves: seen.append((met.count(), leaves.agg(F.sum("n")).first()[0] or 0)))
    return {r.s: (r.best.distance, r.best.payload) for r in found.collect()}, tree


def clouds(name, rng):
    if name == "even":
        return rng.uniform(-90, 90, (700, 2))
    if name == "nested":
        return np.concatenate([rng.normal(0, 10.0**-k, (150, 2)) + 3 for k in range(6)])
    if name == "grid":  # many ties
        return np.array([(i, j) for i in range(20) for j in range(20)], float)
    if name == "copies":
        return np.repeat(rng.uniform(0, 1, (5, 2)), 100, axis=0)
    return np.array([(7.0, 7.0)])


@pytest.mark.parametrize("name", ["even", "nested", "grid", "copies", "one"])
def test_same_as_all_pairs(spark, name):
    rng = np.random.default_rng(len(name))
    points = clouds(name, rng)
    near = points[rng.integers(0, len(points), 30)] + rng.choice([0, 0.5, 1e-7], (30, 1))
    stations = [(k, a, b) for k, (a, b) in enumerate(np.concatenate([near, rng.uniform(-200, 200, (30, 2))]))]
    got, _ = search(spark, stations, points, 8)
    assert got == brute(stations, points)


def test_a_crowd_in_one_spot_and_one_outlier(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 1e-4, (100_000, 2)), [(90.0, 170.0)]])
    stations = [(k, *p) for k, p in enumerate(np.concatenate([rng.normal(0, 2e-4, (150, 2)), rng.uniform(-90, 90, (50, 2))]))]
    seen = []
    got, tree = search(spark, stations, points, cells.LEAF, seen)
    assert got == brute(stations, points)
    assert max(n.select(F.max(F.size("at"))).first()[0] or 0 for n in tree) <= cells.LEAF
    boxes, pairs = sum(n for n, _ in seen), sum(n for _, n in seen)
    assert boxes <= 300 * len(stations) and pairs <= 150 * len(stations)  # all pairs: 100,001 a station


def test_places_with_several_targets_nulls_and_preference(spark):
    rows = [(5, 1.0, 1.0, "a"), (4, 1.0, 1.0, "b"), (3, None, 1.0, "b"), (2, float("nan"), 0.0, "b"), (1, float("inf"), 0.0, "b"), (9, 2.0, 2.0, "c")]
    offers = spark.createDataFrame(rows, "k long, x double, y double, kind string")
    places = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 50.0, 50.0)], "s long, a double, b double")
    best = lambda wanted: sorted(tuple(r) for r in targets.best_target(places, offers, "s", ("a", "b"), ("x", "y"), wanted, "k", ["kind"]).select("s", "kind").collect())
    assert best(F.lit(True)) == [(1, "b"), (4, "c")] and best(F.col("kind") == "a") == [(1, "a"), (4, "a")] and best(F.col("kind") == "z") == [(1, "b"), (4, "c")]


def test_boxes_look_at_both_axes(spark):
    rng = np.random.default_rng(6)
    offers = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 100, (6000, 2)))], "k long, x double, y double")
    places = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(10, 90, (60, 2)))], "s long, a double, b double")
    found = targets.box_join(places, offers, ("a", "b"), ("x", "y"), (3, 5))
    want = places.join(offers, F.col("x").between(F.col("a") - 3, F.col("a") + 3) & F.col("y").between(F.col("b") - 5, F.col("b") + 5))
    assert sorted((r.s, r.k) for r in found.collect()) == sorted((r.s, r.k) for r in want.collect())
    cell = lambda c, h: F.floor(F.col(c) / h)
    looked = places.join(offers, (F.abs(cell("a", 3) - cell("x", 3)) <= 1) & (F.abs(cell("b", 5) - cell("y", 5)) <= 1)).count()
    assert looked <= 2.6 * found.count()
