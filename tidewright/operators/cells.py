"""Nearest points by a tree of cells that are split until each holds few points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Bits by which a cell is split on each axis, and the levels at most: together what a double tells apart.
BITS, LEVELS = 3, 17
#: Points of a leaf at most, and nodes of a level that are broadcast at most.
LEAF, MAX_NODES = 64, 200_000


def _smaller(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def cell_tree(points: DataFrame, leaf: int = LEAF) -> list[DataFrame]:
    """The nodes of each level: pi and pj (the parent's cell), i and j, n (its points), their box (x_lo, x_hi, y_lo, y_hi),
    leaf, and for a leaf its points as an array `at` of (x, y, payload).

    points: x, y (finite doubles) and payload, one row for each place. A cell with more than `leaf` points is split, so
    the tree is deep only where points are dense; each level deals out only the points that no leaf has taken. Cells
    that still hold more points at the last level, which are then nearer to each other than doubles of their extent
    tell apart, stay leaves.
    """
    low_x, high_x, low_y, high_y = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if low_x is None:
        return []
    extent, finest = max(high_x - low_x, high_y - low_y) or 1.0, 1 << BITS * LEVELS
    place = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(extent) * finest), F.lit(finest - 1)).cast("long")
    rest, out = points.select("x", "y", "payload", place("x", low_x).alias("fine_i"), place("y", low_y).alias("fine_j")), []
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        rest = written(rest.withColumns({"i": F.shiftright("fine_i", shift), "j": F.shiftright("fine_j", shift)}))
        sizes = written(rest.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi")))
        full = sizes.filter(F.col("n") > leaf) if level < LEVELS else sizes.filter("false")
        taken = rest.join(full.select("i", "j"), ["i", "j"], "left_anti").groupBy("i", "j").agg(F.collect_list(F.struct("x", "y", "payload")).alias("at"))
        nodes = sizes.join(taken, ["i", "j"], "left").withColumn("leaf", F.col("at").isNotNull())
        out.append(written(nodes.withColumns({"pi": F.shiftright("i", BITS), "pj": F.shiftright("j", BITS)})))
        if full.isEmpty():
            break
        rest = rest.join(_smaller(full.select("i", "j"), MAX_NODES), ["i", "j"], "left_semi").select("x", "y", "payload", "fine_i", "fine_j")
    return out


def nearest(asked: DataFrame, tree: list[DataFrame], key: str, scale: float = 1.0, watch: Callable[[DataFrame, DataFrame], None] | None = None) -> DataFrame:
    """key and best (distance, payload): the nearest point of each asked key, ties by the payload. Distances are times scale.

    asked: key, a and b (finite doubles). The search goes down the tree level by level. A node is as far as its box at
    least, and has a point no farther than its box's far corner. Nodes farther than the least such bound of their key
    are left out, so a key meets the cells in a ring around it. A leaf is looked through in its row, so that keys which
    crowd around one leaf are rows of a join with one row and not pairs. watch gets each level's nodes that were
    compared by their boxes (n: their points), and the leaves that were looked through.
    """
    measure = lambda dx, dy: _distance(dx, dy) * F.lit(float(scale))
    dx, dy = (F.greatest(F.col(f"{c}_lo") - F.col(p), F.col(p) - F.col(f"{c}_hi"), F.lit(0.0)) for c, p in (("x", "a"), ("y", "b")))
    far_x, far_y = (F.greatest(F.abs(F.col(f"{c}_lo") - F.col(p)), F.abs(F.col(f"{c}_hi") - F.col(p))) for c, p in (("x", "a"), ("y", "b")))
    own = F.array_min(F.transform("at", lambda t: F.struct(measure(t["x"] - F.col("a"), t["y"] - F.col("b")).alias("distance"), t["payload"].alias("payload"))))
    ring = asked.select(key, "a", "b", F.lit(0).cast("long").alias("pi"), F.lit(0).cast("long").alias("pj"), F.lit(float("inf")).alias("bound"))
    found = []
    for nodes in tree:
        met = ring.join(_smaller(nodes.drop("at"), MAX_NODES), ["pi", "pj"]).filter(measure(dx, dy) <= F.col("bound"))
        met = written(met.select(key, "a", "b", "i", "j", "n", "leaf", "bound", measure(dx, dy).alias("near"), measure(far_x, far_y).alias("far")))
        bounds = met.groupBy(key).agg(F.least(F.min("bound"), F.min("far")).alias("bound"))
        kept = met.drop("bound", "far").join(bounds, key).filter("near <= bound")
        leaves = kept.filter("leaf").join(nodes.filter("leaf").select("i", "j", "at"), ["i", "j"]).select(key, own.alias("best"))
        found.append(written(leaves.groupBy(key).agg(F.min("best").alias("best"))))
        if watch:
            watch(met, kept.filter("leaf"))
        closer = found[-1].select(key, F.col("best.distance").alias("own"))
        inner = kept.filter("not leaf").join(closer, key, "left").withColumn("bound", F.least("bound", "own")).filter("near <= bound")
        ring = inner.select(key, "a", "b", F.col("i").alias("pi"), F.col("j").alias("pj"), "bound")
    return reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min("best").alias("best"))
