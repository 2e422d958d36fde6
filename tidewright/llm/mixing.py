"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: More sources than this are refused: one row per source goes through the driver.
MAX_SOURCES = 100_000
#: Beyond so many ids, documents meet their copies by a shuffle join and not by a broadcast.
MAX_ROWS = 1_000_000


def source_targets(sizes: dict[str, int], weights: tuple[float, ...], cap: float) -> dict[str, float]:
    """Target size of each source: its share of the whole by weight, never over cap times its own size.

    Sources take the weights in code point order, repeating. What a source cannot take is dealt again among the
    others by weight, until none is above its ceiling.
    """
    total, names = float(sum(sizes.values())), sorted(sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, list(names), total
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > cap * sizes[s]]
        if not over:
            return target | {s: weight[s] * share for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


def balance(hist: DataFrame, sizes: dict[str, int], targets: dict[str, float], cap: float, rounds: int = 40, tolerance: float = 1e-7) -> dict[str, tuple[float, float]]:
    """Multipliers of the convex dual, (lambda, scale) by source: rates min(cap, exp(lambda * size / scale)).

    The primal problem: rates nearest to 1 in relative entropy, at most cap, whose tokens meet each source's target.
    Each Newton step is one aggregation over the (source, size, documents) histogram; a bracket keeps steps safe.
    """
    spark = hist.sparkSession
    exact = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")  # noqa: E731  the same in any order, so reruns agree
    means = {r["_src"]: r["m"] for r in hist.groupBy("_src").agg((exact(F.col("n") * F.col("size").cast("double") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).cast("double").alias("m")).collect()}
    open_ = {s for s in sizes if 0 < targets[s] < cap * sizes[s] * (1 - 1e-9)}
    out = {s: (math.inf if targets[s] > 0 else 0.0, 1.0) for s in sizes if s not in open_}
    lam = {s: math.log(targets[s] / sizes[s]) for s in open_}
    low, high = dict.fromkeys(open_, -math.inf), dict.fromkeys(open_, math.inf)
    scale = {s: means[s] or 1.0 for s in open_}
    todo, off = set(open_), {}
    for _ in range(rounds):
        if not todo:
            break
        now = F.broadcast(spark.createDataFrame([(s, lam[s], scale[s]) for s in sorted(todo)], "_src string, lam double, scale double"))  # a row per source
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(math.log(cap))))
        slope = F.when(F.col("lam") * x < math.log(cap), rate * x).otherwise(0.0)
        tokens = F.col("n") * F.col("size")
        for r in hist.join(now, "_src").groupBy("_src").agg(exact(tokens * rate).alias("g"), exact(tokens * slope).alias("h")).collect():
            s, miss = r["_src"], r["g"] - targets[r["_src"]]
            if abs(miss) <= tolerance * targets[s]:
                todo.discard(s)
                continue
            off[s] = abs(miss)
            (high if miss > 0 else low)[s] = lam[s]
            step = lam[s] - miss / r["h"] if r["h"] else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else (lam[s] * 2 - 1 if miss > 0 else lam[s] * 2 + 1)
            lam[s] = step
    # sums are rounded to a millionth, so a small target may stay a little off
    if wrong := sorted(s for s in todo if off.get(s, math.inf) > max(tolerance * targets[s], 0.01)):
        raise RuntimeError(f"{len(wrong)} sources did not settle in {rounds} rounds, such as {wrong[0][1:]!r}")
    return out | {s: (lam[s], scale[s]) for s in open_}


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, carry: list[str] | None = None) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, rate, copies, taken, and the columns `carry`.

    Size is the number of words (null text: 0). The dual's rates are the same for all documents of a source with the
    same size; their sums are rounded along falling size, so a source's taken words miss its target by at most half
    its longest document, and the copies within a group go to documents by a hash of their ids. No document gets more
    than cap copies. A source whose documents have no words takes nothing (copies 1 each, for rows must be kept
    somewhere). Null sources are one source, the last. Repeated rows count each; other columns are ignored. An empty
    table gives none. Reruns agree.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))
    size = F.coalesce(F.regexp_count("text", F.lit(rf"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = common.written(docs.select("doc_id", "source", source.alias("_src"), size.alias("size"), *(carry or [])), "mix-sizes")
    hist = common.written(sized.groupBy("_src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    rows = hist.groupBy("_src").agg(F.sum(F.col("n") * F.col("size")).alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["_src"]: r["tokens"] for r in rows}
    targets = source_targets(sizes, weights, cap)
    dual = balance(hist.filter("size > 0"), sizes, targets, cap)
    per = F.broadcast(spark.createDataFrame([(s, sizes[s], float(targets[s]), *map(float, dual[s])) for s in sorted(sizes)], "_src string, source_size long, target double, lam double, scale double"))
    exponent = F.when(F.col("lam") == math.inf, math.log(cap)).otherwise(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(cap))))
    rate = F.when(F.col("lam") == math.inf, F.lit(float(cap))).otherwise(F.exp(exponent))
    falling = Window.partitionBy("_src").orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("rate")).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    groups = hist.join(per, "_src").withColumn("rate", rate).withColumn("_upto", F.floor(upto + 0.5))
    whole = F.least(F.col("_upto") - F.coalesce(F.lag("_upto").over(falling), F.lit(0)), F.floor(F.col("n") * cap))
    groups = groups.withColumn("_whole", whole).drop("lam", "scale", "_upto")
    ranked = common.spread_rank(sized.join(groups, ["_src", "size"]), ["_src", "size"], ["doc_id"], "n", ties=carry)
    # the extra copies start at a hashed place, so that low ids are not favoured
    place = F.pmod(F.col("rank") + F.pmod(F.xxhash64("_src", "size"), F.col("n")), F.col("n"))
    copies = (F.floor(F.col("_whole") / F.col("n")) + F.when(place < F.col("_whole") % F.col("n"), 1).otherwise(0)).cast("int")
    ranked = ranked.withColumn("copies", copies)
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(carry or []))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The rows of docs, each repeated by its own copies (those with none go); equal rows share their copies."""
    rows = common.row_ties(docs)
    own = mix(rows.select("_row.doc_id", "_row.source", "_row.text", "_id", "_tie"), weights, cap, ["_id", "_tie"])
    share = own.groupBy("_id", "_tie").agg(F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_n")).filter("_copies > 0")
    share = common.written(share, "mix-copies")
    full = rows.join(common.smaller(share.filter("_n = 1").drop("_n"), MAX_ROWS), ["_id", "_tie"]).select("_row", "_copies")
    if not (repeated := share.filter("_n > 1").drop("_n")).isEmpty():
        again = rows.join(common.smaller(repeated, MAX_ROWS), ["_id", "_tie"]).groupBy("_id", "_tie").agg(F.first("_row").alias("_row"), F.first("_copies").alias("_copies"))
        full = full.unionByName(again.select("_row", "_copies"))
    return full.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the contract's columns, with the document's rate and copies."""
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
