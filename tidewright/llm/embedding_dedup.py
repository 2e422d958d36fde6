"""Near-duplicate embeddings: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import components, joined

#: Tables of buckets, hashes in a bucket's key, and buckets each vector looks into in a table. Vectors of up to 64, of
#: 256 and of 768 components at cosine 0.98 share a bucket of a table with probability 0.82, 0.76 and 0.70 (4,000 and
#: 1,000 pairs measured), so that six tables miss 3e-5, 2e-4 and 7e-4 of the pairs at the threshold, and fewer above it.
TABLES, HASHES, PROBES = 6, 3, 4
SEED = 42
#: Shorter vectors are padded to so many components: over fewer, signs and transforms give few different rotations.
LEAST_WIDTH = 64
#: Vectors of a bucket that meet in one task; a larger bucket is split, and its parts meet two by two.
BLOCK = 1024
#: Rows of small buckets that are handled together, about.
PACK_ROWS = 20_000


def rotations(dim: int) -> np.ndarray:
    """Signs of the tables' hashes: three diagonals each, over the next power of two."""
    return np.random.default_rng([SEED, dim]).choice([-1.0, 1.0], (TABLES, HASHES, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, up to a factor."""
    rows, dim = x.shape
    step = 1
    while step < dim:
        x = x.reshape(rows, dim // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(rows, dim)
        step *= 2
    return x


def buckets(unit: np.ndarray) -> np.ndarray:
    """The keys of each unit vector's buckets, (rows, TABLES, PROBES), its own first. A hash is the axis nearest to the
    rotated vector, and its side; the other probes take the next nearest axes where that costs least."""
    rows, dim = unit.shape
    wide = max(LEAST_WIDTH, 1 << max(0, dim - 1).bit_length())
    padded = np.zeros((rows, wide))
    padded[:, :dim] = unit
    choices = min(PROBES, wide)
    combos = np.array(list(product(range(choices), repeat=HASHES)))
    out = np.zeros((rows, TABLES, PROBES), "i8")
    for t, signs in enumerate(rotations(wide)):
        code, loss = np.zeros((rows, len(combos)), "i8"), np.zeros((rows, len(combos)))
        for j in range(HASHES):
            y = padded
            for diagonal in signs[j]:
                y = hadamard(y * diagonal) / np.sqrt(wide)
            axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :choices]
            value = np.take_along_axis(y, axes, 1)
            code = code * (2 * wide) + (2 * axes + (value < 0))[:, combos[:, j]]
            loss += ((np.abs(value[:, :1]) - np.abs(value)) ** 2)[:, combos[:, j]]
        order = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        found = np.take_along_axis(code, order, 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]  # fewer buckets than probes: the own one again
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length one, by way of the largest component so that nothing overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def first_met(i: np.ndarray, j: np.ndarray, keys: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether this bucket is the first in which each of the pairs (i, j) meets: two vectors meet in the own bucket of
    either if the other looks into it."""
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        own_i, own_j = keys[i, t, 0], keys[j, t, 0]
        in_i, in_j = (keys[j, t] == own_i[:, None]).any(axis=1), (keys[i, t] == own_j[:, None]).any(axis=1)
        if t < table:
            first &= ~(in_i | in_j)
        else:
            none = np.iinfo("i8").max
            first &= np.minimum(np.where(in_i, own_i, none), np.where(in_j, own_j, none)) == bucket
    return first


def linked(unit: np.ndarray, keys: np.ndarray, own: np.ndarray, table: int, bucket: int, pairs: tuple[np.ndarray, np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a bucket's vectors with cosine `threshold` or more that meet here first and not between two guests.
    pairs: the vectors of one part and of the other; None for all within the bucket."""
    left, right = pairs or (np.arange(len(unit)),) * 2
    i_all, j_all = [], []
    for k in range(0, len(left), 128):
        part = left[k : k + 128]
        i, j = np.nonzero(unit[part] @ unit[right].T >= threshold - 1e-9)
        i, j = part[i], right[j]
        keep = own[i] | own[j]
        if pairs is None:
            keep &= i < j
        i, j = i[keep], j[keep]
        keep = first_met(i, j, keys, table, bucket)
        i, j = i[keep], j[keep]
        keep = (unit[i] * unit[j]).sum(axis=1) >= threshold
        i_all.append(i[keep])
        j_all.append(j[keep])
    return np.concatenate(i_all), np.concatenate(j_all)


def classes_of(rows: DataFrame) -> DataFrame:
    """Equal vectors of a label, once: node, label, vector, copies and the least id."""
    grouped = rows.filter("label is not null and vector is not null").groupBy("label", "vector")
    return common.written(grouped.agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("_id")).withColumn("node", F.monotonically_increasing_id()), "embedding-classes")


def links(classes: DataFrame, threshold: float = 0.98, block: int = 0, pack_rows: int = 0) -> DataFrame:
    """node, n_links (copies of other classes that it is linked with) and root (a node it is connected with), some rows
    for each node that has a link. classes: node, label (a string), vector (array of double) and copies.

    A bucket of any size is compared whole: beyond `block` vectors its parts meet two by two in tasks of their own, as
    blocks of a matrix. A pair counts in the first bucket in which it meets, so that no pair has to be written or made
    distinct: a task returns sums, and one connected node for each node.
    """
    block, pack_rows = block or BLOCK, pack_rows or PACK_ROWS

    def hashed(batches):
        for batch in batches:
            values = batch.column("vector")
            ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
            flat, sizes = values.flatten().to_numpy(zero_copy_only=False), np.diff(ends, prepend=0)
            keys = np.zeros((len(ends), TABLES * PROBES), "i8")
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for k in range(0, len(at), 512):
                    some = at[k : k + 512]
                    vectors = np.stack([flat[ends[r] - size : ends[r]] for r in some])
                    keys[some] = buckets(units(vectors)).reshape(len(some), -1)
            yield pa.record_batch([batch.column("node"), pa.array(sizes, pa.int32()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "dim", "keys"])
        common.give_back()

    coded = common.ready(classes).select("node", "vector").mapInArrow(hashed, "node long, dim int, keys array<long>")
    coded = common.written(classes.select("node", "label").join(coded, "node"), "embedding-buckets")
    place = ["label", "dim", "t", "code"]
    rows = coded.select("node", "label", "dim", F.posexplode("keys").alias("k", "code"))
    rows = rows.select("node", "label", "dim", F.floor(F.col("k") / PROBES).cast("int").alias("t"), "code", (F.col("k") % PROBES == 0).alias("own"))
    rows = rows.groupBy("node", *place).agg(F.max("own").alias("own"))  # a bucket that a vector looks into twice
    met = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("owners")).filter("n > 1 and owners > 0")
    rows = common.written(rows.join(met.select(*place, "n"), place), "embedding-members")
    small = rows.filter(F.col("n") <= block)
    packs = max(1, small.count() // pack_rows)
    bucket = F.xxhash64(*place)
    small = small.select("*", F.pmod(bucket, F.lit(packs)).alias("pack"), F.lit(0).alias("mine"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    parts = F.ceil(F.col("n") / block).cast("int")
    large = rows.filter(F.col("n") > block).select("*", bucket.alias("pack"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    large = large.select("*", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).drop("other")
    asked = small.unionByName(large).drop("label", "dim").join(coded.join(classes.select("node", "vector", "copies"), "node"), "node")

    def compare(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        dim, t, code = (table.column(c).to_numpy() for c in ("dim", "t", "code"))
        by = np.lexsort((code, t, dim, label))
        change = np.flatnonzero(np.any([np.diff(x[by]) != 0 for x in (label, dim, t, code)], axis=0)) + 1
        node, copies, own, mine = (table.column(c).to_numpy()[by] for c in ("node", "copies", "own", "mine"))
        keys = np.stack(table.column("keys").combine_chunks().to_numpy(zero_copy_only=False)[by]).reshape(len(by), TABLES, PROBES)
        vectors = table.column("vector").combine_chunks().to_numpy(zero_copy_only=False)[by]
        out = [(np.zeros(0, "i8"),) * 3]
        for begin, end in zip([0, *change], [*change, len(by)], strict=True):
            some = slice(begin, end)
            two = None if lo == hi else (np.flatnonzero(mine[some] == lo), np.flatnonzero(mine[some] == hi))
            if end - begin < 2 or two and not (len(two[0]) and len(two[1])):
                continue
            i, j = linked(units(np.stack(vectors[some])), keys[some], own[some], int(t[by[begin]]), int(code[by[begin]]), two, threshold)
            if len(i):
                total = np.zeros(end - begin, "i8")
                np.add.at(total, i, copies[some][j])
                np.add.at(total, j, copies[some][i])
                root = joined(i, j, end - begin)
                kept = np.flatnonzero(total)
                out.append((node[some][kept], total[kept], node[some][root[kept]]))
        return pa.table({c: pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k, c in enumerate(("node", "n_links", "root"))})

    return asked.groupBy("pack", "lo", "hi").applyInArrow(compare, "node long, n_links long, root long")


def near_embeddings(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links (other rows of its label at cosine `threshold` or more), component_id (least vec_id reachable
    over links) and kept (vec_id is component_id), a row per row of vectors (vec_id, embedding, label).

    Equal vectors of a label are one class, so copies form no pairs. Vectors that are null, empty, zero or hold null or
    non-finite components, and those without a label, link with nothing; nor do vectors of different lengths. A null
    id counts as larger than any. Every link found is verified in double precision; which are found depends on the
    buckets (see TABLES). Other columns are ignored; an empty table gives no row.
    """
    value = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    no_id = F.coalesce(F.col("vec_id").cast("long"), F.lit(common.NO_ID))
    rows = common.ready(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), no_id.alias("_id"), F.col("label").cast("string").alias("label"), F.when(sound, value).alias("vector"))
    classes = classes_of(rows)
    found = common.written(links(classes, threshold), "embedding-links")
    degree = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    edges = found.filter("root <> node").select(F.least("root", "node").alias("a"), F.greatest("root", "node").alias("b")).distinct()
    named = components(edges).groupBy("node").agg(F.min("component").alias("component"))
    all_of = classes.select("node", "label", "vector", "copies", "_id").join(named, "node", "left").join(degree, "node", "left")
    all_of = common.written(all_of.select("label", "vector", "_id", F.coalesce("component", "node").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "embedding-components")
    least = all_of.groupBy("component").agg(F.min("_id").alias("least"))
    all_of = all_of.join(least, "component").select("label", "vector", "n_links", "least")
    out = rows.join(all_of, ["label", "vector"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.nullif(F.coalesce("least", "_id"), F.lit(common.NO_ID)).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op12, at cosine 0.98."""
    common.ship(spark)
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
