"""Merkle manifest of a dataset: a sparse forest of digests, merged in a tree of rounds, with a proof for every row."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a part, about, and the fragments that meet in one merge.
PART_ROWS, FAN = 50_000, 16
#: Rows of the runs (one for each part and tree in it) that are broadcast at most.
MAX_ROWS = 200_000
OPEN, KNOWN, TOP = 0, 1, 2
NODES = "part long, tree string, n long, level int, idx long, digest string, state int"


def h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value: no two lists of values give the same text."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def sizes(n: int, arity: int) -> list[int]:
    """Nodes of each level over n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Forest:
    """Nodes of trees, keyed by level and index: a value of the monoid. Adding nodes and then closing is associative
    and commutative, because a parent comes to be exactly when its run of siblings is whole; how long each run is
    follows from the tree's number of leaves."""

    def __init__(self, n: int, arity: int):
        self.sizes, self.arity = sizes(n, arity), arity
        self.levels: list[dict[int, str]] = [{} for _ in self.sizes]

    def run(self, level: int, index: int) -> range:
        """The index and its siblings."""
        first = index - index % self.arity
        return range(first, min(first + self.arity, self.sizes[level]))

    def close(self) -> Forest:
        for level, nodes in enumerate(self.levels[:-1]):
            above = self.levels[level + 1]
            for index in nodes:
                if (parent := index // self.arity) not in above:
                    run = self.run(level, index)
                    if all(k in nodes for k in run):
                        above[parent] = h([nodes[k] for k in run])
        return self

    def state(self, level: int, index: int) -> int:
        if level + 1 == len(self.levels):
            return TOP
        return KNOWN if index // self.arity in self.levels[level + 1] else OPEN


def node_rows(part: int, forests: dict[str, Forest], known: bool) -> pa.Table:
    """The nodes as rows of NODES; those whose parent is there only if `known`."""
    rows = [(part, tree, f.sizes[0], level, i, d, state) for tree, f in forests.items() for level, nodes in enumerate(f.levels) for i, d in nodes.items() if (state := f.state(level, i)) != KNOWN or known]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32())
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "tree", "n", "level", "idx", "digest", "state"])


def forests_of(table: pa.Table, arity: int) -> dict[str, Forest]:
    """Forests that hold the rows tree, n, level, idx, digest."""
    out: dict[str, Forest] = {}
    for tree, n, level, index, digest in zip(*(table.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest")), strict=True):
        if tree not in out:
            out[tree] = Forest(n, arity)
        out[tree].levels[level][index] = digest
    return out


def placed(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """leaves (with tree, a string, and digest), each with part, idx (its place in its tree) and n (the tree's leaves);
    the runs (part, tree, first, size, n); and the number of parts.

    Leaves are range-partitioned by tree, the columns `order`, the digest and their place in the input, so that a tree
    or a run of equal leaves of any size is spread over parts.
    """
    spark = leaves.sparkSession
    rows = common.written(leaves.withColumn("_salt", F.monotonically_increasing_id()), "merkle-leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / PART_ROWS))
    keys = ["tree", *order, "digest", "_salt"]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the task
    ranged = common.written(ranged.select(*leaves.columns, F.spark_partition_id().cast("long").alias("part"), place.alias("_place")), "merkle-sorted")
    runs = ranged.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("size"), F.min("_place").alias("_low"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = common.written(runs.select("part", "tree", "size", "_low", F.coalesce(before, F.lit(0)).alias("first"), F.sum("size").over(tree).alias("n")), "merkle-runs")
    found = ranged.join(common.smaller(runs, MAX_ROWS), ["part", "tree"])
    return found.select(*leaves.columns, "part", (F.col("first") + F.col("_place") - F.col("_low")).alias("idx"), "n"), runs.select("part", "tree", "first", "size", "n"), parts


def merged(indexed: DataFrame, parts: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """(tops, known): tree, n and digest of each tree's top; and the nodes (tree, level, idx, digest) that no part has
    resolved by itself.

    Each part closes its own leaves to a fragment that keeps only unresolved nodes. FAN fragments at a time meet, round
    by round; a run of siblings that is whole goes into its parent. The last merge holds some FAN * arity * log(n) nodes.
    Rounds are written tables: a lost executor repeats one merge, and nothing goes through the driver.
    """

    def fragment(key, table):
        level = pa.array([0] * table.num_rows, pa.int32())
        return node_rows(key[0].as_py(), {t: f.close() for t, f in forests_of(table.append_column("level", level), arity).items()}, False)

    def merge(key, table):
        return node_rows(key[0].as_py(), {t: f.close() for t, f in forests_of(table, arity).items()}, True)

    state = common.written(indexed.select("part", "tree", "n", "idx", "digest").groupBy("part").applyInArrow(fragment, NODES), "merkle-fragments")
    tops, known = state.filter(F.col("state") == TOP), None
    while parts > 1:
        parts = math.ceil(parts / FAN)
        met = state.filter(F.col("state") == OPEN).withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part")
        state = common.written(met.applyInArrow(merge, NODES), "merkle-merged")
        tops = tops.unionByName(state.filter(F.col("state") == TOP))
        resolved = state.filter(F.col("state") == KNOWN)
        known = resolved if known is None else known.unionByName(resolved)
    known = state.filter(F.col("state") == KNOWN) if known is None else known
    return tops.select("tree", "n", "digest"), known.select("tree", "level", "idx", "digest")


def outside(runs: DataFrame, arity: int) -> DataFrame:
    """part, tree, level, idx of the nodes beside and above each run that its own leaves do not give."""

    def work(batches):
        for batch in batches:
            out = []
            for part, tree, first, size, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = own = first, first + size  # ancestors of the run's leaves, and those that its leaves give
                for level, count in enumerate(sizes(n, arity)[:-1]):
                    begin, end = lo // arity * arity, min(-(-hi // arity) * arity, count)
                    out += [(part, tree, level, k) for k in range(begin, end) if not own[0] <= k < own[1]]
                    lo, hi = lo // arity, -(-hi // arity)
                    own = -(-own[0] // arity), -(-count // arity) if own[1] == count else own[1] // arity
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["part", "tree", "level", "idx"])

    return runs.filter("size < n").select("part", "tree", "first", "size", "n").mapInArrow(work, "part long, tree string, level int, idx long")


def steps(forest: Forest, index: int) -> list[tuple[str, str]]:
    """What stands before and behind a leaf, and then behind and before each of its ancestors, in their runs."""
    out = []
    for level in range(len(forest.levels) - 1):
        nodes = forest.levels[level]
        run = forest.run(level, index)
        out.append(("".join([nodes[k] for k in run if k < index]), "".join([nodes[k] for k in run if k > index])))
        index //= forest.arity
    return out


def with_paths(indexed: DataFrame, upper: DataFrame, columns: list[str], schema: str, arity: int, row) -> DataFrame:
    """A row `row(tree, above, values of `columns`, steps)` for each leaf. upper holds the nodes from outside of each part;
    those at level -1 are handed on as above: {idx: digest} by tree."""

    def work(key, leaves, nodes):
        level = pa.array([0] * leaves.num_rows, pa.int32())
        forests = {t: f.close() for t, f in forests_of(leaves.append_column("level", level), arity).items()}
        above: dict[str, dict[int, str]] = {t: {} for t in forests}
        for tree, at, index, digest in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True):
            (forests[tree].levels[at] if at >= 0 else above[tree])[index] = digest
        names = [*columns, "tree", "idx"]
        rows = [row(tree, above[tree], values, steps(forests[tree], index)) for *values, tree, index in zip(*(leaves.column(c).to_pylist() for c in names), strict=True)]
        return pa.Table.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return indexed.groupBy("part").cogroup(upper.groupBy("part")).applyInArrow(work, schema)


def proofs(leaves: DataFrame, order: list[str], arity: int = 2) -> DataFrame:
    """leaves (doc_id; tree, a string; digest; shown, a digest that is held against the manifest in place of digest) with
    leaf, subroot (of the tree), root (over the subroots in the order of tree), proof_sha256 (of the siblings level by
    level, left to right), folded_root (from shown and those siblings) and verified (it is the root).

    Within a tree, leaves ascend by the columns `order` (nulls first), then by digest, so equal rows may change places.
    """
    indexed, runs, parts = placed(common.ready(leaves), order)
    tops, known = merged(indexed, parts, arity)
    tops = common.written(tops.withColumnRenamed("digest", "subroot"), "merkle-subroots")
    top_leaves = tops.select("tree", "subroot").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest"))
    above_indexed, above_runs, above_parts = placed(top_leaves, ["name"])
    root, above_known = merged(above_indexed, above_parts, arity)
    root = (root.first() or {"digest": None})["digest"]
    beside = outside(above_runs, arity).join(above_known, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest")
    climb = with_paths(above_indexed, beside, ["name", "digest"], "tree string, said array<string>", arity, lambda _, __, v, found: {"tree": v[0], "said": [v[1], *(x for pair in found for x in pair)]})
    climb = common.written(climb, "merkle-climbs")
    said = runs.select("part", "tree").join(common.smaller(climb, MAX_ROWS), "tree").select("part", "tree", F.lit(-1).alias("level"), F.posexplode("said").alias("idx", "digest"))
    upper = outside(runs, arity).join(known, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest").unionByName(said.withColumn("idx", F.col("idx").cast("long")))

    def result(tree, above, values, found):
        doc_id, digest, shown = values
        found += [(above[k], above[k + 1]) for k in range(1, len(above), 2)]
        node = shown
        for before, behind in found:
            node = h([before, node, behind])
        return {"doc_id": doc_id, "leaf": digest, "subroot": above[0], "root": root, "proof_sha256": h([x for pair in found for x in pair]), "folded_root": node, "verified": node == root}

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return with_paths(indexed, upper, ["doc_id", "digest", "shown"], schema, arity, result)


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = 2) -> DataFrame:
    """A row per row of docs: doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root and verified.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text. Where `tampered` holds, folded_root is recomputed
    from a leaf whose n_chars is larger by 1 (a null stays). A null lang is a tree of its own, the first; null ids come
    first in their tree; repeated rows are leaves of their own; ties of doc_id are ordered by leaf. Other columns are
    ignored; an empty table gives no row and has no root.
    """
    values = {c: F.col(c) for c in COLUMNS}
    more = values | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    lang = F.col("lang").cast("string")
    tree = F.when(lang.isNull(), "").otherwise(F.concat(F.lit("v"), lang))
    digest = leaf(*values.values())
    shown = digest if tampered is None else F.when(tampered, leaf(*more.values())).otherwise(digest)
    return proofs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), digest.alias("digest"), shown.alias("shown")), ["doc_id"], arity)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: a tree for each lang, two nodes a run; where 7 divides crc32(doc_id) the row is tampered with."""
    return manifest(common.documents(spark, sf_dir), F.coalesce(common.id_remainder(7) == 0, F.lit(False)))
