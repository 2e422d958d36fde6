"""SimHash near-dedup: fingerprints joined on pigeonhole blocks, verified by Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets of more fingerprints are linked over single-bit neighbours, which grows with the bucket and not its square.
PAIR_BUCKET = 8
SEED = 42
#: Beyond so many kept ids, documents meet them by a shuffle join and not by a broadcast.
MAX_ROWS = 1_000_000
#: Bands of minima and the minima in each: texts of Jaccard likeness 0.8 share a band with probability 0.9996.
BANDS, WIDTH = 20, 5
#: Odd multipliers and masks of the BANDS * WIDTH orders of shingles.
ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * WIDTH)).astype("u8") * np.uint64(2) + np.uint64(1)
#: Texts, and their shingles, that a block of a large bucket has at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Rounds in which texts of shared buckets gather in homes.
GATHER = 2
#: Shingles that two blocks are compared over at once.
COLUMNS = 2048


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    begin = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return majority([digest(joined[a:b], SEED) for a, b in zip(begin, (ends[shingle - 1 :] - 1).tolist(), strict=True)])


def majority(hashes) -> int:
    """The SimHash of 64-bit hashes: each bit that is set in over half of them."""
    ones = np.zeros(64, "i8")
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], ">u8")
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, *carry: str) -> DataFrame:
    """doc_id, the columns `carry` (longs) and fp (the fingerprint as a signed long), a row per row."""

    def work(batches):
        common.forget()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], "u8").view("i8")
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(fps)], ["doc_id", *carry, "fp"])
        common.give_back()

    return common.ready(docs).select(F.col("doc_id").cast("long"), *carry, F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(work, ", ".join(f"{c} long" for c in ("doc_id", *carry, "fp")))


def signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks of each choice of blocks - bits of the blocks: fingerprints at `bits` or fewer bits agree under one at least."""
    if not 1 <= bits <= 2 or 64 % blocks or blocks <= bits:
        raise ValueError("bits must be 1 or 2, and blocks a divisor of 64 above bits")
    width = 64 // blocks
    return [sum(((1 << width) - 1) << (width * b) for b in chosen) for chosen in combinations(range(blocks), blocks - bits)]


def near_links(classes: DataFrame, bits: int = 2, blocks: int = 4, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) between classes (fp, node) that connect exactly the fingerprints at `bits` (1 or 2) or fewer bits.

    Of `blocks` equal blocks, fingerprints that differ in at most `bits` bits share blocks - bits whole ones: each
    choice of those is a join key. Small buckets are joined and verified by Hamming distance. In large ones each
    fingerprint names itself and its neighbours at one bit outside the shared blocks; two fingerprints name the same
    value exactly if they are two bits or fewer apart, and no value is named by more fingerprints than it has
    neighbours, so groups stay small whatever the bucket's size.
    """
    masks = block_masks(bits, blocks)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)])
    rows = classes.select("fp", "node", F.explode(keys).alias("x")).select("fp", "node", "x.k", "x.key")
    sizes = rows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = common.written(rows.join(sizes, ["k", "key"]), "simhash-blocks")
    small = rows.filter(F.col("n") <= pair_bucket)
    a, b = small.select("k", "key", F.col("fp").alias("fa"), F.col("node").alias("a")), small.select("k", "key", F.col("fp").alias("fb"), F.col("node").alias("b"))
    pairs = a.join(b, ["k", "key"]).filter("fa < fb").filter(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= bits).select("a", "b")
    free = F.element_at(F.array(*[F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]), F.col("k") + 1)
    named = rows.filter(F.col("n") > pair_bucket).select("k", "fp", "node", F.explode(free).alias("flip")).select("k", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "fp", "node")
    if bits == 1:  # then a value that is no fingerprint joins none
        named = named.join(classes.select(F.col("fp").alias("value")), "value", "left_semi")
    groups = named.groupBy("k", "value").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
    stars = groups.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), for nodes that have a link.

    Alternates large and small stars: each node passes its least neighbour on, first to larger neighbours, then to
    itself and smaller ones. Every round is a table in the shared folder, so a lost executor repeats one round.
    """
    edges = common.written(links, "components")
    state = None
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), "a", "b")
        edges_new = small.select(F.col("x").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        edges = common.written(edges_new, "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        state = tuple(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links), a row per row.

    Rows with the same fingerprint are one class, and the fingerprint its node, so copies never form pairs and rows
    without an id, or with another's, stay apart. Texts without words share the fingerprint zero and are linked. A
    null id counts as larger than any; a component of null ids alone has a null id. Other columns are ignored; an
    empty table gives no row.
    """
    prints = common.written(fingerprints(docs, shingle).select("doc_id", common.id_key().alias("_id"), "fp"), "simhash-prints")
    final = grouped(prints, bits)
    out = prints.join(final, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif(F.col("component_id"), F.lit(common.NO_ID)).alias("component_id"))


def grouped(prints: DataFrame, bits: int) -> DataFrame:
    """fp, component (its least fingerprint) and component_id (its least _id) of each fingerprint."""
    classes = common.written(prints.groupBy("fp").agg(F.min("_id").alias("_id")), "simhash-classes")
    named = components(near_links(classes.select("fp", F.col("fp").alias("node")), bits)).groupBy("node").agg(F.min("component").alias("component"))
    of = classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_id", F.coalesce("component", "fp").alias("component"))
    of = common.written(of, "simhash-components")
    return of.join(of.groupBy("component").agg(F.min("_id").alias("component_id")), "component").select("fp", "component", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row of docs of each component: the one of least id, and among those of least hash of the row's columns."""
    rows = common.row_ties(docs).select(F.col("_id").alias("doc_id"), "_tie", F.col("_row.text").alias("text"))
    prints = common.written(fingerprints(rows, shingle, "_tie").select(F.col("doc_id").alias("_id"), "_tie", "fp"), "simhash-prints")
    return first_rows(docs, prints.join(grouped(prints, bits), "fp").select("_id", "_tie", "component"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, n: int = 5) -> tuple[np.ndarray, int]:
    """Distinct 64-bit hashes of the text's runs of n words (of all its words if they are fewer), and a hash of the words."""
    words = common.word_hashes(text, True)
    long = max(1, len(words) - n + 1)
    out = np.zeros(long, "u8")
    for j in range(min(n, len(words))):
        out = mixed(out + np.uint64(0x9E3779B97F4A7C15)) + words[j : j + long]
    return np.unique(mixed(out)), xxhash.xxh64_intdigest(words.tobytes(), SEED)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the band's minima."""
    least = np.full(BANDS * WIDTH, ~np.uint64(0))
    for k in range(0, len(hashes), 4096):
        part = (hashes[None, k : k + 4096] ^ ORDERS[1][:, None]) * ORDERS[0][:, None]
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=1))
    key = np.arange(BANDS, dtype="u8")
    for j in range(WIDTH):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[j::WIDTH])
    return key


def first_rows(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Of each component of members (_id, _tie, component; a row per row of docs) one row: the least by _id and _tie."""
    counted = members.groupBy("component", "_id", "_tie").agg(F.count(F.lit(1)).alias("_n"))
    least = counted.groupBy("component").agg(F.min(F.struct("_id", "_tie", "_n")).alias("x")).select("x.*")
    least = common.written(least, "simhash-kept")
    rows, none = common.row_ties(docs), least.filter("_n > 1").isEmpty()
    out = rows.join(common.smaller(least.filter("_n = 1"), MAX_ROWS), ["_id", "_tie"], "left_semi").select("_row")
    if not none:  # rows repeated as a whole
        again = rows.join(common.smaller(least.filter("_n > 1"), MAX_ROWS), ["_id", "_tie"], "left_semi")
        out = out.unionByName(again.groupBy("_id", "_tie").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")


def shared(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The numbers of shingles that the rows `left` share with the rows `right`: products of 0/1 blocks, over the shingles
    of two rows or more, COLUMNS at a time."""
    sizes = np.array([len(x) for x in rows])
    _, column, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    rank = np.cumsum(n > 1) - 1  # among the shingles of two rows or more
    both = n[column] > 1
    row, column = row[both], rank[column[both]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), "f4")
    for first in range(0, int(rank[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        ones = np.zeros((len(rows), COLUMNS), "f4")
        ones[row[a:b], column[a:b] - first] = 1
        out += ones[left] @ ones[right].T
    return out


def dense_links(large: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect exactly the texts of a large bucket that are `threshold` alike.

    Each text has one block. It takes the largest of its buckets as its home, and then, GATHER times, the home that most
    texts have among those it shares a bucket with, so that texts which share buckets have few homes; the texts of a
    home are dealt into as many blocks as their number and their shingles ask for.
    Two blocks (or one with itself) are compared if a bucket has texts of both; all texts of the one with all of the
    other, as matrices. So nothing is left out in a bucket of any size, a text's
    shingles go to the blocks that meet its own and not to each of its partners, and a task returns no pairs but one
    connected text for each text.
    """
    home = large.groupBy("node").agg(F.max(F.struct("n", "k", "key")).alias("h")).select("node", "h.k", "h.key")
    members = large.select("node", "size", F.col("k").alias("bk"), F.col("key").alias("bkey"))
    for _ in range(GATHER):
        chosen = home.join(home.groupBy("k", "key").agg(F.count(F.lit(1)).alias("m")), ["k", "key"])
        first = members.join(chosen, "node").groupBy("bk", "bkey").agg(F.max(F.struct("m", "k", "key")).alias("h"))
        home = common.written(members.join(first, ["bk", "bkey"]).groupBy("node").agg(F.max("h").alias("h")).select("node", "h.k", "h.key"), "alike-homes")
    home = home.join(members.groupBy("node").agg(F.first("size").alias("size")), "node")
    homes = home.groupBy("k", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("parts"))
    home = home.join(homes, ["k", "key"])
    home = common.written(home.select("node", F.xxhash64("k", "key", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "alike-blocks")
    seen = large.select("k", "key", "node").join(home, "node").groupBy("k", "key").agg(F.collect_set("block").alias("blocks"))
    meet = seen.select(F.explode("blocks").alias("x"), "blocks").select("x", F.explode("blocks").alias("y")).filter("x <= y").distinct()
    sent = meet.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")).join(home, "block").join(own, "node")

    def compare(key, table):
        x, y = key[0].as_py(), key[1].as_py()
        block, node = table.column("block").to_numpy(), table.column("node").to_numpy()
        rows = table.column("own").combine_chunks().to_numpy(zero_copy_only=False)
        left, right = (np.flatnonzero(block == z) for z in (x, y))
        same, sizes = shared(list(rows), left, right).astype("f8"), np.array([len(r) for r in rows], "f8")
        i, j = np.nonzero(same >= threshold * (sizes[left][:, None] + sizes[right][None, :] - same))
        root = joined(left[i], right[j], len(rows))
        apart = root != np.arange(len(rows))
        if sizes.sum() > BLOCK_SHINGLES // 4:
            common.give_back()
        return pa.table({"a": pa.array(node[root[apart]], pa.int64()), "b": pa.array(node[apart], pa.int64())})

    return sent.select("x", "y", "block", "node", "own").groupBy("x", "y").applyInArrow(compare, "a long, b long")


def joined(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of n nodes that each one reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (label[i], label[j], i, j):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def alike_links(docs: DataFrame, prints: DataFrame, shingle: int, threshold: float, pair_bucket: int = -1, bits: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) that connect the nodes whose sets of shingles have Jaccard likeness `threshold` or more.

    Candidates are the fingerprints within `bits` bits (joined on near_links' blocks, verified by Hamming distance) and,
    as likeness reaches further than that, the texts that share a band. The pairs of a bucket of up to `pair_bucket` texts
    are joined and compared; larger buckets are compared whole, block by block. prints: node, fp, bands, size, _id, a
    row per row.
    """
    pair_bucket = PAIR_BUCKET if pair_bucket < 0 else pair_bucket
    classes = common.written(prints.groupBy("node").agg(F.min("_id").alias("_id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "alike-classes")
    near = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in block_masks(bits, blocks)])
    rows = classes.select("node", "size", "fp", F.posexplode(F.concat("bands", near)).alias("k", "key"))  # blocks come behind the bands
    sizes = rows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = common.written(rows.join(sizes, ["k", "key"]), "alike-buckets")
    small, large = rows.filter(F.col("n") <= pair_bucket), rows.filter(F.col("n") > pair_bucket)
    a, b = (small.select("k", "key", F.col("node").alias(x), F.col("fp").alias("f" + x)) for x in "ab")
    kept = (F.col("k") < BANDS) | (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= bits)
    pairs = common.written(a.join(b, ["k", "key"]).filter("a < b").filter(kept).select("a", "b").distinct(), "alike-pairs")
    asked = classes.select("node", "_id").join(rows.select("node").distinct(), "node", "left_semi")

    def work(batches):
        common.forget()
        for batch in common.portions(batches, "text"):
            found = [shingles(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x[1] for x in found], pa.uint64()).view(pa.int64()), pa.array([x[0].view("i8") for x in found], pa.list_(pa.int64()))], ["_id", "node", "own"])

    texts = docs.select(common.id_key().alias("_id"), F.col("text").cast("string").cast("binary").alias("text"))
    texts = texts.join(common.smaller(asked.select("_id").distinct(), MAX_ROWS), "_id", "left_semi")
    own = texts.mapInArrow(work, "_id long, node long, own array<long>").join(common.smaller(asked, MAX_ROWS), ["_id", "node"], "left_semi")
    own = common.written(own.groupBy("node").agg(F.first("own").alias("own")), "alike-shingles")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("own").alias("sa")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    found = both.filter(same >= threshold * (F.size("sa") + F.size("sb") - same)).select("a", "b")
    return found.unionByName(dense_links(large, own, threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_alike(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of docs of each component of texts whose sets of shingles have likeness `threshold` or more.

    Texts with the same words, lower case, are one node. The least id stays (null is the largest), then the least
    hash of the row's columns. Candidates are near SimHash fingerprints of the sets and, because SimHash at a radius
    that a join can afford misses most copies near the threshold, texts that share a band of minima over the shingles
    (two texts at the threshold share one with probability 0.9996). All are verified exactly, in buckets of any size.
    """

    def work(batches):
        common.forget()
        for batch in common.portions(batches, "text"):
            found = [shingles(t.as_py(), shingle) for t in batch.column(2)]
            keys = np.array([bands(x[0]) for x in found]).reshape(len(found), BANDS)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x[1] for x in found], pa.uint64()).view(pa.int64()), pa.array(np.array([majority(x[0]) for x in found], "u8").view("i8")), pa.array(list(keys.view("i8")), pa.list_(pa.int64())), pa.array([len(x[0]) for x in found], pa.int64())], ["_id", "_tie", "node", "fp", "bands", "size"])

    rows = common.row_ties(common.ready(docs)).select("_id", "_tie", F.col("_row.text").cast("string").cast("binary").alias("text"))
    prints = common.written(rows.mapInArrow(work, "_id long, _tie long, node long, fp long, bands array<long>, size long"), "alike-prints")
    named = components(alike_links(docs, prints, shingle, threshold)).groupBy("node").agg(F.min("component").alias("component"))
    members = prints.select("node", "_id", "_tie").join(named, "node", "left").select("_id", "_tie", F.coalesce("component", "node").alias("component"))
    return first_rows(docs, members)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: shingles of 3 words, links at 2 bits or fewer."""
    return near_duplicates(common.documents(spark, sf_dir))
