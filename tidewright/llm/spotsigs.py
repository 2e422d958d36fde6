"""SpotSigs fingerprints: chains of content words after common-word anchors. DataFrame functions only."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Common words of English, German, French and Spanish, the anchors.
COMMON = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "aus das dem den der des die ein eine er es ist mit nicht sich und von zu "
    "au ce dans est et il la le les ne par pas pour qui sur un une "
    "con de del el en los las no para por que se su una y"
).split()
#: Content words in a chain, and how many words after its anchor are looked at; also, after so many words without a
#: common one, content words are anchors too.
CHAIN, REACH = 2, 8
#: Documents of a range of ids that one task orders.
BUCKET_ROWS = 2000
#: Signatures with one of so many places or more are frequent, and come last in prefixes; there are at most so many.
FREQUENT = 1000
#: Beyond so many texts asked about, their counts meet the rows by a shuffle join and not by a broadcast.
MAX_ROWS = 1_000_000
#: Slots in which signatures are counted first, whose counts order the signatures of prefixes; and asked sets of one
#: signature that are kept in one row, about.
SLOTS, TOGETHER = 16_384, 256
#: Numbers (four or eight bytes each) of asked sets that are broadcast at once; more of them go in portions of so many,
#: or of MIN_HELD if that is more.
MAX_HELD, MIN_HELD = 16_000_000, 20_000


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, the sorted distinct signatures (32-bit hashes) of a text column (null: empty); never empty.

    Words are runs of letters and digits, in lower case. A signature is an anchor with the next CHAIN content words
    within REACH words, if there is one. Anchors are the common words and, where none of the REACH words before is
    one, every word; so what a place gives depends on the words around it alone, and texts that share most of their
    words share most of their signatures, in any language. A text of common words alone, or of none, has one fixed
    signature, so equal texts always have equal sets.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    df = df.withColumn("_w", common.once(words))
    df = df.withColumn("_c", common.once(F.transform("_w", lambda x: F.when(x.isin(COMMON), F.lit("")).otherwise(x))))
    n = F.size("_w")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    chain = lambda i: F.slice(F.filter(F.slice("_c", i + 2, REACH), lambda x: x != ""), 1, CHAIN)
    digest = lambda *x: F.shiftright(F.xxhash64(*x), 32).cast("int")
    bare = lambda i: ~F.exists(F.slice("_c", F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH))), lambda x: x == "")
    anchors = F.filter(places, lambda i: F.when(F.get("_c", i) == "", F.lit(True)).otherwise(bare(i)))
    spots = F.transform(anchors, lambda i: F.struct(F.get("_w", i).alias("a"), chain(i).alias("c"), (F.get("_c", i) != "").alias("own")))
    spots = F.transform(F.filter(spots, lambda s: s["own"] | (F.size(s["c"]) > 0)), lambda s: digest(s["a"], s["c"]))
    df = df.withColumn("_spots", common.once(F.array_distinct(spots)))
    none = F.array(F.when(n == 0, F.lit(0)).otherwise(digest("_w")))
    return df.withColumn(out, common.once(F.sort_array(F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(none)))).drop("_w", "_c", "_spots")


def fingerprint(signatures: str) -> Column:
    """The signatures as eight hex digits each."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two signature columns."""
    same = F.size(F.array_intersect(a, b))
    return same / (F.size(a) + F.size(b) - same)


def frequent(classes: DataFrame) -> DataFrame:
    """A row: often, the array of signatures with one of FREQUENT places or more (FREQUENT of them at most), and weight,
    the number of places of each of the SLOTS slots.

    Places are counted by slots of signatures first, so that only signatures of full slots are counted by themselves.
    """
    each = classes.select(F.explode("s").alias("x"))
    slots = common.written(each.groupBy(F.pmod("x", F.lit(SLOTS)).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "spotsigs-slots")
    least = (slots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + FREQUENT - 1) // FREQUENT
    full = F.broadcast(slots.filter(F.col("n") >= max(1, least)).select("slot"))  # FREQUENT at most
    counts = each.withColumn("slot", F.pmod("x", F.lit(SLOTS))).join(full, "slot", "left_semi").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter(F.col("n") >= max(1, least)).agg(F.collect_list("x").alias("often"))
    every = classes.sparkSession.range(SLOTS).select(F.col("id").alias("slot")).join(F.broadcast(slots), "slot", "left")
    most = F.least(F.coalesce("n", F.lit(0)), F.lit((1 << 31) - 1)).cast("int")
    weight = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", most.alias("n")))), lambda x: x["n"]).alias("weight"))
    return often.crossJoin(F.broadcast(weight))


def rarest_first(signatures: Column) -> Column:
    """The signatures by the weight of their slots (column weight), then by themselves; as numbers that sort so."""
    low = F.lit(1 << 31)
    keyed = F.transform(signatures, lambda x: F.get("weight", F.pmod(x, F.lit(SLOTS))).cast("long") * F.lit(1 << 32) + (x.cast("long") + low))
    return F.transform(F.sort_array(keyed), lambda v: (v.bitwiseAND(F.lit((1 << 32) - 1)) - low).cast("int"))


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness) of an asked class a and another class b that are at least `threshold` alike.

    classes: key, s (a set of signatures), asked. Sets are partitioned by length: with bounds a factor threshold
    apart, a set's partners lie in its partition or one beside it. Of each set only a prefix is joined, rare
    signatures first, so long that sets without a common one in it cannot reach the threshold. How rare one is, its
    slot's count tells: so near copies of one text first join what is their own, and meet by what they all share only
    if little is. What stands behind a common signature in the shorter rest bounds how many there are in common (none
    stands before the first); pairs that cannot reach the threshold are pruned before sets are compared. The asked sets of a partition and signature stand together
    in rows of some TOGETHER, so a set meets rows and not pairs, and a pair is made at its first common signature only.
    The asked sets are broadcast, in portions of a bounded size; every set is read beside each portion and compared
    there, so neither sets nor candidate pairs are shuffled, however many pairs a dense group has.
    """
    n = F.size("s")
    often = F.broadcast(frequent(classes).withColumn("one", F.lit(1)))  # a row
    rare_first = F.concat(rarest_first(F.array_except("s", "often")), rarest_first(F.array_intersect("s", "often")))
    part = F.floor(F.log(n) / -math.log(threshold)).cast("int")
    reach = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    rows = common.written(classes.withColumn("one", F.lit(1)).join(often, "one").select("key", "asked", n.alias("n"), part.alias("part"), reach.alias("reach"), rare_first.alias("s")), "spotsigs-prefixes")
    held = rows.filter("asked").agg(F.sum(F.col("n") + 15 * F.col("reach") + 8)).first()[0] or 0
    portions = -(-held // max(MAX_HELD, MIN_HELD)) or 1
    every = rows.select(F.col("key").alias("b"), F.col("n").alias("nb"), "part", F.col("s").alias("sb"), F.posexplode(F.slice("s", F.lit(1), F.col("reach"))).alias("at", "sig"))
    found = None
    for k in range(portions):
        own = rows.filter("asked").filter(F.pmod(F.xxhash64("key"), F.lit(portions)) == k)
        near = own.select("key", "n", F.slice("s", F.lit(1), F.col("reach")).alias("prefix"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
        near = near.select("key", "n", "part", F.posexplode("prefix").alias("at", "sig")).withColumn("rest", F.col("n") - F.col("at"))
        crowd = near.groupBy("part", "sig").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("crowd"))
        near = near.join(crowd, ["part", "sig"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("crowd")))
        who = F.broadcast(near.groupBy("part", "sig", "salt").agg(F.collect_list(F.struct("key", "n", "rest")).alias("who")).drop("salt"))
        sets = F.broadcast(own.select(F.col("key").alias("a"), F.col("s").alias("sa"), F.slice("s", F.lit(1), F.col("reach")).alias("pa")))
        fits = lambda w: (w["key"] != F.col("b")) & (F.least(w["rest"], F.col("nb") - F.col("at")) >= (w["n"] + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6)
        met = every.join(who, ["part", "sig"]).select("b", "sb", "at", F.explode(F.transform(F.filter("who", fits), lambda w: w["key"])).alias("a"))
        met = met.join(sets, "a").filter(~F.arrays_overlap(F.slice("sb", F.lit(1), F.col("at")), "pa")).select("a", "b", common.once(likeness("sa", "sb")).alias("likeness"))
        found = met if found is None else found.unionByName(met)
    return common.written(found.filter(F.col("likeness") >= threshold), "spotsigs-pairs")


def classes_of(sets: DataFrame) -> DataFrame:
    """key (the row's own), s, asked and members of each distinct set of a table with key, s and asked."""
    return common.written(sets.groupBy("key").agg(F.first("s").alias("s"), F.max("asked").alias("asked"), F.count(F.lit(1)).alias("members")), "spotsigs-classes")


def search(queries: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query_id, doc_id, likeness) of documents at least `threshold` like a query; ids other than the query's own.

    Texts with equal sets are compared once, as a class. Repeated rows count each; a null id is not paired.
    """
    def prepared(df: DataFrame, asked: bool) -> DataFrame:
        df = with_signatures(df.select("doc_id", "text"), "text", "s").drop("text")
        return df.select("doc_id", F.md5(fingerprint("s")).alias("key"), "s", F.lit(asked).alias("asked"))

    every = common.written(prepared(queries, True).unionByName(prepared(docs, False)), "spotsigs-sets")
    classes = classes_of(every)
    own = classes.filter("asked").select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("likeness"))
    found = links(classes, threshold).unionByName(own)
    found = found.join(every.filter("asked").select(F.col("key").alias("a"), F.col("doc_id").alias("query_id")), "a")
    found = found.join(every.filter("not asked").select(F.col("key").alias("b"), "doc_id"), "b").filter("query_id <> doc_id")
    return found.select("query_id", "doc_id", "likeness")


def range_of(df: DataFrame, buckets: int) -> Column:
    """The range of (_id, _tie), from 0, that a row lies in: ranges hold about as many rows, as Spark samples them.

    Rows of one id are dealt out by _tie; those equal in both stay together. A bound is looked up in two steps.
    """
    ranges = df.select("_id", "_tie").repartitionByRange(buckets, "_id", "_tie").withColumn("k", F.spark_partition_id())
    ends = sorted((r["m"]["_id"], r["m"]["_tie"]) for r in ranges.groupBy("k").agg(F.max(F.struct("_id", "_tie")).alias("m")).collect())[:-1]  # a row a range
    step = math.isqrt(len(ends)) + 1
    inner = [ends[k : k + step] for k in range(0, len(ends), step)] or [[]]
    entry = lambda e: {"i": e[0], "t": e[1]}
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    below = lambda ends: F.size(F.filter(ends, lambda e: (e["i"] < F.col("_id")) | ((e["i"] == F.col("_id")) & (e["t"] < F.col("_tie")))))
    outer = below(literal([entry(x[-1]) for x in inner[:-1]], "array<struct<i: bigint, t: bigint>>"))
    within = F.get(literal([[entry(e) for e in x] for x in inner], "array<array<struct<i: bigint, t: bigint>>>"), outer)
    return (outer * step + below(within)).cast("int")


def beside_next(df: DataFrame, carry: list[str], prepared: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds next_<column> for `carry`: the values of the next row in descending (_id, _tie); the last row's is the first.

    Rows are dealt into ranges with about BUCKET_ROWS rows, so each task orders one range; the first row of a range is
    copied to the range before it in the order. `prepared` adds columns to the rows before they are dealt, so that
    carried ones are computed once and not for both neighbours.
    """
    rows = df.count()
    if not rows:
        df = prepared(df)
        return df.withColumns({f"next_{c}": F.col(c) for c in carry})
    spark, buckets = df.sparkSession, max(1, -(-rows // BUCKET_ROWS))
    dealt = df.withColumn("bucket", range_of(df, buckets))
    heads = {r["bucket"]: r["m"] for r in dealt.groupBy("bucket").agg(F.max(F.struct("_id", "_tie")).alias("m")).collect()}  # a row a bucket
    order = sorted(heads)
    above = [(heads[b]["_id"], heads[b]["_tie"], order[(k + 1) % len(order)]) for k, b in enumerate(order)]
    first = F.broadcast(spark.createDataFrame(above, "_id long, _tie long, bucket int"))
    copies = df.join(first, ["_id", "_tie"]).withColumn("_copy", F.lit(True))
    every = prepared(dealt.withColumn("_copy", F.lit(False)).unionByName(copies))
    w = Window.partitionBy("bucket").orderBy("_copy", F.desc("_id"), F.desc("_tie"))
    return every.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry}).filter("not _copy").drop("_copy", "bucket")


def edited_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, own and new (the signatures of the text and of the edited text), near_edited and
    near_next; see edited_likeness."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", common.id_key().alias("_id"), text.alias("text")).withColumn("_tie", F.xxhash64("text"))
    df = beside_next(df, ["text", "own"], lambda rows: with_signatures(rows, "text", "own"))
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", common.once(edited))
    df = df.drop("text", "next_text").withColumn("edited_sha256", F.sha2("edited", 256))
    df = with_signatures(df, "edited", "new").drop("edited")
    return df.select("doc_id", "n_chars", "edited_sha256", "own", "new", likeness("own", "new").alias("near_edited"), likeness("own", "next_own").alias("near_next"))


def shown(sets: DataFrame, *more: str) -> DataFrame:
    return sets.select("doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("new").alias("edited_fingerprint"), "near_edited", "near_next", *more)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, own, a row per row.

    The edited text has its last third replaced by the start of the next document's text, by descending doc_id
    (a null id is the largest; rows of equal id follow a hash of their texts; after the last comes the first).
    A fingerprint is the whole set of signatures (column own) in hex: as long as the text has anchors.
    Null texts are empty. Other columns are ignored; an empty table gives no row.
    """
    return shown(edited_sets(docs), "own")


def fingerprinted(docs: DataFrame, every: int = 100, threshold: float = 0.8) -> DataFrame:
    """The columns of edited_likeness without own, and n_similar: for rows whose id `every` divides, how many other
    rows are at least `threshold` like them; null for others.

    Rows with equal sets are one class, whose set is that of one of them; classes are searched and not rows.
    """
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    rows = edited_sets(docs).withColumn("key", F.md5(F.col("own").cast("string"))).withColumn("asked", asked)
    rows = common.written(rows.withColumn("_row", F.monotonically_increasing_id()), "spotsigs-rows")
    sizes = rows.groupBy("key").agg(F.min("_row").alias("_row"), F.max("asked").alias("asked"), F.count(F.lit(1)).alias("members"))
    sizes = common.written(sizes, "spotsigs-classes")
    classes = rows.select("_row", F.col("own").alias("s")).join(common.smaller(sizes, MAX_ROWS), "_row").select(F.col("_row").alias("key"), "s", "asked")
    found = links(classes, threshold).join(sizes.select(F.col("_row").alias("b"), "members"), "b").groupBy(F.col("a").alias("_row")).agg(F.sum("members").alias("others"))
    counts = sizes.filter("asked").join(found, "_row", "left").select("key", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"))
    out = rows.join(common.smaller(common.written(counts, "spotsigs-counts"), MAX_ROWS), "key", "left")
    return shown(out.withColumn("n_similar", F.when(F.col("asked"), F.col("n_similar"))), "n_similar")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the contract's columns, and for every id that 100 divides the number of rows like it at 0.8 or more."""
    return fingerprinted(common.documents(spark, sf_dir))
