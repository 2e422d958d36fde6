"""Substring dedup by relative Lempel-Ziv parsing against every indexed block of the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Words of an anchor, the word sequence by which passages are found; at most the window's.
ANCHOR = 6
#: Beyond so many repeated anchors (8 bytes each), documents get theirs by a join and not by a broadcast.
MAX_ANCHORS = 8_000_000
#: Beyond so many rows, or so many spans in them, documents get theirs by a shuffle join and not by a broadcast.
MAX_ROWS, MAX_SPANS = 1_000_000, 4_000_000
#: Words of a reference block.
BLOCK = 64
#: Bytes of text looked at together; the arrays over their words take some twenty times as much.
PORTION = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each run of width."""
    have, step = x, 1
    while 2 * step <= width:
        have, step = f(have[:-step], have[step:]), 2 * step
    return f(have[: len(have) - (width - step)], have[width - step :]) if step < width else have


class Batch:
    """The words of some texts in one array of hashes, with the starts of the windows that lie within one text."""

    def __init__(self, texts: list[bytes | None], window: int, anchor: int, bits: int = 64):
        hashes = [common.word_hashes(text) for text in texts]
        self.kept = np.uint64((1 << bits) - 1)
        self.lengths = np.array([len(x) for x in hashes], "i8")
        hashes = np.concatenate([np.zeros(0, "u8"), *hashes])
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        n = len(hashes)
        power, back = np.full(n + 1, BASE, "u8"), np.full(n + 1, INVERSE, "u8")
        power[0] = back[0] = 1
        self.prefix = np.concatenate([np.zeros(1, "u8"), np.cumsum(hashes * np.cumprod(power)[:n], dtype="u8")])
        self.back = np.cumprod(back)
        spare = np.maximum(self.lengths - window + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), spare)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(spare) - spare, spare)  # the window's place in its text
        self.start = self.first[self.doc] + self.at
        self.window, self.anchor, self.n = window, anchor, n

    def grams(self, k: int) -> np.ndarray:
        return mixed((self.prefix[k:] - self.prefix[: self.n - k + 1]) * self.back[: self.n - k + 1]) & self.kept

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window the least anchor, and, by place, the anchors that are some window's least.

        Equal windows have the same least anchor, so a window occurs twice only if its least anchor does.
        """
        if not len(self.start):
            return np.zeros(0, "u8"), np.zeros(0, "u8")
        width = self.window - self.anchor + 1
        grams = self.grams(self.anchor)
        least = np.zeros(len(grams) + width - 1, "u8")
        low = sliding(grams, width, np.minimum)
        least[self.start + width - 1] = low[self.start]
        best = sliding(least, width, np.maximum)  # over the windows that hold the place
        return low[self.start], grams[best == grams]


def candidates(of: np.ndarray, start: np.ndarray, source: np.ndarray, number: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document, [start, length, source, its number, source start]) of runs of windows that follow each other in one source.

    Each window that the index knows comes with its document, its start, and where the index says it first starts;
    one that comes twice, because rows repeat, counts once.
    """
    order = np.lexsort((start, of))
    of, start, source, number, at = (x[order] for x in (of, start, source, number, at))
    step = lambda x: np.diff(x, prepend=x[:1])
    once = (step(of) != 0) | (step(start) != 0)
    once[:1] = True
    of, start, source, number, at = (x[once] for x in (of, start, source, number, at))
    new = (step(of) != 0) | (step(start) != 1) | (step(source) != 0) | (step(number) != 0) | (step(at) != 1)
    new[:1] = True
    first = np.flatnonzero(new)
    return of[first], [start[first], np.diff(np.append(first, len(of))) + window - 1, source[first], number[first], at[first]]


def longest(words: list[bytes], start: int, blocks: dict[tuple, list[bytes]], source: tuple[int, int], at: int) -> int:
    """How many words from `start` on are those of the source's blocks from `at` on."""
    n = 0
    while (block := blocks.get((*source, (at + n) // BLOCK))) is not None:
        theirs = block[(at + n) % BLOCK :]
        mine = words[start + n : start + n + len(theirs)]
        if mine != theirs:
            return n + next((k for k, (x, y) in enumerate(zip(mine, theirs)) if x != y), min(len(mine), len(theirs)))  # noqa: B905
        n += len(theirs)
        if len(block) < BLOCK:
            break
    return n


def parsed(words: list[bytes], runs: list[tuple[int, int, int, int, int]], blocks: dict[tuple, list[bytes]], window: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Greedy parse of one document: ((start, length, source, its number, source start) of its factors, doubts).

    At each window that the index knows and no factor holds yet, the factor grows over the words of the reference
    blocks for as long as they are the document's own; it may run on past what the index named. It counts if it has
    at least `window` words. Where it ends, at a factor boundary, the parse goes on with the first window that is not
    wholly in it, so windows across a boundary are held to a block of their own. A window whose words are not those
    of its block, because hashes clash, is a doubt.
    """
    out, doubts, done = [], [], -1
    for start, length, source, number, at in sorted(runs):
        p = max(start, done + 1)
        while p <= start + length - window:
            n = longest(words, p, blocks, (source, number), at + p - start)
            if n >= window:
                out.append((p, n, source, number, at + p - start))
                done = p + n - window
            else:
                doubts.append(p)
                done = p
            p = done + 1
    return out, doubts


def spans(factors: list[tuple[int, ...]]) -> list[int]:
    """The words that factors cover, as runs (start * 2^31 + length) that do not touch."""
    out: list[list[int]] = []
    for start, length, *_ in factors:
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length])
    return [(a << 31) + n for a, n in out]


def numbers(docs: DataFrame) -> DataFrame:
    """_id, _digest and _num (from 0) of texts that share their id with another text."""
    each = docs.select(common.id_key().alias("_id"), digest().alias("_digest")).distinct()
    shared = common.written(each.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "substring-shared-ids")
    ranked = common.spread_rank(each.join(common.smaller(shared, MAX_ROWS), "_id"), ["_id"], ["_digest"], "n")
    return common.written(ranked.select("_id", "_digest", F.col("rank").alias("_num")), "substring-numbers")


def digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def keyed(rows: DataFrame, shared: DataFrame, limit: int) -> DataFrame:
    """rows (with _id and _digest) and _num: a document is its id and its text, so rows that repeat both are one."""
    if shared.isEmpty():
        return rows.withColumn("_num", F.lit(0).cast("long"))
    return rows.join(common.smaller(shared, limit), ["_id", "_digest"], "left").withColumn("_num", F.coalesce("_num", F.lit(0)))


def position() -> Column:
    """Where a window is among those of its id: by its text's number, then by its start."""
    return F.shiftleft(F.col("_num"), 31) + F.col("start")


KEY, SOURCE = ["_id", "_num"], ["source", "source_num"]
FACTORS = "array<struct<start int, length int, source long, source_num long, source_start int>>"
FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_num", pa.int64()), ("source_start", pa.int32())])
as_factors = lambda rows: pa.array([[dict(zip(FACTOR.names, f, strict=True)) for f in row] for row in rows], pa.list_(FACTOR))
from_factors = lambda row: [tuple(x[n] for n in FACTOR.names) for x in row.as_py()]


def duplicate_factors(docs: DataFrame, window: int = 20, anchor: int = ANCHOR, max_anchors: int = MAX_ANCHORS, max_rows: int = MAX_ROWS, bits: int = 64, shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with repeated passages: _id, _num, factors, spans; exact copies of earlier documents: _id, _num).

    1. Later copies of equal texts are whole factors of the first and take no further part.
    2. Every block of the rest is indexed: anchors found once cannot lie in a repeated window, so of the windows
       around repeated anchors the index names the first occurrence, by a hash of `bits` bits.
    3. The reference blocks that it names are written, and sent to the documents that repeat their words.
    4. Each document is parsed greedily against those blocks, word by word; factors give the spans. Windows whose
       words are not those of their block are few (hashes clash); they are grouped by their words themselves.
    """
    common.ready(docs)
    shared = numbers(docs) if shared is None else shared
    rows = keyed(docs.select(common.id_key().alias("_id"), digest().alias("_digest"), F.col("text").cast("string").cast("binary").alias("text")), shared, max_rows)
    texts = rows.filter(F.length("text") > 0).select(*KEY, "_digest")
    lead = texts.groupBy("_digest").agg(F.min("_id").alias("_lead"), F.max("_id").alias("_last")).filter("_lead < _last")
    lead = common.written(lead.drop("_last"), "substring-leads")  # so that the join below can split a text found very often
    copies = common.written(texts.join(common.smaller(lead, max_rows), "_digest").filter("_id > _lead").select(*KEY).distinct(), "substring-copies")
    rest = rows.drop("_digest").join(common.smaller(copies, max_rows), KEY, "left_anti")

    def index(batches):
        common.forget()
        for batch in common.portions(batches, "text", PORTION):
            _, found = Batch(batch.column(0).to_pylist(), window, anchor, bits).anchors()
            anchors, n = np.unique(found, return_counts=True)
            yield pa.record_batch([pa.array(anchors.view("i8")), pa.array(n)], ["anchor", "n"])

    counts = rest.select("text").mapInArrow(index, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    repeated = common.written(counts.filter("n > 1").select("anchor"), "substring-anchors")

    if repeated.count() <= max_anchors:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(repeated.toArrow().column("anchor").to_numpy().astype("i8").view("u8")))
        rest = rest.withColumn("_anchors", F.lit(None).cast("array<long>"))
    else:
        known = None

        def own(batches):
            for batch in common.portions(batches, "text", PORTION):
                b = Batch(batch.column(2).to_pylist(), window, anchor, bits)
                low, _ = b.anchors()
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (b.doc[1:] != b.doc[:-1])
                of = pa.array(b.doc[new])
                yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), pa.array(low[new].view("i8"))], ["_id", "_num", "anchor"])

        mine = rest.mapInArrow(own, "_id long, _num long, anchor long").join(repeated, "anchor").groupBy("_id", "_num").agg(F.collect_set("anchor").alias("_anchors"))
        rest = rest.join(mine, ["_id", "_num"])

    def windows(batches):
        for batch in common.portions(batches, "text", PORTION):
            b = Batch(batch.column(2).to_pylist(), window, anchor, bits)
            low, _ = b.anchors()
            if not len(low):
                continue
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (b.doc[1:] != b.doc[:-1])
            head = low[new]
            if known is not None:
                place = np.searchsorted(known.value, head)
                live = np.zeros(len(head), bool) if not len(known.value) else known.value[np.minimum(place, len(known.value) - 1)] == head
            else:
                live, of = np.zeros(len(head), bool), b.doc[new]
                for d in np.unique(of):
                    mine = np.array(batch.column(3)[int(d)].as_py(), "i8").view("u8")
                    live[of == d] = np.isin(head[of == d], mine)
            keep = np.flatnonzero(live[np.cumsum(new) - 1])
            ids, nums = (batch.column(k).to_numpy(zero_copy_only=False)[b.doc[keep]] for k in (0, 1))
            grams = b.grams(window)[b.start[keep]].view("i8")
            for k in range(0, len(keep), 50_000):
                part = slice(k, k + 50_000)
                yield pa.record_batch([pa.array(x[part]) for x in (grams, ids, nums, b.at[keep])], ["gram", "_id", "_num", "start"])

    found = rest.select("_id", "_num", "text", "_anchors").mapInArrow(windows, "gram long, _id long, _num long, start long")
    found = common.written(found.select("gram", "_id", position().alias("at")), "substring-windows")
    first = found.groupBy("gram").agg(F.min(F.struct("_id", "at")).alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select("gram", F.col("_first._id").alias("source"), F.col("_first.at").alias("source_at"))
    first = common.written(first, "substring-index")  # so that the join below can split a window found very often
    later = found.join(first, "gram").filter("_id > source or (_id = source and at > source_at)")
    start, number = (lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")), (lambda c: F.shiftright(c, 31))
    match = F.struct(start("at").alias("start"), F.col("source"), number("source_at").alias("source_num"), start("source_at").alias("source_start"))
    lists = later.groupBy("_id", number("at").alias("_num")).agg(F.collect_list(match).alias("matches"))  # at most a document's words

    def join_up(batches):
        for batch in batches:
            lists, flat = batch.column(2), batch.column(2).flatten()
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            of, found = candidates(of, *(flat.field(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("start", *SOURCE, "source_start")), window)
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype("i4")
            found = pa.StructArray.from_arrays([pa.array(x).cast(f.type) for x, f in zip(found, FACTOR, strict=True)], fields=list(FACTOR))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), found)], [*KEY, "runs"])

    runs = common.written(lists.mapInArrow(join_up, f"_id long, _num long, runs {FACTORS}"), "substring-runs")
    r = runs.select(*KEY, F.explode("runs").alias("r"))
    block = F.sequence((F.col("r.source_start") / BLOCK).cast("int"), ((F.col("r.source_start") + F.col("r.length") - 1) / BLOCK).cast("int"))
    wanted = common.written(r.select(*KEY, "r.source", "r.source_num", F.explode(block).alias("block")).distinct(), "substring-wanted")
    named = wanted.select(*SOURCE, "block").distinct().groupBy(F.col("source").alias("_id"), F.col("source_num").alias("_num")).agg(F.collect_list("block").alias("blocks"))
    named = common.written(named, "substring-named")

    def cut(batches):
        for batch in batches:
            for k, (text, own) in enumerate(zip(batch.column("text"), batch.column("blocks"), strict=True)):
                words, own = text.as_py().split(), own.as_py()
                parts = [b" ".join(words[b * BLOCK : (b + 1) * BLOCK]) for b in own]
                yield pa.record_batch([*(pa.array([batch.column(c)[k].as_py()] * len(own), pa.int64()) for c in KEY), pa.array(own, pa.int32()), pa.array(parts, pa.binary())], [*SOURCE, "block", "words"])

    texts = rest.select(*KEY, "text")
    blocks = meet(texts, named, "blocks", max_rows).mapInArrow(cut, "source long, source_num long, block int, words binary")
    blocks = common.written(blocks.distinct() if not shared.isEmpty() else blocks, "substring-blocks")  # repeated rows give theirs again
    given = wanted.join(blocks, [*SOURCE, "block"]).groupBy(*KEY).agg(F.collect_list(F.struct(*SOURCE, "block", "words")).alias("blocks"))

    def parse(batches):
        for batch in batches:
            out, covered, doubts = [], [], []
            for text, row, own in zip(*(batch.column(c) for c in ("text", "runs", "blocks")), strict=True):
                own = {(x["source"], x["source_num"], x["block"]): x["words"].split() for x in own.as_py()}
                factors, doubt = parsed(text.as_py().split(), from_factors(row), own, window)
                out.append(factors)
                covered.append(spans(factors))
                doubts.append(doubt)
            yield pa.record_batch([*(batch.column(c) for c in KEY), as_factors(out), pa.array(covered, pa.list_(pa.int64())), pa.array(doubts, pa.list_(pa.int32()))], [*KEY, "factors", "spans", "doubts"])

    mine = texts.join(common.smaller(runs.select(*KEY), max_rows), KEY, "left_semi").join(runs, KEY).join(given, KEY)
    done = mine.select(*KEY, "text", "runs", "blocks").mapInArrow(parse, f"_id long, _num long, factors {FACTORS}, spans array<long>, doubts array<int>")
    done = common.written(done, "substring-factors")
    doubts = done.select(*KEY, F.explode("doubts").alias("start"))
    done = done.drop("doubts")
    if doubts.isEmpty():
        return done, copies
    more = by_words(texts, found, doubts.select("_id", position().alias("at")).distinct(), window)
    both = done.unionByName(more).groupBy(*KEY).agg(F.flatten(F.collect_list("factors")).alias("factors"), F.flatten(F.collect_list("spans")).alias("spans"))
    return common.written(both, "substring-factors"), copies


def meet(texts: DataFrame, rows: DataFrame, column: str, max_rows: int) -> DataFrame:
    """texts joined with rows of one array each on their key: by a broadcast if both rows and array entries are few."""
    n, entries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return texts.join(F.broadcast(rows) if n <= max_rows and entries <= MAX_SPANS else rows, KEY)


def by_words(texts: DataFrame, found: DataFrame, doubts: DataFrame, window: int) -> DataFrame:
    """Factors of one window each, where windows with the hash of a doubt also occur earlier, by their words."""
    grams = common.written(found.join(doubts, ["_id", "at"]).select("gram").distinct(), "substring-doubts")
    where = found.join(grams, "gram", "left_semi").select("_id", F.shiftright("at", 31).alias("_num"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("start"))
    where = where.groupBy(*KEY).agg(F.collect_set("start").alias("starts"))

    def spell(batches):
        for batch in batches:
            for k, (text, starts) in enumerate(zip(batch.column("text"), batch.column("starts"), strict=True)):
                words, starts = text.as_py().split(), starts.as_py()
                for i in range(0, len(starts), 10_000):
                    part = starts[i : i + 10_000]
                    key = [pa.array([batch.column(c)[k].as_py()] * len(part), pa.int64()) for c in KEY]
                    yield pa.record_batch([*key, pa.array(part, pa.int32()), pa.array([b" ".join(words[x : x + window]) for x in part], pa.binary())], [*KEY, "start", "words"])

    spelled = texts.join(where, KEY).mapInArrow(spell, "_id long, _num long, start int, words binary").distinct()
    spelled = common.written(spelled.withColumn("at", position()), "substring-spelled")
    first = spelled.groupBy("words").agg(F.min(F.struct("_id", "at")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = spelled.join(common.written(first, "substring-spelled-first"), "words").filter("_id > f._id or (_id = f._id and at > f.at)")
    factor = F.struct("start", F.lit(window).alias("length"), F.col("f._id").alias("source"), F.shiftright("f.at", 31).alias("source_num"), F.col("f.at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("source_start"))
    span = F.shiftleft(F.col("start").cast("long"), 31) + window
    return later.groupBy(*KEY).agg(F.collect_list(factor).alias("factors"), F.collect_list(span).alias("spans"))


def deduplicated(docs: DataFrame, window: int = 20, **bounds: int) -> DataFrame:
    """The rows of docs (as _row) with kept_text (kept words joined by one space), n_words, n_removed and n_spans.

    A word goes if it lies in a window of `window` words whose words also start earlier: in a document of smaller
    id, or in the same one. Windows are judged on the input. Texts are split at ASCII white space only. Null texts
    have no words; a null id counts as the largest; rows that repeat id and text are one document, and texts that
    share an id come one after the other in a fixed order. A column of docs may have any name; an empty table gives
    no row.
    """
    shared, limit = numbers(docs), bounds.get("max_rows", MAX_ROWS)
    found, copies = duplicate_factors(docs, window, shared=shared, **bounds)
    marks = found.drop("factors").withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)), allowMissingColumns=True)
    text = F.col("_row.text").cast("string")
    rows = docs.select(F.struct(*map(common.named, docs.columns)).alias("_row"), common.id_key().alias("_id"), digest().alias("_digest"))
    n, entries = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.coalesce("spans", F.array().cast("array<bigint>")))), F.lit(0))).first()
    marks = F.broadcast(marks) if n <= limit and entries <= MAX_SPANS else marks  # both bound what is sent
    rows = keyed(rows, shared, limit).join(marks, KEY, "left").withColumn("_text", text.cast("binary"))

    def cut(batches):
        for batch in batches:
            texts, n, removed, runs = [], [], [], []
            at = {name: k for k, name in enumerate(batch.schema.names)}
            for text, cut_out, copy in zip(batch.column(at["_text"]), batch.column(at["spans"]), batch.column(at["_copy"]), strict=True):
                own = (text.as_py() or b"").split()
                n.append(len(own))
                runs.append(int(bool(copy.as_py()) and len(own) >= window) or len(cut_out.as_py() or ()))
                if copy.as_py() and len(own) >= window:
                    own = []
                elif not copy.as_py() and cut_out.is_valid:
                    keep = np.ones(len(own), bool)
                    for run in cut_out.as_py():
                        keep[run >> 31 : (run >> 31) + (run & (1 << 31) - 1)] = False
                    own = [own[k] for k in np.flatnonzero(keep)]
                texts.append(b" ".join(own).decode())
                removed.append(n[-1] - len(own))
            yield pa.record_batch([batch.column(at["_row"]), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (n, removed, runs))], ["_row", "kept_text", "n_words", "n_removed", "n_spans"])

    inner = rows.select("_row", "spans", "_copy", "_text")
    return inner.mapInArrow(cut, StructType([inner.schema["_row"], *StructType.fromDDL("kept_text string, n_words long, n_removed long, n_spans long")]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans of each row of docs."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"), "n_spans")


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that keep a word, or lost none, with the kept text and its length in n_chars."""
    out = deduplicated(docs).filter("kept_text <> '' or n_removed = 0")
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_row.text")), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("_row.n_chars"))}
    return out.select(*[new.get(f.name, F.col("_row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])


def query(spark, sf_dir: str) -> DataFrame:
    """op1 with windows of 20 words."""
    return digests(common.documents(spark, sf_dir))
