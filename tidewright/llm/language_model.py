"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: At most so many words have a relative frequency of one in as many; their exact counts are broadcast.
FREQUENT = 2_000_000
#: Text bytes for each of the filter's blocks of n-grams.
BLOCK_BYTES = 8 << 20
#: Bytes of the filter that are broadcast; a larger one stays in its blocks, and the n-grams are sent to them.
MAX_FILTER = 256 << 20
#: Text bytes that a worker scores at once beside the filter: some forty times as many bytes of arrays.
SCORED_BYTES = 1 << 20
#: Text bytes of a portion whose n-grams are sent to the filter's blocks, and n-grams that a block looks up at once.
SENT_BYTES, LOOKED_UP = 4 << 20, 1 << 18
#: For tables with rows of megabytes: pages and row groups are checked at every row (not every hundred), as the JVM
#: keeps a direct buffer of the largest page for each column that it compresses, and reads row groups whole.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20)}
#: Bits set for an entry, all in one 64-bit word, and bits for each of the filter's entries: some 2 % false positives a level.
PROBES, BITS = 4, 10
#: Counts that a word's share in all tokens (then the pair model's probability) weighs in the pair (triple) model.
PRIOR, TRIPLE_PRIOR = 300.0, 10.0
#: Stands for a text's end, and for what comes before its first word. No word has this hash: no word is empty.
END = np.uint64(xxhash.xxh64_intdigest(b""))
ODD = np.uint64(0x9E3779B97F4A7C15)
WORDS, PAIRS, TRIPLES = range(3)
#: (kind, k, n): n-grams are sent in rounds, the k-th of n parts of a kind's blocks in each, so that no more of them are on
#: disk at once; a round reads the portions again.
ROUNDS = ((WORDS, 0, 1), (PAIRS, 0, 1), (TRIPLES, 0, 2), (TRIPLES, 1, 2))
#: Bytes that tell the n-grams of a block apart; the bits above choose the block, so blocks of a bounded size keep
#: about one pair in a million n-grams from being told apart, whatever the corpus.
KEY_BYTES = 5
LOW = np.uint64((1 << 8 * KEY_BYTES) - 1)


def stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tokens(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in a row (each text's words, then its end), and the tokens of each."""
    own = [np.append(common.word_hashes(t.as_py(), lower), END) for t in texts]
    return np.concatenate([np.zeros(0, "u8"), *own]), np.array([len(x) for x in own], "i8")


def grams(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the hash of it and the one before (the end, for a first one), that of it and the two before,
    and whether it is a text's first, which has no triple."""
    before, pairs = np.empty_like(words), np.empty_like(words)
    first = np.zeros(len(words), bool)
    if len(words):
        first[np.cumsum(lengths) - lengths] = True
        before[1:], before[0] = words[:-1], END  # each text ends with END, so a first word has END before it
        both = stir(stir(before) * ODD + words)
        pairs[1:], pairs[0] = both[:-1], END
        return both, stir(stir(pairs) * ODD + words), first
    return before, pairs, first


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log2 count)."""
    return np.frexp(counts.astype("f8"))[1]


def least(q: np.ndarray) -> np.ndarray:
    """The smallest count of a level."""
    return np.where(q > 0, 1 << np.maximum(q - 1, 0).astype("i8"), 0)


def most(q: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    return (1 << q.astype("i8")) - 1


def entry(keys: np.ndarray, q: int, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where an n-gram of level q is entered: the word of `size` words, and the places of its bits there."""
    a = stir((keys & LOW) + np.uint64(q * int(ODD) & (1 << 64) - 1))
    return (a >> np.uint64(32)) * size >> np.uint64(32), [(a >> np.uint64(6 * k)) & np.uint64(63) for k in range(PROBES)]


def packed_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), "u1")
    out[:, :KEY_BYTES] = np.frombuffer(data, "u1").reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype("i8")


def runs(keys: np.ndarray, blocks: int) -> list[tuple[int, slice]]:
    """The blocks of ascending keys, with the run of each."""
    at = np.searchsorted(block_of(keys, blocks), np.arange(blocks + 1))
    return [(int(b), slice(at[b], at[b + 1])) for b in np.flatnonzero(np.diff(at))]


class Filter:
    """Blocks of a log-frequency Bloom filter, side by side: an n-gram of level q is entered at levels 1 to q."""

    def __init__(self, blocks: int, parts):
        """parts: (block, its bytes), each block once at most."""
        self.blocks, own = blocks, []
        self.size, self.base = np.zeros(blocks, "u8"), np.zeros(blocks, "u8")
        used = 0
        for k, part in parts:
            own.append(np.frombuffer(part, "<u8"))
            self.size[k], self.base[k] = len(own[-1]), used
            used += len(own[-1])
        self.data = np.concatenate([np.zeros(0, "u8"), *own])

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level by probing 1, 2, ... until one is absent: 0 if the first is."""
        out = np.zeros(len(keys), "i4")
        block = np.zeros(len(keys), "i8") if self.blocks == 1 else block_of(keys, self.blocks)
        size, base = self.size[block], self.base[block]
        alive = np.flatnonzero(size > 0)
        keys, size, base, q = keys[alive], size[alive], base[alive], 0
        while len(alive):
            q += 1
            word, bits = entry(keys, q, size)
            mask = np.zeros(len(keys), "u8")
            for b in bits:
                mask |= np.uint64(1) << b
            hit = np.flatnonzero(self.data[base + word] & mask == mask)
            alive, keys, size, base = alive[hit], keys[hit], size[hit], base[hit]
            out[alive] = q
        return out


def built(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter block of these n-grams."""
    q = level(counts)
    size = max(1, -(-int(q.sum()) * BITS // 64))
    data = np.zeros(size * 64, bool)
    for k in range(1, int(q.max(initial=0)) + 1):
        word, bits = entry(keys[q >= k], k, np.uint64(size))
        for b in bits:
            data[word * np.uint64(64) + b] = True
    return np.packbits(data, bitorder="little").tobytes()


def learned(train: DataFrame) -> tuple[DataFrame, int]:
    """The filter's blocks (kind; block; bits; and words' hashes and counts), and how many there are of a kind.

    Every n-gram seen is entered. Each portion of texts counts its n-grams first and sends one packed row a block,
    so a frequent n-gram costs a few bytes a portion.
    """
    size = train.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, min(1 << 20, -(-size // BLOCK_BYTES)))

    def count(batches):
        for batch in common.portions(batches, "text", 12 << 20):
            words, lengths = tokens(batch.column(0))
            both, three, first = grams(words, lengths)
            three = three[~first]
            for kind, keys in ((WORDS, words), (PAIRS, both), (TRIPLES, three)):
                keys, n = np.unique(keys, return_counts=True)
                some = runs(keys, blocks)
                packed, counts = [], []
                for _, run in some:
                    own, times = keys[run], n[run]
                    more = np.argsort(times == 1, kind="stable")  # those found more than once come first
                    packed.append(packed_keys(own[more]) if kind else own[more].tobytes())
                    counts.append(times[times > 1].astype("<u4").tobytes())
                at = np.array([b for b, _ in some], "i8")
                for k in range(0, len(some), 64):
                    part = slice(k, k + 64)
                    yield pa.record_batch([pa.array(np.full(len(at[part]), kind, "i4")), pa.array(at[part]), pa.array(packed[part], pa.binary()), pa.array(counts[part], pa.binary())], ["kind", "block", "keys", "counts"])
                keys = n = own = times = more = packed = counts = None
            del words, both, three, batch  # else they outlive portions' give_back

    def build(table):
        kind, block = table.column("kind")[0].as_py(), table.column("block")[0].as_py()
        keys, counts = [], []
        for k, n in zip(table.column("keys"), table.column("counts"), strict=True):
            own, more = unpacked_keys(k.as_py()) if kind else np.frombuffer(k.as_py(), "<u8"), np.frombuffer(n.as_py(), "<u4")
            keys.append(own)
            counts.append(np.concatenate([more, np.ones(len(own) - len(more), "<u4")]).astype("i8"))
        keys, of = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(of, np.concatenate(counts)).astype("i8")
        exact = [b"", b""] if kind else [keys.tobytes(), counts.tobytes()]
        return pa.table({"kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int64()), "bits": pa.array([built(keys, counts)], pa.binary()), "keys": pa.array(exact[:1], pa.binary()), "counts": pa.array(exact[1:], pa.binary())})

    packed = train.select("text").mapInArrow(count, "kind int, block long, keys binary, counts binary")
    made = packed.groupBy("kind", "block").applyInArrow(build, "kind int, block long, bits binary, keys binary, counts binary")
    return common.written(made, "lm-blocks", LARGE_ROWS), blocks


def vocabulary(blocks: DataFrame) -> DataFrame:
    """word (hash) and c of each training word."""

    def unpack(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(keys.as_py(), "<i8")), pa.array(np.frombuffer(counts.as_py(), "<i8"))], ["word", "c"])

    return blocks.filter(F.col("kind") == WORDS).select("keys", "counts").mapInArrow(unpack, "word long, c long")


@dataclass(frozen=True)
class Smoothing:
    """log10 of the probability of each token, from levels that `look(kind, keys)` finds."""

    denominator: int
    often: np.ndarray  # frequent words, ascending, and their exact counts
    counts: np.ndarray
    prior: float
    triple_prior: float

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Counts of frequent words; -1 for others."""
        if not len(self.often):
            return np.full(len(words), -1, "i8")
        at = np.minimum(np.searchsorted(self.often, words), len(self.often) - 1)
        return np.where(self.often[at] == words, self.counts[at], -1)

    def logs(self, words: np.ndarray, lengths: np.ndarray, look) -> tuple[np.ndarray, np.ndarray]:
        """(log10 P of each token, exact counts of the frequent ones)."""
        c = self.exact(words)
        low, high = c.copy(), c.copy()
        rare = np.flatnonzero(c < 0)
        q = look(WORDS, words[rare])
        low[rare], high[rare] = least(q), most(q)
        both, three, first = grams(words, lengths)
        context = np.empty_like(high)
        context[1:], context[:1] = high[:-1], high[-1:]  # the last token is an end too
        q = np.zeros(len(words), "i4")
        seen = np.flatnonzero((low > 0) & (context > 0))
        q[seen] = look(PAIRS, both[seen])
        n = np.minimum(least(q), np.minimum(low, context))  # a pair is no more frequent than its words
        p = (n + self.prior * (low + 1) / self.denominator) / (context + self.prior)
        wide = np.zeros_like(context)
        wide[1:] = np.minimum(most(q), np.minimum(high, context))[:-1]
        wide[first] = 0
        triples = np.zeros_like(n)
        seen = np.flatnonzero((n > 0) & (wide > 0))
        triples[seen] = np.minimum(least(look(TRIPLES, three[seen])), np.minimum(n[seen], wide[seen]))
        p = np.where(first, p, (triples + self.triple_prior * p) / (wide + self.triple_prior))
        return np.log10(p), c


SCORES = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<long>, times array<long>"


def sums(row: int, ids: pa.Array, held: pa.Array, words: np.ndarray, lengths: np.ndarray, model: Smoothing, look) -> pa.RecordBatch:
    """A row per text, in the columns of SCORES: what its frequent words add to the base score, and its rare words."""
    p, c = model.logs(words, lengths, look)
    known, at = c >= 0, np.cumsum(lengths) - lengths
    add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0, x.dtype)
    of, rare = np.repeat(np.arange(len(lengths)), lengths)[~known], words[~known]
    order = np.lexsort((rare, of))
    of, rare = of[order], rare[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), (of[1:] != of[:-1]) | (rare[1:] != rare[:-1])]))
    times, ends = np.diff(np.append(new, len(of))), np.searchsorted(of[new], np.arange(len(lengths) + 1)).astype("i4")
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rare[new].view("i8"), times.astype("i8"))]
    cols = [pa.array(row + np.arange(len(lengths))), ids, held, pa.array(lengths), pa.array(add(known.astype("i8"))), pa.array(add(np.where(known, np.log10(np.maximum(c, 0) + 1), 0.0))), pa.array(add(p)), *lists]
    return pa.record_batch(cols, ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare", "times"])


def scored_by_broadcast(rows: DataFrame, blocks: DataFrame, n_blocks: int, model) -> DataFrame:
    """The columns of SCORES; workers hold the whole filter, of MAX_FILTER bytes at most."""
    parts = lambda kind: ((r["block"], r["bits"]) for r in blocks.filter(F.col("kind") == kind).select("block", "bits").toLocalIterator())
    known = rows.sparkSession.sparkContext.broadcast([Filter(n_blocks, parts(kind)) for kind in (WORDS, PAIRS, TRIPLES)])

    def work(batches):
        row, look = TaskContext.get().partitionId() << 40, lambda kind, keys: known.value[kind].levels(keys)
        for batch in common.portions(batches, "text", SCORED_BYTES):
            words, lengths = tokens(batch.column("text"))
            yield sums(row, batch.column("doc_id"), batch.column("held_out"), words, lengths, model.value, look)
            row += len(lengths)
            del words, batch

    return rows.mapInArrow(work, SCORES)


def asked(kind: int, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a kind whose levels a portion needs."""
    if kind == WORDS:
        return np.unique(words)
    both, three, first = grams(words, lengths)
    return np.unique(both if kind == PAIRS else three[~first])


TEXTS = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("distinct", pa.binary()), ("at", pa.binary())])


def closed(ids: pa.Array, held: pa.Array, words: np.ndarray, lengths: np.ndarray) -> bytes:
    """A portion of texts as bytes: which of its distinct words each word is, frequent ones by small numbers, and the
    numbers' low bytes apart from their high ones, so that they pack well."""
    distinct, at, times = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order))
    planes = rank[at].view("u1").reshape(-1, 4).T
    row = [[ids.to_pylist()], [held.to_pylist()], *([x.tobytes()] for x in (lengths, distinct[order], planes))]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(pa.record_batch(row, schema=TEXTS))
    return out.getvalue().to_pybytes()


def opened(texts: pa.Scalar) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """What closed() was given."""
    with pa.ipc.open_stream(texts.as_buffer()) as stream:
        batch = stream.read_next_batch()
    lengths, distinct, planes = (np.frombuffer(batch.column(c)[0].as_buffer(), t) for c, t in (("lengths", "i8"), ("distinct", "u8"), ("at", "u1")))
    at = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
    return batch.column("ids")[0].values, batch.column("held")[0].values, distinct[at], lengths


def scored_by_shuffle(rows: DataFrame, blocks: DataFrame, n_blocks: int, model) -> DataFrame:
    """The columns of SCORES; each portion of texts sends its n-grams to the filter's blocks and gets their levels back."""

    def cut(batches):
        part = TaskContext.get().partitionId() << 40  # the number of a portion is that of its first row
        for batch in common.portions(batches, "text", SENT_BYTES):
            words, lengths = tokens(batch.column("text"))
            yield pa.record_batch([pa.array([part]), pa.array([closed(batch.column("doc_id"), batch.column("held_out"), words, lengths)], pa.binary())], ["part", "texts"])
            part += len(lengths)
            del words, batch

    common.collected(rows.sparkSession)  # the counts' shuffle
    portions = common.written(rows.mapInArrow(cut, "part long, texts binary"), "lm-portions", LARGE_ROWS)

    def ask(kind, low, high):
        def work(batches):
            for batch in batches:
                for part, texts in zip(batch.column("part"), batch.column("texts"), strict=True):
                    keys = asked(kind, *opened(texts)[2:])
                    some = [x for x in runs(keys, n_blocks) if low <= x[0] < high]
                    for k in range(0, len(some), 64):
                        own = some[k : k + 64]
                        yield pa.record_batch([pa.array([b for b, _ in own]), pa.array([part.as_py()] * len(own)), pa.array([packed_keys(keys[run]) for _, run in own], pa.binary())], ["block", "part", "keys"])
                    keys = some = own = None
            common.give_back()

        return work

    def answer(asks, own):
        block, levels, rows = Filter(1, [(0, b.as_py()) for b in own.column("bits")]), [], asks.column("keys")
        ends = np.cumsum(pc.binary_length(rows).to_numpy().astype("i8")) if len(rows) else np.zeros(0, "i8")
        start = 0
        while start < len(rows):  # many short rows are looked up at once
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + LOOKED_UP * KEY_BYTES, "right")))
            found = block.levels(unpacked_keys(b"".join(rows.slice(start, stop - start).to_pylist()))).astype("u1").tobytes()
            at = [0, *((ends[start:stop] - before) // KEY_BYTES).tolist()]
            levels += [found[i:j] for i, j in zip(at, at[1:])]  # noqa: B905
            start = stop
        return pa.table({"part": asks.column("part"), "block": asks.column("block"), "levels": pa.array(levels, pa.binary())})

    answers = []
    for kind, k, of in ROUNDS:
        low, high = n_blocks * k // of, n_blocks * (k + 1) // of
        if low < high:
            asks = portions.mapInArrow(ask(kind, low, high), "block long, part long, keys binary").groupBy("block")
            own = blocks.filter((F.col("kind") == kind) & F.col("block").between(low, high - 1)).select("block", "bits").groupBy("block")
            answers.append(common.written(asks.cogroup(own).applyInArrow(answer, "part long, block long, levels binary"), "lm-levels").withColumn("kind", F.lit(kind)))
            del asks, own
            common.collected(rows.sparkSession)
    found = functools.reduce(DataFrame.unionByName, answers)

    def work(own, found):
        found = found.sort_by([("kind", "ascending"), ("block", "ascending")])
        of, levels = found.column("kind").to_numpy(), found.column("levels").to_pylist()
        kinds = np.searchsorted(of, [WORDS, PAIRS, TRIPLES, TRIPLES + 1])
        levels = [np.frombuffer(b"".join(levels[i:j]), "u1") for i, j in zip(kinds, kinds[1:])]  # noqa: B905
        ids, held, words, lengths = opened(own.column("texts")[0])
        keys = [asked(kind, words, lengths) for kind in (WORDS, PAIRS, TRIPLES)]
        look = lambda kind, some: levels[kind][np.searchsorted(keys[kind], some)].astype("i4")
        return pa.Table.from_batches([sums(own.column("part")[0].as_py(), ids, held, words, lengths, model.value, look)])

    return portions.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(work, SCORES)


def scored(docs: DataFrame, modulus: int = 7, held: int = 2, prior: float = PRIOR, triple_prior: float = TRIPLE_PRIOR, max_filter: int = MAX_FILTER, frequent: int = FREQUENT) -> DataFrame:
    """A row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training documents are those whose crc32(doc_id as text) mod modulus is not held (a null id trains). score sums
    log10 P(w | u v) over each text's words and its end, where
      P(w | u v) = (n(u, v, w) + triple_prior * P(w | v)) / (n(u, v) + triple_prior); P(w | v) for a first word,
      P(w | v) = (n(v, w) + prior * P(w)) / (n(v) + prior), and P(w) = (n(w) + 1) / (N + V + 1).
    n are counts as the filter has them (the lower end of their level; a context's is the upper end, so sums over
    words stay at most 1), exact for frequent words. Every n-gram of the training texts is entered. The priors are
    fixed numbers, picked from a few tried on the synthetic tables. base_score takes exact counts: frequent words from the broadcast table, whose
    length is bounded by `frequent`, others by a join. A filter beyond max_filter bytes is not broadcast; results are
    the same. Null texts are empty, with the end as their token; an empty training set gives the uniform model over
    the unknown. Repeated rows are scored each; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = common.ready(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(common.id_remainder(modulus) == held, F.lit(False)).alias("held_out"), text.cast("binary").alias("text"))
    blocks, n_blocks = learned(rows.filter(~F.col("held_out")))
    vocab = common.written(vocabulary(blocks), "lm-vocabulary")
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    denominator = total + distinct + 1
    often = vocab.filter(F.col("c") * frequent >= total).select("word", "c").toArrow()  # no more than `frequent` words
    often_words = often.column("word").to_numpy().astype("i8").view("u8")
    order = np.argsort(often_words)
    model = spark.sparkContext.broadcast(Smoothing(denominator, often_words[order], often.column("c").to_numpy().astype("i8")[order], prior, triple_prior))
    size = blocks.agg(F.sum(F.length("bits"))).first()[0] or 0
    score = scored_by_broadcast if size <= max_filter else scored_by_shuffle
    with common.scratch() as tables:
        done = common.written(score(rows, blocks, n_blocks, model), "lm-scores")
    if tables[:-1]:  # nothing reads what was sent any more
        common.removed(spark, tables[:-1])
        common.collected(spark)

    tail = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    tail = tail.join(vocab.filter(F.col("c") * frequent < total), "word")  # words without a count add log10(1)
    tail = tail.groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_logs"))
    out = done.drop("rare", "times").join(tail, "row", "left")
    base = F.col("logs") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(denominator)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: held out are documents whose remainder mod 7 is 2."""
    return scored(common.documents(spark, sf_dir))
