"""Best-fit packing of documents into token sequences after Martello-Toth dominance reduction."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import byte_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def dominance(count: list[int], room: int) -> list[tuple[list[int], int]]:
    """Fixes sets of sizes that dominate every other way to fill a sequence around one item of size s.

    count[s]: items of size s; what is fixed is taken out of it. Returns (sizes of the set, times). For the
    item, with `most` the number of further items that fit at best:
    - none fit: alone;  - one fits, or an item fills the room exactly: with the largest that fits;
    - two fit: with the largest that fits if it is no smaller than the fullest pair; or with that pair if it holds
      the largest that fits, and no two items above its smaller one fit together (each other choice then maps into it).
    Taking items away only removes choices, so a set is fixed as often as its sizes allow.
    """
    fixed = []

    def fix(sizes: list[int]) -> None:
        times = min(count[s] // sizes.count(s) for s in sizes)
        for s in sizes:
            count[s] -= times
        fixed.append((sizes, times))

    for s in range(room, 0, -1):
        while count[s]:
            count[s] -= 1  # one item is set aside to see what fits with it
            gap = room - s
            fits = [t for t in range(gap, 0, -1) if count[t]]
            small: list[int] = []
            for t in reversed(fits):
                small += [t] * min(count[t], 3 - len(small))
                if len(small) == 3:
                    break
            most = sum(sum(small[: k + 1]) <= gap for k in range(len(small)))
            chosen: list[int] | None = None
            if most == 0:
                chosen = []
            elif most == 1 or fits[0] == gap:
                chosen = [fits[0]]
            elif most == 2:
                best, pair = 0, (0, 0)
                for a in fits:
                    if 2 * a <= best:
                        break
                    b = next((t for t in fits if t <= min(a, gap - a) and count[t] >= 1 + (t == a)), 0)
                    if b and a + b > best:
                        best, pair = a + b, (a, b)
                if fits[0] >= best:
                    chosen = [fits[0]]
                elif pair[0] == fits[0]:
                    above: list[int] = []
                    for t in reversed(fits):
                        if t > pair[1] and len(above) < 2:
                            above += [t] * min(count[t], 2 - len(above))
                    if len(above) < 2 or sum(above) > gap:
                        chosen = list(pair)
            count[s] += 1
            if chosen is None:
                break
            fix([s, *chosen])
    return fixed


def best_fit(count: list[int], room: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over counts of sizes: ([(size, times in a sequence)], sequences).

    Items of one size fill the open sequence with the least sufficient room as often as they fit, then the next, as
    best fit does one by one; equal sequences are kept as one entry, so the work depends on room, not on the items.
    """
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for s in range(room, 0, -1):
        left = count[s]
        made: list[tuple[int, list[tuple[int, int]], int]] = []
        for gap in sorted(g for g in open_ if g >= s):
            if not left:
                break
            times, kept = gap // s, []
            for fill, n in open_.pop(gap):
                full = min(n, left // times)
                left -= full * times
                rest = n - full
                if full:
                    made.append((gap - times * s, [*fill, (s, times)], full))
                if rest and left and left < times:
                    made.append((gap - left * s, [*fill, (s, left)], 1))
                    rest, left = rest - 1, 0
                if rest:
                    kept.append((fill, rest))
            if kept:
                open_[gap] = kept
        times = room // s
        if left >= times:
            made.append((room - times * s, [(s, times)], left // times))
        if left % times:
            made.append((room - left % times * s, [(s, left % times)], 1))
        for gap, fill, n in made:
            open_.setdefault(gap, []).append((fill, n))
    return [x for gap in sorted(open_) for x in open_[gap]]


def plan(counts: dict[int, int], room: int) -> dict[int, np.ndarray]:
    """By size, rows (first rank, last rank + 1, first sequence, times in a sequence, offset), for the items' ranks."""
    count = [0] * (room + 1)
    for s, n in counts.items():
        count[s] = n
    fills = [([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], n) for sizes, n in dominance(count, room)]
    fills += best_fit(count, room)
    used, runs, sequence = dict.fromkeys(counts, 0), {s: [] for s in counts}, 0
    for fill, n in fills:
        offset = 0
        for s, times in fill:
            runs[s].append((used[s], used[s] + n * times, sequence, times, offset))
            used[s] += n * times
            offset += s * times
        sequence += n
    return {s: np.array(r, "i8").reshape(-1, 5) for s, r in runs.items()}


def pieces(docs: DataFrame, tokenizer: str, room: int = 1024, end: int = 2, entries: int | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. Whole texts (null: empty), then the end id.

    A document over room is cut into pieces of room tokens, the first one taking the remainder. Each Python worker
    remembers the ids of up to `entries` chunks of text (ID_ENTRIES by default): fewer take less memory and more time.
    """
    tail = np.array([end], "<u4").tobytes()

    def cut(batches):
        bpe, last, data = byte_bpe(tokenizer, entries), None, memoryview(tail)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc, text in zip(ids, batch.column(1), strict=True):
                text = text.as_py() or ""
                if text != last:  # copies of a document come one after the other
                    last, data = text, memoryview(bpe.encode(text) + tail)
                total, start, k = len(data) // 4, 0, 0
                stop = total % room or min(room, total)
                while start < total:
                    for col, v in zip(out, (doc, k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])), strict=True):
                        col.append(v)
                    start, stop, k = stop, stop + room, k + 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        common.give_back()

    return common.ready(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, room: int = 1024, end: int = 2, entries: int | None = None) -> DataFrame:
    """Places every piece of every document: its columns, sequence_id and offset (gapless from 0).

    Only the number of pieces of each length (room of them at most) reaches the driver, where dominance reduction
    and best fit run over counts; pieces then find their place by their rank among those of their length. A piece that
    fills a sequence is placed at once, whatever its rank. Null and empty texts are one end id. Repeated rows are packed each; a null doc_id stays null; an empty table gives no row.
    """
    made = common.written(pieces(docs, tokenizer, room, end, entries), "pack-pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts.pop(room, None)
    planned = plan(counts, room)  # some rows for each length below room
    used = max((int(r[2] + -(-(r[1] - r[0]) // r[3])) for x in planned.values() for r in x), default=0)
    full = made.filter(F.col("length") == room).withColumn("sequence_id", F.monotonically_increasing_id() + used).withColumn("offset", F.lit(0).cast("long"))
    runs = docs.sparkSession.sparkContext.broadcast(planned)
    sizes = F.broadcast(docs.sparkSession.createDataFrame(sorted(counts.items()), "length long, n long"))  # room rows at most
    ranked = common.spread_rank(made.filter(F.col("length") < room).join(sizes, "length"), ["length"], ["doc_id", "piece", "start", "ids_crc32"], "n")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
            for s in np.unique(length):
                at, run = np.flatnonzero(length == s), runs.value[int(s)]
                first, _, base, times, start = run[np.searchsorted(run[:, 0], rank[at], "right") - 1].T
                sequence[at] = base + (rank[at] - first) // times
                offset[at] = start + (rank[at] - first) % times * s
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long").unionByName(full)


def query(spark, sf_dir: str) -> DataFrame:
    """op3, over byte_bpe_50k.json and sequences of 1024 tokens."""
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
