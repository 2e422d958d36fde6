"""Cross-tokenizer alignment: token groups between byte offsets where both tokenizations end, and linked id pairs."""

from __future__ import annotations

import functools
import hashlib
from array import array
from bisect import bisect_left
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import ByteBpe

#: Id pairs whose counts are broadcast (17 bytes each); more of them meet the documents by a shuffle.
MAX_PAIRS = 4_000_000
#: Links and characters of a chunk that is remembered; a text with a larger one is aligned whole.
CHUNK_LINKS, CHUNK_LENGTH = 4096, 4096
#: Chunks kept by one Python worker, some 200 MB.
KNOWN_CHUNKS = 600_000


class PlainBpe(ByteBpe):
    """Special strings inside texts are plain text here."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []

    @functools.cached_property
    def spelled(self) -> list[bytes]:
        """The bytes of each token."""
        back = {c: b for b, c in self.letters.items()}
        names = {i: s for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        spell = lambda s: bytes(back[c] for c in s) if back.keys() >= set(s) else s.encode()
        return [spell(names.get(i, "")) for i in range(max(names) + 1)]


class Pieces:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        #: No piece goes on behind a space that follows something else, and texts are left as they are: then a text
        #: may be cut before each single space.
        self.chunked = not any("▁" in s.lstrip("▁") for s in names) and self.model.normalize("ﬁ  Å ") == "▁ﬁ▁▁Å▁"

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def overlaps(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """The first and last B token that each A token overlaps. The B tokens' ends are the static interval index (tokens
    follow each other, so an end is the next one's start); each A token stabs it at its first and last byte."""
    lasts = [bisect_left(b_ends, e) for e in a_ends]
    return list(zip([0, *[j + (b_ends[j] == e) for j, e in zip(lasts, a_ends[:-1])]], lasts))


def groups(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """(first A, behind the last A, first B, behind the last B) of each group. The gap behind an A token is spanned
    exactly if the next A token overlaps the same B token; gaps that no token spans are the boundaries."""
    found = overlaps(a_ends, b_ends)
    out, a0, b0, k = [], 0, 0, 0
    for (_, last), (following, _) in zip(found, found[1:]):
        k += 1
        if following > last:
            out.append((a0, k, b0, following))
            a0, b0 = k, following
    out.append((a0, len(a_ends), b0, len(b_ends)))
    return out


class Aligner:
    """Aligns texts. Where both tokenizers can cut a text before its spaces, each chunk is aligned once and remembered."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = PlainBpe(a_path), Pieces(b_path)
        self.names = list(map(str, range(max(len(self.a.spelled), len(self.b.spelled)))))
        self.a_sizes, self.b_sizes = list(map(len, self.a.spelled)), list(map(len, self.b.spelled))
        #: By chunk: its groups as a string, its A tokens and a key for each link; None if its text has to be aligned whole.
        self.known: dict[str, tuple[str, int, bytes] | None] = {}

    def spelled_by(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = f" {text}".encode()
        return b"".join([self.a.spelled[i] for i in a]) == raw == b"".join([self.b.spelled[i] for i in b])

    def grouped(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """The A and B ids of each group."""
        if len(a) == 1 or len(b) == 1:
            return [(a, b)]
        ends = list(accumulate([self.a_sizes[i] for i in a])), list(accumulate([self.b_sizes[i] for i in b]))
        return [(a[a0:a1], b[b0:b1]) for a0, a1, b0, b1 in groups(*ends)]

    def chunk(self, text: str, b: list[int]) -> tuple[str, int, bytes] | None:
        a = array("I", self.a.ids_of(" " + text)).tolist()
        if not self.spelled_by(text, a, b):
            return None
        found = self.grouped(a, b)
        keys = [i << 32 | j for x, y in found for i in x for j in y]
        return (self.said(found), len(a), array("q", keys).tobytes()) if len(keys) <= CHUNK_LINKS else None

    def said(self, found: list[tuple[list[int], list[int]]]) -> str:
        names = self.names
        return ";".join([f"{','.join([names[i] for i in x])}|{','.join([names[j] for j in y])}" for x, y in found])

    def texts(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text n_a, n_b, n_groups, the groups, and the distinct link keys with their occurrences. Chunks that
        are new are encoded together. When too many are known, the newer half goes: frequent chunks came early."""
        parts = [self.a.chunks(" " + t) if t and self.b.chunked else None for t in texts]
        words = {w for p in parts if p for w in p[1:]}
        new = [w for w in words if w not in self.known]
        if self.known and len(self.known) + len(new) > KNOWN_CHUNKS:
            self.known = dict(islice(self.known.items(), KNOWN_CHUNKS // 2))
            new = [w for w in words if w not in self.known]
        for w, b in zip(new, self.b.model.encode(new, num_threads=1), strict=True):
            self.known[w] = self.chunk(w, b) if len(w) <= CHUNK_LENGTH else None
        return [self.text(t, p) for t, p in zip(texts, parts, strict=True)]

    def text(self, text: str | None, parts: list[str] | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        if parts is not None and parts[0] == "":
            done = [self.known[w] for w in parts[1:]]
            if None not in done:
                said, n_a, keys = zip(*done, strict=True)
                joined, a = ";".join(said), sum(n_a)
                n = joined.count(";") + 1
                return a, joined.count(",") + 2 * n - a, n, joined, *np.unique(np.frombuffer(b"".join(keys), "i8"), return_counts=True)
        if not text:
            return NOTHING
        a, b = self.a.whole(" " + text), self.b.encode(text)
        if not a or not self.spelled_by(text, a, b):
            return NOTHING
        found, keys, times = self.grouped(a, b), [], []
        for x, y in found:
            (i, n), (j, m) = np.unique(np.array(x, "i8"), return_counts=True), np.unique(np.array(y, "i8"), return_counts=True)
            keys.append((i[:, None] << 32 | j[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(keys), "i8")
        np.add.at(total, at, np.concatenate(times))
        return len(a), len(b), len(found), self.said(found), keys, total


NOTHING = (0, 0, 0, "", np.zeros(0, "i8"), np.zeros(0, "i8"))


@common.remembered
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker and pair of files; kept between tasks."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, texts: bool = False) -> DataFrame:
    """A row per row: doc_id, n_a, n_b, n_groups, groups_sha256, the distinct links as keys (A id << 32 | B id) with
    their occurrences in times, and with `texts` the groups themselves ("a1,a2|b1;a3|b2,b3"). See alignment()."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "keys", "times", *(["groups"] if texts else [])]

    def work(batches):
        align = aligner(a_path, b_path)
        for batch in common.portions(batches, "text", 1 << 20):
            found = align.texts(batch.column(1).to_pylist())
            digests = [hashlib.sha256(x[3].encode()).hexdigest() if x[0] else "" for x in found]
            counts = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            lists = [pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (4, 5)]
            yield pa.record_batch([batch.column(0), *counts, pa.array(digests), *lists, *([pa.array([x[3] for x in found])] if texts else [])], names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, keys array<long>, times array<long>" + ", groups string" * texts
    return common.ready(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """key, a_id, b_id, n_docs (the rows whose keys hold it) and best (no pair of its A id has more), for each id pair.

    Counts are added up before they are shuffled; an A id has no more pairs than the B vocabulary has ids.
    """
    counted = links.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    ids = counted.select("key", F.shiftright("key", 32).alias("a_id"), F.col("key").bitwiseAND((1 << 32) - 1).alias("b_id"), "n_docs")
    return ids.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a_id")))


def scored(links: DataFrame, pairs: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """links (a written table of aligned()) with n_links, n_best and count_sum in place of keys and times.

    Up to `max_pairs` pairs go to every worker as sorted arrays; beyond that the documents' pairs are joined with them.
    """
    kept = [c for c in links.columns if c not in ("keys", "times")]
    sums = ["n_links", "n_best", "count_sum"]
    if pairs.count() <= max_pairs:
        table = pairs.select("key", "n_docs", "best").toArrow().sort_by("key")
        sent = links.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("key", "n_docs", "best")])

        def work(batches):
            keys, n, best = sent.value
            for batch in batches:
                lists = batch.column("keys")
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                times = batch.column("times").flatten().to_numpy()
                at = np.searchsorted(keys, lists.flatten().to_numpy())
                out = []
                for each in (times, times * best[at], times * n[at]):
                    upto = np.concatenate([[0], np.cumsum(each)])
                    out.append(pa.array(np.diff(upto[np.concatenate([[0], ends])]), pa.int64()))
                yield pa.record_batch([*(batch.column(c) for c in kept), *out], [*kept, *sums])

        schema = ", ".join(f"{c} {links.schema[c].dataType.simpleString()}" for c in kept) + "".join(f", {c} long" for c in sums)
        return links.mapInArrow(work, schema)
    numbered = common.written(links.withColumn("_row", F.monotonically_increasing_id()), "alignment-numbered")
    each = numbered.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("_row", "x.keys", F.col("x.times").alias("t"))
    each = each.join(pairs.select(F.col("key").alias("keys"), "n_docs", "best"), "keys")
    added = each.groupBy("_row").agg(F.sum("t").alias("n_links"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n_docs")).alias("count_sum"))
    return numbered.join(added, "_row", "left").select(*kept, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in sums])


def alignment(docs: DataFrame, a_path: str, b_path: str, texts: bool = False, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Aligns the tokens of a byte-level BPE file (A, of space + text) with those of a sentencepiece model (B, of text).

    Per row: doc_id, n_a, n_b, n_groups, groups_sha256, n_links (A-B token occurrences that share a group), n_best
    (links whose id pair is in the most documents, of the pairs of their A id; ties included) and count_sum (over links,
    the documents that hold their pair); with `texts` also groups. Texts that are null, empty, or not spelled by the
    tokens of both have no tokens: zeros and ''. Every row is a document: null and repeated ids and repeated rows count
    each. Other columns are ignored; an empty table gives no row.
    """
    links = common.written(aligned(docs, a_path, b_path, texts), "alignment-links")
    return scored(links, common.written(pair_counts(links), "alignment-pairs"), max_pairs)


def query(spark, sf_dir: str) -> DataFrame:
    """op11, between byte_bpe_50k.json and piece_bpe_32k.model."""
    import public_tokenizers

    found = alignment(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
