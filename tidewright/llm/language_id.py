"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed text."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: A model is fitted on about so many documents of each language at most, chosen by a hash of their ids.
MAX_TRAIN = 4000
#: More languages than this are refused; with TABLE it bounds what is broadcast.
MAX_LANGUAGES = 500
#: Rows of the table of hashed character sequences.
TABLE = 1 << 16
#: Bytes of text looked at together, and code points whose features are made at a time.
PORTION, STEP = 3 << 19, 1 << 18
#: The least and the most a word can tell against a language, and what a change of language costs (nats).
FLOOR, SWITCH = -8.0, 10.0
#: First code points of runs of scripts, with the script's number; 0 is any other.
SCRIPTS = (
    (0x0000, 1, "Latin"), (0x0250, 1, "Latin"), (0x0370, 2, "Greek"), (0x0400, 3, "Cyrillic"), (0x0530, 4, "Armenian"), (0x0590, 5, "Hebrew"),
    (0x0600, 6, "Arabic"), (0x0700, 0, ""), (0x0750, 6, "Arabic"), (0x0780, 0, ""), (0x08A0, 6, "Arabic"), (0x0900, 7, "Devanagari"), (0x0980, 8, "Bengali"),
    (0x0A00, 9, "Gurmukhi"), (0x0A80, 10, "Gujarati"), (0x0B00, 0, ""), (0x0B80, 11, "Tamil"), (0x0C00, 12, "Telugu"), (0x0C80, 13, "Kannada"), (0x0D00, 14, "Malayalam"),
    (0x0D80, 15, "Sinhala"), (0x0E00, 16, "Thai"), (0x0E80, 17, "Lao"), (0x0F00, 18, "Tibetan"), (0x1000, 19, "Myanmar"), (0x10A0, 20, "Georgian"),
    (0x1100, 21, "Hangul"), (0x1200, 22, "Ethiopic"), (0x13A0, 0, ""), (0x1780, 23, "Khmer"), (0x1800, 24, "Mongolian"), (0x18B0, 0, ""),
    (0x1E00, 1, "Latin"), (0x1F00, 2, "Greek"), (0x2000, 0, ""), (0x3040, 25, "Kana"), (0x3100, 0, ""), (0x3130, 21, "Hangul"), (0x3190, 0, ""),
    (0x3400, 26, "Han"), (0xA000, 0, ""), (0xAC00, 21, "Hangul"), (0xD7B0, 0, ""), (0xF900, 26, "Han"), (0xFB00, 0, ""), (0xFB50, 6, "Arabic"), (0xFE00, 0, ""),
    (0x20000, 26, "Han"), (0x30000, 0, ""),
)
N_SCRIPTS = 27


@functools.cache
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, "u1")
    for (start, number, _), stop in zip(SCRIPTS, [*(s[0] for s in SCRIPTS[1:]), 0x110000], strict=True):
        script[start:stop] = number
    return letter, script


class Words:
    """The words (runs of letters, lower case) of some texts: their text, place, letters and script."""

    def __init__(self, texts: list[str]):
        letter, script = code_points()
        lower = [t.lower() for t in texts]
        codes = np.frombuffer(bytearray(("  " + "  ".join(lower) + "  ").encode("utf-32-le", "replace")), "<u4")
        alpha = letter[codes]
        edge = np.flatnonzero(np.diff(alpha.astype("i1")))
        self.first, last = edge[::2] + 1, edge[1::2] + 1
        self.letters = last - self.first
        starts = np.cumsum([2, *(len(t) + 2 for t in lower)])[:-1] if lower else np.zeros(0, "i8")
        self.doc = np.searchsorted(starts, self.first, "right") - 1
        self.n = np.bincount(self.doc, minlength=len(texts)).astype("i8")
        self.script = script[codes[self.first]]
        codes[~alpha] = 32
        self.codes, self.alpha = codes, alpha

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(features, the word of each, ascending) of some code points at a time, so that arrays stay small.

        A feature is a hashed sequence of two to four code points with at most a word's border at either end.
        """
        for low in range(0, len(self.codes), STEP):
            codes, alpha = self.codes[low : low + STEP + 3], self.alpha[low : low + STEP + 3]
            for k in (2, 3, 4):
                n = min(STEP, len(codes) - k + 1)
                if n <= 0:
                    continue
                mixed = np.zeros(n, "u4")
                for j in range(k):
                    mixed = (mixed + codes[j : n + j]) * np.uint32(0x9E3779B1)
                    mixed ^= mixed >> np.uint32(15)
                inner = alpha[1 : n + 1].copy() if k > 2 else alpha[:n] | alpha[1 : n + 1]
                for j in range(2, k - 1):
                    inner &= alpha[j : n + j]
                at = np.flatnonzero(inner)
                of = np.searchsorted(self.first, np.where(alpha[at], at, at + 1) + low, "right") - 1
                yield (mixed[at] >> np.uint32(8)).astype("i4") % TABLE, of


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # log probability of each feature, TABLE x languages
    scripts: np.ndarray  # whether a language is written in a script, N_SCRIPTS x languages

    def scores(self, words: Words) -> np.ndarray:
        """Words x languages: how much each word tells against a language, the best one's being 0."""
        n = len(words.first)
        score = np.zeros((n, len(self.languages)), "f4")
        for features, of in words.features():
            if len(of):
                low, high = int(of[0]), int(of[-1]) + 1
                for k in range(len(self.languages)):
                    score[low:high, k] += np.bincount(of - low, self.table[features, k], minlength=high - low)
        allowed = self.scripts[words.script]
        score[~allowed & allowed.any(axis=1, keepdims=True)] = -np.inf
        score -= score.max(axis=1, keepdims=True, initial=-np.inf) if n else 0
        return np.maximum(score, FLOOR)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word when each change of language costs `switch`.

    All texts advance one word at a time together, longest first, so the steps are as many as the longest has words.
    """
    order = np.argsort(-lengths, kind="stable")
    start, long = (np.cumsum(lengths) - lengths)[order], lengths[order]
    steps = int(long[0]) if len(long) else 0
    active = np.searchsorted(-long, -np.arange(steps), "left")
    label, came = np.zeros(len(scores), "i2"), np.full(scores.shape, -1, "i2")
    value = np.zeros((len(long), scores.shape[1]))
    best = np.zeros(len(long), "i8")
    for t in range(steps):
        m = active[t]
        at, v = start[:m] + t, value[:m]
        if t:
            top = v.argmax(axis=1)
            change = v[np.arange(m), top] - switch
            worse = v < change[:, None]
            came[at] = np.where(worse, top[:, None], -1)
            v = np.where(worse, change[:, None], v)
        value[:m] = v + scores[at]
    if steps:
        best = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at, now = start[:m] + t, best[:m]
        label[at] = now
        previous = came[at, now]
        best[:m] = np.where(previous >= 0, previous, now)
    return label


def train(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from text and lang (rows with a null in either are left out; _key orders them).

    Naive Bayes over hashed sequences of two to four letters; tasks send a vector of counts for each language, and
    the driver gets one for each.
    """
    rows = common.ready(labelled).filter("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return Model([], np.zeros((TABLE, 0), "f4"), np.zeros((N_SCRIPTS, 0), bool))
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, max_train / r["n"]))])
    rows = rows.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches):
        common.forget()
        for batch in common.portions(batches, "text", PORTION):
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                w = Words([str(t) for t in batch.column(1).filter(pa.array(langs == lang)).cast(pa.string()).to_pylist()])
                total = np.concatenate([sum((np.bincount(f, minlength=TABLE) for f, _ in w.features()), np.zeros(TABLE, "i8")), np.bincount(w.script, w.letters, minlength=N_SCRIPTS)]).astype("f8")
                yield pa.record_batch([pa.array([lang]), pa.array([total.tobytes()], pa.binary())], ["lang", "counts"])

    def add(table):
        total = sum(np.frombuffer(c.as_py(), "f8") for c in table.column("counts"))
        return pa.table({"lang": [table.column("lang")[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    counts = rows.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, counts binary")
    got = sorted((r["lang"], np.frombuffer(bytes(r["counts"]), "f8")) for r in counts.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect())
    each = np.array([c for _, c in got]).T
    features, scripts = each[:TABLE], each[TABLE:]
    table = np.log((features + 0.1) / (features.sum(axis=0) + 0.1 * TABLE)).astype("f4")
    return Model([lang for lang, _ in got], table, scripts > 0.005 * scripts.sum(axis=0))


FOUND = "lang_pred string, score double, spans array<struct<lang: string, start: int, words: int>>"


def identify(docs: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """A row per row: the column `keep` (or the struct `_row`, which holds the text), lang_pred, score (0 to 1) and spans of (lang, first word, words).

    Words are runs of letters. lang_pred is the language whose spans hold most letters (ties: the first by name);
    score is its share of the letters times how clearly its words tell it from the others. Null texts and texts
    without a letter are `und`, score 0, as is everything if no language was learned. Rows are independent.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))

    def work(batches):
        common.forget()
        model = known.value
        names = np.array([*model.languages, "und"], object)
        if keep == "_row":  # the text is in it, and does not come twice
            batches = (pa.record_batch([b.column(0), b.column(0).field("text").cast(pa.string())], [keep, "text"]) for b in batches)
        for batch in common.portions(batches, "text", PORTION):
            words = Words([t or "" for t in batch.column(1).cast(pa.string()).to_pylist()])
            size, many = batch.num_rows, len(model.languages)
            pred, score, spans = np.full(size, many), np.zeros(size), [[] for _ in range(size)]
            if many and len(words.first):
                s = model.scores(words)
                del words.codes, words.alpha  # a third of what is held, and no longer needed
                label = viterbi(s, words.n)
                held = np.bincount(words.doc * many + label, words.letters, minlength=size * many).reshape(size, many)
                some = words.n > 0
                pred[some] = held[some].argmax(axis=1)
                share = held.max(axis=1) / np.maximum(held.sum(axis=1), 1)
                mine = pred[words.doc]
                own = s[np.arange(len(s)), mine]
                s[np.arange(len(s)), mine] = -np.inf  # what is left are the rivals
                clear = np.bincount(words.doc, own - (s.max(axis=1) if many > 1 else FLOOR), minlength=size) / np.maximum(words.n, 1)
                score[some] = (share / (1 + np.exp(-clear)))[some]
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])
                at = np.flatnonzero(new)
                stop = np.append(at[1:], len(label))
                begin = np.cumsum(words.n) - words.n
                for a, b in zip(at.tolist(), stop.tolist(), strict=True):
                    d = words.doc[a]
                    spans[d].append({"lang": names[label[a]], "start": a - begin[d], "words": b - a})
            yield pa.record_batch([batch.column(0), pa.array(names[pred], pa.string()), pa.array(score), pa.array(spans, kind)], [keep, "lang_pred", "score", "spans"])

    rows = common.ready(docs).select(keep, *([] if keep == "_row" else [F.col("text").cast("string").cast("binary").alias("text")]))
    return rows.mapInArrow(work, StructType([rows.schema[keep], *StructType.fromDDL(FOUND)]))


def held_out_model(docs: DataFrame, modulus: int = 3, held: int = 1) -> Model:
    """Learned from documents whose crc32(doc_id as text) mod modulus is not held (a null id is learned from)."""
    learn = docs.filter(F.coalesce(common.id_remainder(modulus) != held, F.lit(True)))
    return train(learn.select("lang", "text", F.coalesce("doc_id", F.lit(0)).alias("_key")))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of each row."""
    out = identify(docs, held_out_model(docs))
    return out.select("doc_id", F.coalesce(common.id_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def with_language(docs: DataFrame, sure: float = 0.5) -> DataFrame:
    """The rows of docs that have a letter, with lang as it was predicted; those without (and null texts) go.

    A prediction with a score under `sure` only fills a null lang. Where no language could be learned, lang stays as
    it is. Repeated rows and null ids are rows like others; a column of docs may have any name.
    """
    rows, model = docs.select(F.struct(*map(common.named, docs.columns)).alias("_row")), held_out_model(docs)
    if not model.languages:
        return rows.filter(F.col("_row.text").cast("string").rlike(r"\p{L}")).select("_row.*")
    found = identify(rows, model, "_row").filter("lang_pred <> 'und'")
    lang = F.when(F.col("score") >= sure, F.col("lang_pred")).otherwise(F.coalesce("_row.lang", "lang_pred"))
    return found.select(F.col("_row").withField("lang", lang.cast(docs.schema["lang"].dataType)).alias("_row")).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: held out are documents whose remainder mod 3 is 1."""
    return predictions(common.documents(spark, sf_dir))
