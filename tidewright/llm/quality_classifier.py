"""Quality classifier: an additive model with pairwise interactions, fitted by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: About so many labelled rows at most are learned from, chosen by a hash of their ids.
MAX_TRAIN = 20_000
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "pipes", "punctuation",
    "not_ascii", "distinct_words", "top_word", "repeated_lines", "line_words", "short_words", "capitalised", "odd_ends",
)
BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letters": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "digits": b"0123456789",
    "symbols": b"#*$%&|<>", "exclamations": b"!", "pipes": b"|", "punctuation": b".,;:?!'\"()[]{}-_/\\", "white": b" \t\n\x0b\x0c\r",
}
CLASSES = np.array([[c in v for c in range(256)] for v in BYTES.values()] + [[c > 127 for c in range(256)]], "f8").T


def features(text: bytes) -> list[float]:
    """The text's features, in the order of FEATURES; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    upper, letters, digits, symbols, exclamations, pipes, punctuation, white, high = np.bincount(np.frombuffer(text, "u1"), minlength=256) @ CLASSES
    size = len(text) - white
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n), size / n, upper / max(letters, 1), digits / size, symbols / n, exclamations / n, pipes / n, punctuation / n,
        high / size, len(counts) / n, counts.most_common(1)[0][1] / n, 1 - len(set(lines)) / len(lines), min(n / len(lines), 1000.0),
        sum(1 for w in words if len(w) <= 3) / n, sum(1 for w in words if w[:1].isupper()) / n, sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128) / n,
    ]


def extracted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and x, the features, of each row (null text: empty)."""
    fields = docs.select(*keep).schema

    def work(batches):
        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(len(keep))]
            yield pa.record_batch([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", x array<double>"
    return common.ready(docs).select(*keep, F.col("text").cast("string").cast("binary")).mapInArrow(work, schema)


@dataclass(frozen=True)
class Additive:
    """score = sigmoid(base + a table value for the bin of each feature + one for each pair's two bins)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in {k for p in self.pairs for k in p}}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def stump_tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, out: np.ndarray, start: int = 0) -> None:
    """A tree over a feature's bins, from their sums of gradients g and weights h: its leaves' steps, into out."""
    if depth and len(g) > 1:
        lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = lg**2 / (lh + ridge) + (g.sum() - lg) ** 2 / (h.sum() - lh + ridge) - g.sum() ** 2 / (h.sum() + ridge)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > 1e-9:
            stump_tree(g[:cut], h[:cut], depth - 1, ridge, out, start)
            stump_tree(g[cut:], h[cut:], depth - 1, ridge, out, start + cut)
            return
    out[start : start + len(g)] = leaf(g.sum(), h.sum(), ridge)


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of each of two features' bins: its gain, and the steps of the four leaves on the grid."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    sums = []
    for c in (cg, ch):
        one, rows, cols, every = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
        sums.append([one, rows - one, cols - one, every - rows - cols + one])
    gain = sum(x**2 / (w + ridge) for x, w in zip(*sums, strict=True))
    if not gain.size:
        return 0.0, np.zeros(g.shape)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.zeros(g.shape)
    parts = ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))
    for part, x, w in zip(parts, *sums, strict=True):
        step[part] = leaf(x[i, j], w[i, j], ridge)
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + ridge)), step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, bins: int = 32, coarse: int = 8, rate: float = 0.15, ridge: float = 2.0) -> Additive:
    """Cyclic boosting: round by round each feature's table takes a shallow tree's step, then the best pairs theirs."""
    width = x.shape[1]
    cut = lambda k, n: np.unique(np.quantile(x[:, k], np.arange(1, n) / n)) if len(x) else np.zeros(0)
    edges, pair_edges = [cut(k, bins) for k in range(width)], [cut(k, coarse) for k in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    total = np.full(len(x), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k in range(width):
            g, h = slope()
            step = np.zeros(len(tables[k]))
            stump_tree(np.bincount(at[k], g, len(step)), np.bincount(at[k], h, len(step)), 2, ridge, step)
            tables[k] += rate * step
            total += rate * step[at[k]]
    rough = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(pair_edges)]
    shape = [len(e) + 1 for e in pair_edges]

    def grids(a: int, b: int) -> list[np.ndarray]:
        cell = rough[a] * shape[b] + rough[b]
        return [np.bincount(cell, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in slope()]

    ranked = sorted(combinations(range(width), 2), key=lambda p: -quadrants(*grids(*p), ridge)[0])[:pairs]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in ranked]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(ranked):
            _, step = quadrants(*grids(a, b), ridge)
            pair_tables[k] += rate * step
            total += rate * step[rough[a], rough[b]]
    return Additive(base, edges, tables, ranked, pair_edges, pair_tables)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, max_train: int = MAX_TRAIN) -> Additive:
    """A model of labels.quality, learned from rows whose crc32(doc_id as text) mod modulus is not held.

    Rows with a null id or label are left out. At most about max_train rows are taken; they alone reach the driver,
    as features.
    """
    rows = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter((common.id_remainder(modulus) != held) & F.col("y").isNotNull())
    share = min(1.0, max_train / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id").agg(F.avg("y").alias("y"))
    some = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # no more than about max_train rows
    got = extracted(some, ["doc_id", "y"]).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), "f8").reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy("f8"))


def scored(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """A row per row: doc_id, score (0 to 1), predicted. Null texts are empty; rows are independent."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            x = np.array([features(t.as_py() or b"") for t in batch.column(1)], "f8").reshape(-1, len(FEATURES))
            score = known.value.scores(x)
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype("i4"))], ["doc_id", "score", "predicted"])

    return common.ready(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(work, "doc_id long, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: held out are documents whose remainder mod 5 is 0."""
    docs = common.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", F.coalesce(common.id_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
