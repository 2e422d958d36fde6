"""Quality rules as a short-circuit cascade, ordered by rejection per cost. DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Cost and selectivity are estimated on some so many rows (a sample over the whole table, which verdicts never depend
#: on), each taken so many times in a run, and so many runs.
SAMPLE_ROWS, REPEATS, RUNS = 500, 20, 2


@dataclass(frozen=True)
class Rule:
    """Rejects a row where `rejects`, an expression over the measures, is true; null counts as false."""

    name: str
    rejects: Column


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _text (null: empty) and _words, the words in order."""
    docs = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.withColumn("_trimmed", F.btrim("_text", F.lit(common.WHITE)))
    split = F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", common.WHITE_CLASS + "+"))
    return docs.withColumn("_words", common.once(split)).drop("_trimmed")


def with_repeats(df: DataFrame, width: int = 5) -> DataFrame:
    """Adds n_repeat_words: words that lie in windows of `width` words found twice or more in the text.

    Windows are compared by XXH64. Only texts with a repeated one sort theirs: equal neighbours name the repeated
    windows, and the gaps between their places, each counted up to the width, sum to the words they cover.
    """
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(width)])
    n = F.size("_words")
    df = df.withColumn("_hashes", common.once(F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), window))))
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", common.once(F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed))).drop("_hashes")
    near = lambda x, k: (F.get("_placed", k - 1)["h"] == x["h"]) | (F.get("_placed", k + 1)["h"] == x["h"])
    df = df.withColumn("_starts", common.once(F.array_sort(F.transform(F.filter("_placed", near), lambda x: x["i"])))).drop("_placed")
    cover = F.transform("_starts", lambda p, k: F.least(F.lit(width), F.coalesce(F.get("_starts", k + 1) - p, F.lit(width))))
    total = F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", common.once(F.coalesce(total, F.lit(0)).cast("long"))).drop("_starts")


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; keeps _text and _words for the rules."""
    df = with_repeats(with_words(docs))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(common.WHITE)) != "")
    df = df.withColumn("_lines", common.once(lines))
    return df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
    }).drop("_lines")


def default_rules() -> list[Rule]:
    """Each names one way in which a text is not prose; all are shares, so length does not matter."""
    n, text = F.col("n_words"), F.col("_text")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("shouting", F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) * 2 > letters),
        Rule("exclamations", F.regexp_count(text, F.lit("!!")) * 10 > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("few_letters", letters * 2 < F.col("word_chars")),
        Rule("duplicate_lines", (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3) & (F.col("n_dup_lines") > 2)),
    ]


def ordered(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """The rules by falling rejection per second, with (share rejected, seconds a row), as found on a small sample.

    A rule runs over the sample REPEATS times at once, so that its work outweighs a job's own; what a rule that
    rejects nothing takes is subtracted, and the quickest of RUNS runs counts. Rules too quick to tell apart cost the
    same, so they keep their order by what they reject, then by name.
    """
    sample = sample.persist()
    try:
        total = sample.count()
        many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def measured(rejects: Column) -> tuple[float, int]:
            seconds = []
            for _ in range(RUNS):
                began = time.perf_counter()
                hits = many.agg(F.count_if(rejects)).first()[0]
                seconds.append(time.perf_counter() - began)
            return min(seconds), hits

        measured(F.lit(False))  # compiles what all share
        empty, _ = measured(F.col("_again") < 0)
        found = []
        for rule in rules:
            seconds, hits = measured(rule.rejects)
            times = max(total * REPEATS, 1)
            found.append((rule, hits / times, max(seconds - empty, empty / 2) / times))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Some `rows` rows, each drawn by itself wherever it lies; all of a smaller table. A rerun draws the same ones."""
    n = docs.count()
    return docs if n <= rows else docs.sample(False, rows / n, 42)


def cascade(measured: DataFrame, sample: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds failed_rule: the first rule, in the order found best on the sample, that rejects the row; null if none does.

    A CASE evaluates its branches in turn, so a row costs no rule beyond the one that rejects it. Whether a row is
    rejected does not depend on the order.
    """
    first = F.lit(None).cast("string")
    for rule, _, _ in reversed(ordered(sample, default_rules() if rules is None else rules)):
        first = F.when(rule.rejects, F.lit(rule.name)).otherwise(first)
    return measured.withColumn("failed_rule", first)


def judged(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the five counts, base_failed, failed_rule and kept, a row per row of docs.

    Null and blank texts have no words and fail the base rules. Rows are independent: repeated rows, null ids and
    other columns change nothing; an empty table gives no row.
    """
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    ready = lambda df: measures(df.select("doc_id", "text")).withColumn("base_failed", base)
    df = cascade(ready(docs), ready(sampled(docs)), [Rule("base", F.col("base_failed")), *(default_rules() if rules is None else rules)])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select("doc_id", *counts, "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")


def query(spark, sf_dir: str) -> DataFrame:
    """op9 with the default rules."""
    return judged(common.documents(spark, sf_dir)).drop("failed_rule")
