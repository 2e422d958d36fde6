import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tidewright.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_counts(spark, sf, odd, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id or -1, *brute(r.text)) for r in docs.collect())
    rows = quality_rules.judged(docs).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(not r.kept for r in rows if r.base_failed)


def test_empty(none):
    assert quality_rules.judged(none).count() == 0


def test_order_does_not_change_verdicts(spark, sf):
    df = quality_rules.measures(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    rules = quality_rules.default_rules()
    a = quality_rules.cascade(df, df.limit(50), rules).filter("failed_rule is null").select("doc_id")
    any_ = F.lit(False)
    for r in rules:
        any_ = any_ | F.coalesce(r.rejects, F.lit(False))
    assert sorted(a.collect()) == sorted(df.filter(~any_).select("doc_id").collect())


def test_cheap_and_selective_comes_first(spark):
    df = spark.range(1000).select(F.col("id").alias("x"))
    slow = lambda bound: F.size(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(3000)), lambda i: i * F.col("x") % 97))) * (F.col("x") + 1) < bound
    rules = [quality_rules.Rule("slow", slow(0)), quality_rules.Rule("slow_half", slow(3001 * 500)), quality_rules.Rule("few", F.col("x") < 9), quality_rules.Rule("half", F.col("x") % 2 == 0)]
    orders = [[r[0].name for r in quality_rules.ordered(df.limit(100), list(reversed(rules)) if k else rules)] for k in range(3)]
    assert orders[0][0] == "half" and orders[0][-1] == "slow" and orders == [orders[0]] * 3
    assert {r.failed_rule for r in quality_rules.cascade(df, df.limit(100), rules).collect()} == {"half", "slow_half", "few", None} - ({"few"} if orders[0].index("few") > orders[0].index("slow_half") else set())


def test_sample_covers_a_sorted_table(spark):
    """In a table sorted by quality, the first rows would put the rule that never fires on the others first."""
    df = spark.range(0, 40_000, 1, 16).select(F.col("id").alias("doc_id"), (F.col("id") < 2000).alias("bad"))
    few, rest = quality_rules.Rule("few", F.col("bad")), quality_rules.Rule("rest", ~F.col("bad"))
    sample = quality_rules.sampled(df)
    assert 350 < sample.count() < 650 and sample.select(F.spark_partition_id()).distinct().count() == 16
    assert sample.collect() == quality_rules.sampled(df).collect()
    share = {r[0].name: r[1] for r in quality_rules.ordered(sample, [few, rest])}
    assert 0.01 < share["few"] < 0.12 and share["rest"] > 0.85
    assert {r[0].name: r[1] for r in quality_rules.ordered(df.limit(500), [few, rest])} == {"few": 1.0, "rest": 0.0}
    assert quality_rules.sampled(df.limit(100)).count() == 100


def brute_kept(text):
    text = text or ""
    n, chars, symbols, dup, _, failed = brute(text)
    letters, upper = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    rules = [symbols * 10 > n, upper * 2 > letters, text.count("!!") * 10 > n, chars < 2 * n or chars > 20 * n, letters * 2 < chars, dup * 10 > len(lines) * 3 and dup > 2]
    return not failed and not any(rules)


@pytest.mark.parametrize("which", ["sf0.01", "odd"])
def test_kept_against_brute_force(spark, odd, which):
    docs = odd if which == "odd" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id or -1, brute_kept(r.text)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.kept) for r in quality_rules.judged(docs).collect()) == want


def test_clean_texts_are_kept(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    rows = quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept for r in rows) >= 0.97 * len(rows)
