"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, packing; each stage reads the last one's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import common, language_id, mixing, packing, simhash, substring_dedup

#: Chunks of text whose ids packing remembers: a quarter of op3's, as its executors have grown over the stages before.
REMEMBERED = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; lang becomes the predicted one where the prediction is sure, or there was none."""
    return language_id.with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 of their five-word shingles the document of least id stays.
    Candidates are near SimHash fingerprints, and texts in a band of minima for likeness beyond their radius."""
    return simhash.one_of_alike(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 20 words that also start earlier go; a document that loses all of them goes."""
    return substring_dedup.cleaned_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their copies under the sources' target weights."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), entries=REMEMBERED)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("substring_dedup", substring), ("mixing", mix), ("packing", pack)]

#: SQL cannot express the trained and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read by the next."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with common.scratch() as tables:
            docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            path = tables.pop()
        common.removed(spark, [*tables, *([before] if before else [])])  # what the stage wrote on its way, and what it read
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
