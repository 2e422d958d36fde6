"""Token counts with the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import ByteBpe, byte_bpe


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Which vocabulary strings alone encode as one token is proved once, on the driver, over the vocabulary (its size
    bounds what is broadcast). Pre-tokens among them count 1 with no merging; the rest are merged. Null and empty
    texts have no token. Rows are independent: repeated rows, null ids and other columns change nothing.
    """
    single = docs.sparkSession.sparkContext.broadcast(ByteBpe(tokenizer).single())

    def count(batches):
        count_text = byte_bpe(tokenizer).counter(single.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = pa.array(map(count_text, texts), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), size, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        common.give_back()

    return common.ready(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op7, over byte_bpe_50k.json and a limit of 512 tokens."""
    import public_tokenizers

    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
