"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .word_encoder import worker_encoder
from .words import slices
from .work import table


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``path`` is a tokenizers ``.json`` or sentencepiece ``.model`` file. Tokens are
    those of the library for the whole text, without begin, end or other added
    ids, truncation or padding. Batches hold about the same number of bytes, and a
    long text is cut only at white space that the tokenizer drops, where no token
    reaches over the cut; for a tokenizer that keeps white space it is not split at all. A null text counts
    as empty; repeated rows and null ids keep a row each; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in batches:
            for some in slices(batch):
                counts = pa.array(encoder.counts(some.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("n_bytes"), counts], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
