"""The queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lexical, merkle, near_dedup, warc
from .byte_bpe import op10_byte_bpe
from .iblt import op6_fingerprints
from .lexical import op12_lexical_search
from .lm_scores import op8_lm_scores
from .merkle import op11_merkle_manifest
from .mixing import op2_mixing
from .mpeg_audio import op4_mpeg_audio
from .near_dedup import op3_near_dedup
from .packed_ids import op5_token_ids
from .simhash import op13_simhash
from .token_counts import op9_token_counts
from .toxicity import op7_toxicity
from .warc import op1_warc


OPERATORS = (
    op1_warc, op2_mixing, op3_near_dedup, op4_mpeg_audio, op5_token_ids, op6_fingerprints, op7_toxicity,
    op8_lm_scores, op9_token_counts, op10_byte_bpe, op11_merkle_manifest, op12_lexical_search, op13_simhash,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op3_near_dedup": near_dedup.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_lexical_search": lexical.ORACLE}
