"""Queries of this subpackage, and the SQL that DuckDB answers them with where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.bpe import op8_bpe
from quire.llm.centroids import op13_centroids
from quire.llm.embeddings import op5_embedding_dedup
from quire.llm.history import op12_history
from quire.llm.langid import op7_language_id
from quire.llm.minhash import op10_minhash
from quire.llm.mixing import op6_mix_sources
from quire.llm.oracles import ORACLES
from quire.llm.packing import op11_packing
from quire.llm.quality import op9_quality_rules
from quire.llm.substring_dedup import op2_substring_dedup
from quire.llm.suffix_array import op3_suffix_array_dedup
from quire.llm.tokencount import op4_token_counts
from quire.llm.warc import op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_mix_sources": op6_mix_sources,
        "op7_language_id": op7_language_id,
        "op8_bpe": op8_bpe,
        "op9_quality_rules": op9_quality_rules,
        "op10_minhash": op10_minhash,
        "op11_packing": op11_packing,
        "op12_history": op12_history,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
