"""Queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factweave.llm.chat_format import OP9_SQL, op9_chat_format
from factweave.llm.embedding_dedup import op10_embedding_dedup
from factweave.llm.exact_topk import OP2_SQL, op2_exact_topk
from factweave.llm.language_id import op1_language_id
from factweave.llm.packing import op4_packing
from factweave.llm.secrets import op7_secret_scan
from factweave.llm.sentencepiece_fst import op3_sentencepiece
from factweave.llm.simhash import op6_simhash_dedup
from factweave.llm.suffix_dedup import op8_suffix_dedup
from factweave.llm.toxicity import op5_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    own = (
        op1_language_id, op2_exact_topk, op3_sentencepiece, op4_packing, op5_toxicity,
        op6_simhash_dedup, op7_secret_scan, op8_suffix_dedup, op9_chat_format, op10_embedding_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op9_chat_format": OP9_SQL}
