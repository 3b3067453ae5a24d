"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.bloomlm import op7_bloom_lm
from framewright.llm.chat import OP3_SQL, op3_perspective_rotation
from framewright.llm.decontaminate import op1_template_decontamination
from framewright.llm.htmlwrap import op10_html_wrappers
from framewright.llm.jaccard import op2_ngram_jaccard_join
from framewright.llm.packing import op6_packing
from framewright.llm.quality import op9_quality_rules
from framewright.llm.sharding import op8_rendezvous_sharding
from framewright.llm.tokenfst import op5_token_counts
from framewright.llm.toxicity import op4_toxicity_chain


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_template_decontamination": op1_template_decontamination,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_perspective_rotation": op3_perspective_rotation,
        "op4_toxicity_chain": op4_toxicity_chain,
        "op5_token_counts": op5_token_counts,
        "op6_packing": op6_packing,
        "op7_bloom_lm": op7_bloom_lm,
        "op8_rendezvous_sharding": op8_rendezvous_sharding,
        "op9_quality_rules": op9_quality_rules,
        "op10_html_wrappers": op10_html_wrappers,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_perspective_rotation": OP3_SQL}
