"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm.chat import OP4_SQL, op4_chat_formatting
from tallgrass.llm.decontaminate import OP3_SQL, op3_decontamination
from tallgrass.llm.html import op2_html_extraction
from tallgrass.llm.mixing import op6_context_mixing
from tallgrass.llm.packing import op5_sequence_packing
from tallgrass.llm.quality import op10_tokenizer_fertility
from tallgrass.llm.secrets import op9_secret_scan
from tallgrass.llm.sharding import OP8_SQL, op8_size_tiered_sharding
from tallgrass.llm.repeats import op12_run_length_dedup
from tallgrass.llm.search import OP13_SQL, op13_shared_sum_search
from tallgrass.llm.simhash import op1_simhash_near_dedup
from tallgrass.llm.toxicity import op7_toxicity
from tallgrass.llm.trie import OP11_SQL, op11_prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_html_extraction,
        op3_decontamination,
        op4_chat_formatting,
        op5_sequence_packing,
        op6_context_mixing,
        op7_toxicity,
        op8_size_tiered_sharding,
        op9_secret_scan,
        op10_tokenizer_fertility,
        op11_prefix_trie,
        op12_run_length_dedup,
        op13_shared_sum_search,
    )
}
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op8_size_tiered_sharding": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_shared_sum_search": OP13_SQL}
