"""The contract's queries and their SQL twins."""

from __future__ import annotations

from slatebed.llm.bpe import op1_byte_bpe
from slatebed.llm.common import table
from slatebed.llm.dac import op5_dac_tokens
from slatebed.llm.imatch import op2_imatch
from slatebed.llm.mixing import op9_entropy_mix
from slatebed.llm.oracles import IMATCH, QUALITY, TRIE
from slatebed.llm.periods import op13_periodic_runs
from slatebed.llm.ppm import op7_ppm
from slatebed.llm.prefix_trie import op11_prefix_trie
from slatebed.llm.quality import op6_host_quality
from slatebed.llm.rules import op12_rule_ensemble
from slatebed.llm.simhash import op8_simhash
from slatebed.llm.substrings import op3_suffix_dedup
from slatebed.llm.toxicity import op4_crf_toxicity
from slatebed.llm.urls import op10_url_templates


def _on(name, operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES = {
    "op1_byte_bpe": _on("documents", op1_byte_bpe),
    "op2_imatch": _on("documents", op2_imatch),
    "op3_suffix_dedup": _on("documents", op3_suffix_dedup),
    "op4_crf_toxicity": lambda spark, sf_dir: op4_crf_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_dac_tokens": _on("documents", op5_dac_tokens),
    "op6_host_quality": _on("documents", op6_host_quality),
    "op7_ppm": _on("documents", op7_ppm),
    "op8_simhash": _on("documents", op8_simhash),
    "op9_entropy_mix": _on("documents", op9_entropy_mix),
    "op10_url_templates": _on("pages", op10_url_templates),
    "op11_prefix_trie": _on("conversations", op11_prefix_trie),
    "op12_rule_ensemble": lambda spark, sf_dir: op12_rule_ensemble(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_periodic_runs": _on("documents", op13_periodic_runs),
}

ORACLE_SQL: dict[str, str] = {"op2_imatch": IMATCH, "op6_host_quality": QUALITY, "op11_prefix_trie": TRIE}
