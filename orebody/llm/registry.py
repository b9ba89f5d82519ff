"""The corpus operators' queries, by name, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from .audio import op4_telephony
from .byte_bpe import op3_trie_bpe
from .hnsw import op11_hnsw
from .html_text import op8_text_density
from .packing import op9_best_fit_packing
from .periodic import op13_periodic_runs
from .quality_model import op6_ftrl_quality
from .quality_rules import ABLATION_SQL, OP7_SQL, ledger_ablation, op7_rule_ledger
from .sharding import op5_feistel_shards
from .sharding import oracle_sql as op5_sql
from .simhash import op10_simhash
from .token_orc import op2_token_orc
from .toxicity import op1_toxicity
from .vector_codes import op12_vector_codes
from .vector_codes import oracle_sql as op12_sql

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_token_orc, op3_trie_bpe, op4_telephony, op5_feistel_shards,
        op6_ftrl_quality, op7_rule_ledger, op8_text_density, op9_best_fit_packing, op10_simhash, op11_hnsw, op12_vector_codes,
        op13_periodic_runs, ledger_ablation,
    )
}

ORACLES = {"op5_feistel_shards": op5_sql(), "op7_rule_ledger": OP7_SQL, "ledger_ablation": ABLATION_SQL, "op12_vector_codes": op12_sql()}
