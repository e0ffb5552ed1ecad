"""The ``opN_<name>`` queries over the supplied tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from .importance import OP13_SQL, op13_importance_resampling
from .license_scan import OP5_SQL, op5_license_scan
from .mixing import OP8_SQL, op8_source_mixing
from .packing import op9_best_fit_packing
from .pii import op3_pii
from .quality_rules import ABLATIONS_SQL, OP7_SQL, op7_quality_rules, rule_ablations
from .repeats import op10_repeat_removal
from .simhash import op1_simhash_near_dedup
from .speculative import op12_bpe_round_trip
from .token_counts import op6_token_counts
from .token_files import op4_token_files
from .topk import OP2_SQL, op2_exact_topk
from .variants import OP11_SQL, op11_spelling_variants

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_exact_topk": op2_exact_topk,
    "op3_pii": op3_pii,
    "op4_token_files": op4_token_files,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mixing": op8_source_mixing,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_repeat_removal": op10_repeat_removal,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_importance_resampling": op13_importance_resampling,
    "rule_ablations": rule_ablations,
}

ORACLES: dict[str, str] = {
    "op2_exact_topk": OP2_SQL,
    "op5_license_scan": OP5_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_source_mixing": OP8_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
    "rule_ablations": ABLATIONS_SQL,
}
