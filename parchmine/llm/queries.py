"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .fertility import op3_quality_fertility
from .flat_tokens import op8_separator_scan
from .html import op2_html_main_text
from .lines import op9_line_dedup
from .mixing import op1_mixing_temperature
from .pieces import op6_sentencepiece_round_trip
from .projections import OP10_SQL, op10_embedding_near_dedup
from .simhash import op5_simhash_near_dedup
from .suffixes import op7_suffix_repeats
from .toxicity import op4_toxicity_counterfactual

QUERIES = {
    "op1_mixing_temperature": op1_mixing_temperature,
    "op2_html_main_text": op2_html_main_text,
    "op3_quality_fertility": op3_quality_fertility,
    "op4_toxicity_counterfactual": op4_toxicity_counterfactual,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_sentencepiece_round_trip": op6_sentencepiece_round_trip,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_separator_scan": op8_separator_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op10_embedding_near_dedup": OP10_SQL,
}
