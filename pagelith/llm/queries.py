"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pagelith.llm.decontamination import op3_decontamination
from pagelith.llm.html_extraction import op2_html_extraction
from pagelith.llm.line_dedup import OP8_SQL, op8_line_dedup
from pagelith.llm.near_duplicates import op7_ngram_jaccard
from pagelith.llm.packing import op5_packing
from pagelith.llm.pseudonyms import op10_pii_pseudonyms
from pagelith.llm.quality_rules import op6_quality_rules
from pagelith.llm.substring_dedup import op4_substring_dedup
from pagelith.llm.suffix_dedup import op1_suffix_dedup
from pagelith.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_pii_pseudonyms": op10_pii_pseudonyms,
}

ORACLES = {"op8_line_dedup": OP8_SQL}
