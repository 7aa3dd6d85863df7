"""Registered queries of the subpackage and the SQL that has to give the same rows, where SQL can."""

from __future__ import annotations

from veil.llm import exact_dedup, line_dedup, merkle
from veil.llm.ann import op8_ann
from veil.llm.bpe import op6_bpe
from veil.llm.exact_dedup import op10_exact_dedup
from veil.llm.extract import op7_html_extraction
from veil.llm.gap_packing import op11_gap_packing
from veil.llm.line_dedup import op5_line_dedup
from veil.llm.lm import op9_lm_scoring
from veil.llm.merkle import op13_merkle_manifest
from veil.llm.ngram_join import op1_ngram_join
from veil.llm.packing import op4_packing
from veil.llm.token_counts import op2_token_counts
from veil.llm.toxicity import op3_toxicity
from veil.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_token_counts, op3_toxicity, op4_packing, op5_line_dedup,
                                   op6_bpe, op7_html_extraction, op8_ann, op9_lm_scoring,
                                   op10_exact_dedup, op11_gap_packing, op12_whitening, op13_merkle_manifest)}
ORACLES = {"op5_line_dedup": line_dedup.SQL, "op10_exact_dedup": exact_dedup.SQL,
           "op13_merkle_manifest": merkle.SQL}
