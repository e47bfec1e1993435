"""The queries of this subpackage."""

from __future__ import annotations

from grainmill.llm import op1_bpe, op2_jaccard, op3_ann, op4_mix, op5_secrets, op6_licenses, op7_quality, op8_toxicity, op9_pii, op10_topk, op11_importance, op12_warc, op13_collocations

_MODULES = (op1_bpe, op2_jaccard, op3_ann, op4_mix, op5_secrets, op6_licenses, op7_quality, op8_toxicity, op9_pii, op10_topk, op11_importance, op12_warc, op13_collocations)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
