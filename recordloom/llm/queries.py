"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from recordloom.llm.op1_url import OP1_SQL, op1_url_filters
from recordloom.llm.op2_toxicity import op2_toxicity
from recordloom.llm.op3_packing import op3_best_fit_packing
from recordloom.llm.op4_binary import op4_token_id_output
from recordloom.llm.op5_sentencepiece import op5_sentencepiece
from recordloom.llm.op6_jaccard import op6_ngram_jaccard
from recordloom.llm.op7_quality import op7_quality_rules
from recordloom.llm.op8_license import op8_license_scan
from recordloom.llm.op9_exact import OP9_SQL, op9_exact_dedup
from recordloom.llm.op10_langid import op10_language_id
from recordloom.llm.op11_lm import op11_lm_scoring
from recordloom.llm.op12_spelling import op12_spelling_variants
from recordloom.llm.op13_align import op13_cross_tokenizer

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_id_output": op4_token_id_output,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}
SQL = {
    "op1_url_filters": OP1_SQL,
    "op9_exact_dedup": OP9_SQL,
}
