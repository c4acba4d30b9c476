"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import audit, licences, merkle, minhash, vectors, warc
from .decontaminate import op1_qgram_lemma
from .language import op9_ftrl_language
from .packing import op7_best_two_fit
from .quality import op10_ordinal_quality
from .sharding import op2_karmarkar_karp
from .simple8b import op13_simple8b
from .toxicity import op4_counterfactual_toxicity

QUERIES = {
    "op1_qgram_lemma": op1_qgram_lemma,
    "op2_karmarkar_karp": op2_karmarkar_karp,
    "op3_sentence_rules": licences.op3_sentence_rules,
    "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
    "op5_product_quantisation": vectors.op5_product_quantisation,
    "op6_warc_dictionary": warc.op6_warc_dictionary,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_minhash": minhash.op8_minhash,
    "op9_ftrl_language": op9_ftrl_language,
    "op10_ordinal_quality": op10_ordinal_quality,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_simple8b": op13_simple8b,
}

ORACLES: dict[str, str] = {
    "op3_sentence_rules": licences.ORACLE,
    "op5_product_quantisation": vectors.ORACLE,
    "op6_warc_dictionary": warc.ORACLE,
    "op8_minhash": minhash.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_filter_audit": audit.ORACLE,
}
