"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .exact_dedup import OP8_SQL, op8_exact_dedup
from .language_id import op5_language_id
from .lm_scoring import op3_lm_scoring
from .mixing import op7_mix_sources
from .ngram_join import op6_ngram_jaccard_join
from .packing import op1_best_fit_packing
from .pii import op4_pii
from .quality import op2_quality_classifier
from .telephony import op9_telephony_audio
from .token_counts import op10_token_counts

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_mix_sources": op7_mix_sources,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_telephony_audio": op9_telephony_audio,
    "op10_token_counts": op10_token_counts,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op8_exact_dedup": OP8_SQL}
