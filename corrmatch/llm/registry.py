"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import fingerprints, gif, jaccard, langid, lm, mixing, order, packing, pages, substrings

_ALL = (
    gif.op1_gif_media, packing.op2_best_fit_packing, substrings.op3_substring_dedup, order.op4_training_order, mixing.op5_source_mixing,
    jaccard.op6_ngram_jaccard, pages.op7_html_extraction,
    fingerprints.op8_weighted_sampling, lm.op9_lm_scoring, langid.op10_language_id,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op5_source_mixing": mixing.SQL, "op6_ngram_jaccard": jaccard.SQL}
