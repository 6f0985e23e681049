"""Queries of this subpackage and, where SQL can express them, their SQL for the cross-check."""

import corpus_pipeline

from . import bpe, centroids, decontaminate, langid, lm, neardup, quality, setjoin, sharding, spelling, tokencount, urlfilter, warc

QUERIES = {
    "op1_warc_derivatives": warc.op1_warc_derivatives,
    "op2_jump_sharding": sharding.op2_jump_sharding,
    "op3_quality_lines": quality.op3_quality_lines,
    "op4_minhash_hamming": neardup.op4_minhash_hamming,
    "op5_interpolated_lm": lm.op5_interpolated_lm,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_template_decontamination": decontaminate.op9_template_decontamination,
    "op10_language_mixture": langid.op10_language_mixture,
    "op11_shallot_kmeans": centroids.op11_shallot_kmeans,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_jaccard_join": setjoin.op13_jaccard_join,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_warc_derivatives": warc.sql(),
    "op8_url_filter": urlfilter.sql(),
    "op9_template_decontamination": decontaminate.sql(),
    "op11_shallot_kmeans": centroids.sql(),
}
