"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from . import bpe, html_text, language_id, lexical, media, mixing, msd_dedup, ngram_join, quality, suffix_dedup, token_counts, vector_codes, wavelet

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_media_columns": media.op3_media_columns,
    "op4_entropy_mixing": mixing.op4_entropy_mixing,
    "op5_language_id": language_id.op5_language_id,
    "op6_html_text": html_text.op6_html_text,
    "op7_quality": quality.op7_quality,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_exact_dedup": msd_dedup.op10_exact_dedup,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_token_files": wavelet.op12_token_files,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op10_exact_dedup": msd_dedup.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
