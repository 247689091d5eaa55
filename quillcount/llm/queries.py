"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collocations, fingerprint, html_text, language, licenses, mixing, near_dup, packing, quality, substring, vectors, warc, whitening


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_minhash_near_dedup": near_dup.op2_minhash_near_dedup,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_warc_round_trip": warc.op4_warc_round_trip,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_quality_classifier": quality.op6_quality_classifier,
        "op7_document_fingerprints": fingerprint.op7_document_fingerprints,
        "op8_substring_dedup": substring.op8_substring_dedup,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_embedding_near_dedup": vectors.op10_embedding_near_dedup,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_language_id": language.op12_language_id,
        "op13_phrase_collocations": collocations.op13_phrase_collocations,
    }


def oracle_sql() -> dict:
    return {
        "op2_minhash_near_dedup": near_dup.OP2_SQL,
        "op3_license_scan": licenses.OP3_SQL,
        "op4_warc_round_trip": warc.OP4_SQL,
        "op5_mix_sources": mixing.OP5_SQL,
        "op8_substring_dedup": substring.OP8_SQL,
        "op10_embedding_near_dedup": vectors.OP10_SQL,
        "op13_phrase_collocations": collocations.OP13_SQL,
    }
