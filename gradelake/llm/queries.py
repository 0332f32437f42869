"""The queries of this subpackage and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from . import audio, embedding_dedup, license_scan, minhash_dedup, nnls_packing, packing, periodic_runs, pieces, quality, secret_scan, spelling_variants, suffix_dedup, url_filter

QUERIES = {
    "op1_secret_scan": secret_scan.op1,
    "op2_license_scan": license_scan.op2,
    "op3_suffix_array_dedup": suffix_dedup.op3,
    "op4_audio_features": audio.op4,
    "op5_url_filter": url_filter.op5,
    "op6_minhash_near_dedup": minhash_dedup.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_sentencepiece": pieces.op8,
    "op9_embedding_near_dedup": embedding_dedup.op9,
    "op10_quality_classifier": quality.op10,
    "op11_spelling_variants": spelling_variants.op11,
    "op12_periodic_runs": periodic_runs.op12,
    "op13_nnls_packing": nnls_packing.op13,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_scan.ORACLE,
    "op2_license_scan": license_scan.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
}
