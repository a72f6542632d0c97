"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from claimlens.llm import audio, exact_dup, language, licenses, mixing, near_dup, pieces, pii, quality, url_filter


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_pii": pii.op1_pii,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_ngram_jaccard_join": near_dup.op4_ngram_jaccard_join,
        "op5_exact_dedup": exact_dup.op5_exact_dedup,
        "op6_media_audio": audio.op6_media_audio,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_language_id": language.op9_language_id,
        "op10_source_mixing": mixing.op10_source_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.OP2_SQL, "op3_license_scan": licenses.OP3_SQL, "op5_exact_dedup": exact_dup.OP5_SQL}
