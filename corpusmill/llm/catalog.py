"""The queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from corpusmill.llm import collocations, conversations, decontamination, exact_dedup, licenses, lm_scores, ngram_join, pieces, quality_classifier, quality_rules, secrets, token_counts, warc


def queries() -> dict:
    """Name to query ``(spark, sf_dir) -> DataFrame``."""
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_lm_scores": lm_scores.op3_lm_scores,
        "op4_warc": warc.op4_warc,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_collocations": collocations.op11_collocations,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """Name to SQL; the others are tested against brute force or a round trip."""
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op3_lm_scores": lm_scores.ORACLE_SQL,
        "op4_warc": warc.ORACLE_SQL,
        "op5_secret_scan": secrets.ORACLE_SQL,
        "op7_ngram_join": ngram_join.ORACLE_SQL,
        "op11_collocations": collocations.ORACLE_SQL,
        "op12_conversation_repair": conversations.ORACLE_SQL,
        "op13_exact_dedup": exact_dedup.ORACLE_SQL,
    }
