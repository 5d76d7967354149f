"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, language, licenses, mixing, quality, simhash, substrings, tokencount, urlrules



def pipeline(spark, sf_dir: str):
    """The stages of corpus_pipeline.py at the repository's top, which imports this subpackage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_url_filters": urlrules.op2_url_filters,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_language_id": language.op4_language_id,
    "op5_chat_format": chat.op5_chat_format,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_quality_rules": quality.op10_quality_rules,
    "pipeline": pipeline,
}
SQL = {
    "op2_url_filters": urlrules.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
}
