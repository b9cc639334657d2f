"""The queries of this package and their SQL."""

from __future__ import annotations

from . import audit, chat, collocations, contamination, jaccard, language, mixing, pii, quality, simhash, suffixes, toxicity, urls

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_chat_format": chat.op2_chat_format,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_poisson_mix": mixing.op4_poisson_mix,
    "op5_url_filter": urls.op5_url_filter,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii": pii.op8_pii,
    "op9_decontaminate": contamination.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
    "op11_collocations": collocations.op11_collocations,
    "op12_jaccard_join": jaccard.op12_jaccard_join,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLES = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_poisson_mix": mixing.OP4_SQL,
    "op5_url_filter": urls.OP5_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op9_decontaminate": contamination.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_jaccard_join": jaccard.OP12_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
