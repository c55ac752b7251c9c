"""Queries of this subpackage, and the SQL of those that SQL can express."""

from stackroom.llm import chat, decontamination, exact_dedup, lexical, licenses, line_dedup, mixing, near_dedup, packing, quality, resampling, sharding, url_filter

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_mixing": mixing.op10_mixing,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_packing": packing.op12_packing,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLES = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
}
