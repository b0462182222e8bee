"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from rubrica.llm import (
    decontaminate,
    jaccard,
    licenses,
    linededup,
    negatives,
    packing,
    pii,
    quality,
    ranking,
    secrets,
    sharding,
    tokenfiles,
    urls,
)

QUERIES = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_url_filter": urls.op2_url_filter,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_packing": packing.op4_packing,
    "op5_token_files": tokenfiles.op5_token_files,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_ranked_search": ranking.op12_ranked_search,
    "op13_line_dedup": linededup.op13_line_dedup,
}

SQL: dict[str, str] = {
    "op2_url_filter": urls.OP2_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_ranked_search": ranking.OP12_SQL,
    "op13_line_dedup": linededup.OP13_SQL,
}
