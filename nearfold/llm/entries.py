"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import anchors, digest, feistel, fertility, fim, jaccard, line_runs, mixing, packing, periodic, pfor, urls, warc

QUERIES = {
    "op1_fertility_rules": fertility.op1_fertility_rules,
    "op2_token_files": pfor.op2_token_files,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_line_dedup": line_runs.op4_line_dedup,
    "op5_feistel_pseudonyms": feistel.op5_feistel_pseudonyms,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_improbable_digest": digest.op7_improbable_digest,
    "op8_anchor_dedup": anchors.op8_anchor_dedup,
    "op9_warc_salvage": warc.op9_warc_salvage,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_url_filter": urls.op13_url_filter,
}

ORACLE_SQL = {
    "op3_jaccard_join": jaccard.ORACLE,
    "op4_line_dedup": line_runs.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op8_anchor_dedup": anchors.ORACLE,
    "op9_warc_salvage": warc.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
}
