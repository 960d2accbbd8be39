"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import annuli, codes, decontaminate, licenses, lines, mixing, multiindex, secrets, simhash, substring, topk, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_secret_scan": secrets.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_substring_dedup": substring.op4,
    "op5_toxicity": toxicity.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_source_mixing": mixing.op7,
    "op8_line_dedup": lines.op8,
    "op9_license_scan": licenses.op9,
    "op10_top_k": topk.op10,
    "op11_vector_codes": codes.op11,
    "op12_hard_negatives": annuli.op12,
    "op13_nearest_neighbours": multiindex.op13,
    "mix_targets": mixing.mix_targets,
    "license_phrases": licenses.license_phrases,
}

SQL: dict[str, str] = {
    "op1_warc": warc.OP1_SQL,
    "op2_secret_scan": secrets.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op10_top_k": topk.OP10_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op12_hard_negatives": annuli.OP12_SQL,
    "mix_targets": mixing.MIX_TARGETS_SQL,
    "license_phrases": licenses.LICENSE_PHRASES_SQL,
}
