"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from netloom.llm import alignment, exact_topk, fingerprints, kd_shards, language_id, mixing, ngram_join, packing, quality, repair, reply_trees, simhash, url_filter

REGISTRY = {
    "op1_packing": packing.op1,
    "op2_ngram_jaccard_join": ngram_join.op2,
    "op8_mixing": mixing.op8,
    "op3_kd_shards": kd_shards.op3,
    "op5_url_filter": url_filter.op5,
    "op4_reply_trees": reply_trees.op4,
    "op6_fingerprints": fingerprints.op6,
    "op7_quality_classifier": quality.op7,
    "op10_exact_topk": exact_topk.op10,
    "op9_language_id": language_id.op9,
    "op11_alignment": alignment.op11,
    "op12_simhash": simhash.op12,
    "op13_repair": repair.op13,
}

SQL: dict[str, str] = {"op5_url_filter": url_filter.SQL}
