"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from regolith.llm import bpe, chat, html, langid, licenses, mtree, neardup, packing, quality, sharding

QUERIES = {
    "op1_hilbert_shards": sharding.op1_hilbert_shards,
    "op2_mtree_topk": mtree.op2_mtree_topk,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_minhash_neardup": neardup.op5_minhash_neardup,
    "op6_html_text": html.op6_html_text,
    "op7_language_id": langid.op7_language_id,
    "op8_cost_packing": packing.op8_cost_packing,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality_perplexity": quality.op10_quality_perplexity,
}

ORACLES: dict[str, str] = {"op2_mtree_topk": mtree.ORACLE_OP2}
