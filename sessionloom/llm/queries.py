"""The queries of the training-data operators and the SQL that some can be checked with."""

from __future__ import annotations

from . import audit, chat, decontaminate, htmltext, langid, lzprint, neardup, packing, quality, tokens, topk, trie, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_langid": langid.op2_langid,
    "op3_quality": quality.op3_quality,
    "op4_html": htmltext.op4_html,
    "op5_tokens": tokens.op5_tokens,
    "op6_chat": chat.op6_chat,
    "op7_neardup": neardup.op7_neardup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_packing": packing.op9_packing,
    "op10_topk": topk.op10_topk,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_lzprint": lzprint.op12_lzprint,
    "op13_trie": trie.op13_trie,
}
SQL = {
    "op1_warc": warc.OP1_SQL,
    "op6_chat": chat.OP6_SQL,
    "op7_neardup": neardup.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op10_topk": topk.OP10_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op13_trie": trie.OP13_SQL,
}
