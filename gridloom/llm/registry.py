"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from gridloom.llm import filteraudit, heaplloyd, licenses, linededup, mixing, packing, secrets, simhash, sketches, toolcalls, topk, toxicity, warc

QUERIES = {
    "op7_sentence_rules": licenses.op7_sentence_rules,
    "op8_tool_call_linking": toolcalls.op8_tool_call_linking,
    "op5_pivot_top_k": topk.op5_pivot_top_k,
    "op2_nnpu_toxicity": toxicity.op2_nnpu_toxicity,
    "op6_scaled_sketches": sketches.op6_scaled_sketches,
    "op10_credential_linking": secrets.op10_credential_linking,
    "op1_poisson_mixing": mixing.op1_poisson_mixing,
    "op3_warc_salvage": warc.op3_warc_salvage,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op11_heap_lloyd": heaplloyd.op11_heap_lloyd,
    "op12_filter_audit": filteraudit.op12_filter_audit,
    "op13_line_dedup": linededup.op13_line_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_poisson_mixing": mixing.OP1_SQL,
    "op7_sentence_rules": licenses.OP7_SQL,
    "op8_tool_call_linking": toolcalls.OP8_SQL,
    "op5_pivot_top_k": topk.OP5_SQL,
    "op3_warc_salvage": warc.OP3_SQL,
    "op11_heap_lloyd": heaplloyd.OP11_SQL,
    "op12_filter_audit": filteraudit.OP12_SQL,
    "op13_line_dedup": linededup.OP13_SQL,
}
