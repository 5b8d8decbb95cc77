"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, decontaminate, line_dedup, packing, paragraphs, quality, rules, simhash, token_files, toxicity, variants, vector_search, warc

QUERIES = {
    f.__name__: f
    for f in (
        vector_search.op1_maxscore,
        packing.op2_grouping_genetic,
        token_files.op3_zstd_token_files,
        warc.op4_warc_zstd,
        quality.op5_zstd_quality,
        paragraphs.op6_paragraph_minhash,
        toxicity.op7_block_max_toxicity,
        line_dedup.op8_cuckoo_lines,
        simhash.op9_bit_sliced,
        decontaminate.op10_aho_corasick,
        rules.op11_cascade,
        variants.op12_symmetric_delete,
        alignment.op13_event_sweep,
    )
}
ORACLE_SQL = {
    "op1_maxscore": vector_search.OP1_SQL,
    "op4_warc_zstd": warc.OP4_SQL,
    "op8_cuckoo_lines": line_dedup.OP8_SQL,
    "op10_aho_corasick": decontaminate.OP10_SQL,
    "op11_cascade": rules.OP11_SQL,
    "op12_symmetric_delete": variants.OP12_SQL,
}
