"""The registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from tickweave.llm import bpe, exact_dedup, licenses, line_dedup, minhash_join, ngram_join, packing, prefix_trie, quality, secrets, structure_repair, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_line_dedup": line_dedup.op2,
    "op2_line_dedup_runs": line_dedup.op2_runs,
    "op3_license_scan": licenses.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_ngram_join": ngram_join.op5,
    "op6_quality_rules": quality.op6,
    "op7_secret_scan": secrets.op7,
    "op8_packing": packing.op8,
    "op9_bpe": bpe.op9,
    "op10_url_filter": url_filter.op10,
    "op11_minhash_join": minhash_join.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_structure_repair": structure_repair.op13,
}

ORACLE = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op2_line_dedup_runs": line_dedup.OP2_RUNS_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_minhash_join": minhash_join.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_structure_repair": structure_repair.OP13_SQL,
}
