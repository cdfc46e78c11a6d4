"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from quarryline.llm import bm25_pack, cotrain, dropout_bpe, html_gbt, lattice, quality_rules, rank_bpe, resample, secrets, simhash, spelling, suffix_dedup, token_store

QUERIES = {
    "op1_merge_dropout": dropout_bpe.op1_merge_dropout,
    "op2_token_store": token_store.op2_token_store,
    "op3_html_gbt": html_gbt.op3_html_gbt,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_bm25_pack": bm25_pack.op5_bm25_pack,
    "op6_lattice": lattice.op6_lattice,
    "op7_host_rules": quality_rules.op7_host_rules,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_cotrain": cotrain.op10_cotrain,
    "op11_byte_resample": resample.op11_byte_resample,
    "op12_rank_array": rank_bpe.op12_rank_array,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES = {
    "op6_lattice": lattice.ORACLE,
    "op7_host_rules": quality_rules.ORACLE,
    "op11_byte_resample": resample.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
