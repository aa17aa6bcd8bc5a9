"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

import corpus_pipeline
from evidora.llm import embeddings, extraction, fingerprints, lines, merging, mixing, neardup, packing, sharding, spelling, substrings, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_relative_lz": substrings.query,
    "op2_pack_matrices": packing.query_matrices,
    "op3_mix_sources": mixing.query,
    "op4_fuzzy_lines": lines.query,
    "op5_best_fit_tree": packing.query_pieces,
    "op8_string_kernel_svm": toxicity.query,
    "op9_bagminhash": neardup.query,
    "op10_i_match": fingerprints.query,
    "op6_cap_filters": embeddings.query,
    "op7_feistel_shards": sharding.query,
    "op11_block_rules": extraction.query,
    "op12_levenshtein_tries": spelling.query,
    "op13_branch_merge": merging.query,
}
ORACLES = {
    "op1_relative_lz": substrings.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op6_cap_filters": embeddings.ORACLE,
    "op9_bagminhash": neardup.ORACLE,
    "op12_levenshtein_tries": spelling.ORACLE,
    "op13_branch_merge": merging.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
