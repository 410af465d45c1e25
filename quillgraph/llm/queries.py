"""The subpackage's queries, and their SQL where it can say the same."""

import corpus_pipeline
from quillgraph.llm.block_naming import OP4_SQL, op4_exact_dedup
from quillgraph.llm.bpe import op10_byte_bpe
from quillgraph.llm.decontamination import OP11_SQL, op11_decontamination
from quillgraph.llm.language_id import op3_language_id
from quillgraph.llm.license_scan import op6_license_scan, op6_sql
from quillgraph.llm.minhash import op7_minhash_fingerprints
from quillgraph.llm.packing import op5_best_fit_packing
from quillgraph.llm.periodic_runs import op13_periodic_runs
from quillgraph.llm.prefix_trie import op12_prefix_trie
from quillgraph.llm.simhash import op1_simhash_near_dedup
from quillgraph.llm.suffix_array import op9_suffix_array_dedup
from quillgraph.llm.unit_dedup import op2_substring_dedup
from quillgraph.llm.url_filter import op8_sql, op8_url_filters

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_minhash_fingerprints": op7_minhash_fingerprints,
    "op8_url_filters": op8_url_filters,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_decontamination": op11_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op4_exact_dedup": OP4_SQL,
    "op6_license_scan": op6_sql(),
    "op8_url_filters": op8_sql(),
    "op11_decontamination": OP11_SQL,
}
